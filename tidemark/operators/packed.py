"""Several values in one field: the dialect with the shortest description parses it.

A dialect is a set of separators, a way of quoting and a wrapper. The description of a text is the code of its dialect and
the codes of what stands at its places: values, labels, missing ones, and letters where a place is none of these. A first
pass over all rows parses with codes that follow from the form alone (a set of separators is named member by member, all
values are alike) and counts dialects, values and labels, partition by partition; their frequencies give the code
lengths with which every field is then parsed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Separators as patterns, each with one that must occur in the text; the last column tells whether it may
#: be mixed with others.
SEPARATORS: list[tuple[str, str, str, bool]] = [
    ("semicolon", r";", r";", True),
    ("blank", r" +", r" ", False),
    ("slash", r"/", r"/", True),
    ("bar", r"\|", r"\|", True),
    ("comma", r",", r",", True),
    ("hyphen", r"-", r"-", False),
    ("dash", "[\u2012-\u2015\u2212]", "[\u2012-\u2015\u2212]", False),
    ("ampersand", r"&", r"&", True),
    ("tab", r"\t", r"\t", True),
    ("line", r"\r?\n", r"\n", True),
    ("or", r"\bor\b", r"\bor\b", True),
    ("and", r"\band\b", r"\band\b", True),
    ("label", r"[;,|/&\s]+(?=[A-Za-z]+[0-9]+\s*[:=])", r"[A-Za-z]+[0-9]+\s*[:=]", False),
    ("plus", r"\+", r"\+", False),
    ("colon", r":", r":", False),
    ("backslash", r"\\", r"\\", False),
]
#: What stands for no value, and what a whole field may be wrapped in.
MISSING = {"", "-", "--", "nan", "na", "n/a", "n.a.", "null", "none", "nil", "?", "*", ".", "x"}
WRAPPERS = {'"': '"', "'": "'", "(": ")", "[": "]", "{": "}", "<": ">"}
#: Bits of a letter that is spelt out, one of 128; share of all symbols from which a label has a code of its own.
LETTER_BITS, RARE = 7.0, 1e-4
_SEPS = [(name, re.compile(pattern), re.compile(need), mixes) for name, pattern, need, mixes in SEPARATORS]
_PATTERN = {name: pattern for name, pattern, _, _ in SEPARATORS}
_VALUE = re.compile(r"(0*[0-9]{1,9})(?:\.0*)?\s*(?:°|º|deg)?", re.I)
_LABEL = re.compile(r"([A-Za-z]+[0-9]*)\s*[:=]\s*")
_MIXED: dict[tuple[str, ...], re.Pattern] = {}
SPELT = "letters"  # the symbol before letters that are spelt out

#: What a parse is made of: values (int), None for a missing one, SPELT, and labels (str with a colon).
Symbol = int | str | None


class Codes:
    """Code lengths of dialects and symbols in bits."""

    def __init__(self, most: int, dialects: dict[str, int] | None = None, symbols: dict[Symbol, int] | None = None):
        self.flat = math.log2(most + 3)  # every value, a missing one, letters
        self.dialects, self.no_dialect = _lengths(dialects)
        self.symbols, self.no_symbol = _lengths(symbols)

    def dialect(self, name: str, separators: int, extra: int) -> float:
        if self.dialects is not None:
            return self.dialects.get(name, self.no_dialect)
        return 1 + separators * (1 + math.log2(len(SEPARATORS))) + 2 * extra

    def symbol(self, s: Symbol) -> float:
        if self.symbols is not None:
            return self.symbols.get(s, self.no_symbol)
        return self.flat


def _lengths(counts: dict | None) -> tuple[dict | None, float]:
    if counts is None:
        return None, 0.0
    total = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return {k: -math.log2((n + 0.5) / total) for k, n in counts.items()}, -math.log2(0.5 / total)


def cell(text: str, quotes: bool, most: int, codes: Codes) -> tuple[int | None, float, list[Symbol]]:
    """The value at a place (None without one), the bits of its description, and its symbols."""
    t = text.strip()
    if quotes and len(t) > 1 and t[0] in "\"'" and t[-1] == t[0]:
        t = t[1:-1].strip()
    m = _LABEL.match(t)
    if m and m.end() < len(t):
        label = m[1] + ":"
        value, bits, symbols = cell(t[m.end() :], quotes, most, codes)
        known = codes.symbols is not None and label in codes.symbols
        return value, bits + codes.symbol(label) + (0.0 if known else LETTER_BITS * len(label)), [label, *symbols]
    if t.lower() in MISSING:
        return None, codes.symbol(None), [None]
    m = _VALUE.fullmatch(t)
    if m and int(m[1]) <= most:
        return int(m[1]), codes.symbol(int(m[1])), [int(m[1])]
    return None, codes.symbol(SPELT) + LETTER_BITS * (len(t) + 1), [SPELT]


def _dialects(form: str) -> Iterator[tuple[str, re.Pattern | None, int]]:
    """The sets of separators that may parse a text: none, each one that occurs, and all that mix."""
    yield "none", None, 0
    mixed = []
    for name, pattern, need, mixes in _SEPS:
        if need.search(form):
            yield name, pattern, 1
            if mixes:
                mixed.append(name)
    if len(mixed) > 1:
        key = tuple(mixed)
        if key not in _MIXED:
            _MIXED[key] = re.compile("|".join(_PATTERN[n] for n in key))
        yield "+".join(key), _MIXED[key], len(key)


def parse(text: str, most: int, codes: Codes) -> tuple[str, list[int | None], list[Symbol]]:
    """The cheapest dialect, the value at each place (None where there is none), and the symbols of the description."""
    best: tuple[float, str, list[int | None], list[Symbol]] = (math.inf, "", [], [])
    t = text.strip(" \r\n\t")
    forms = [(t, "")]
    if len(t) > 1 and WRAPPERS.get(t[0]) == t[-1]:
        forms.append((t[1:-1], "wrapped "))
    if t and text.strip(" ") != t:
        forms.append((text.strip(" "), "open "))  # a separator at an end leaves an empty place
    for form, note in forms:
        quoting = (False, True) if '"' in form or "'" in form else (False,)
        for name, pattern, size in _dialects(form):
            parts = [form] if pattern is None else pattern.split(form.strip() if name in ("blank", "label") else form)
            for quotes in quoting:
                whole = note + name + (" quoted" if quotes else "")
                total = codes.dialect(whole, size, bool(note) + quotes)
                values, symbols = [], []
                for p in parts:
                    if total >= best[0]:
                        break
                    v, bits, s = cell(p, quotes, most, codes)
                    total += bits
                    values.append(v)
                    symbols += s
                if total < best[0] and len(values) == len(parts):
                    best = (total, whole, values, symbols)
    return best[1:]


def _key(s: Symbol) -> str:
    return "" if s is None else str(s)


def _symbol(key: str) -> Symbol:
    return None if key == "" else int(key) if key.isdigit() else key


def learned_codes(df: DataFrame, fields: dict[str, int]) -> dict[str, Codes]:
    """The code lengths of each field from how often dialects and symbols occur over all rows: a number for each allowed
    value, for each combination of separators that occurs, and for each label that makes up at least RARE of all symbols;
    rarer labels, of which there may be any number, are left to their letters."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in frames:
            for name, most in fields.items():
                start = Codes(most)
                for text, n in pdf[name].value_counts().items():
                    dialect, _, symbols = parse(text, most, start)
                    seen[name, "dialect", dialect] += n
                    for s in symbols:
                        seen[name, "symbol", _key(s)] += n
            if len(seen) > 100_000:
                yield table(seen)
                seen.clear()
        yield table(seen)

    def table(seen: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["field_name", "kind", "what", "n"])

    summed = df.select(*fields).mapInPandas(count, "field_name string, kind string, what string, n bigint").groupBy("field_name", "kind", "what").agg(F.sum("n").alias("n"))
    is_label = F.col("what").like("%:") & (F.col("kind") == "symbol")
    summed = materialize(summed, "codes")
    totals = {r["field_name"]: r["n"] for r in summed.filter("kind = 'symbol'").groupBy("field_name").agg(F.sum("n").alias("n")).collect()}
    enough = F.lit(False)
    for f, n in totals.items():
        enough = enough | ((F.col("field_name") == f) & (F.col("n") >= n * RARE))
    counts: dict[str, dict[str, dict]] = {f: {"dialect": {}, "symbol": {}} for f in fields}
    for r in summed.filter(~is_label | enough).collect():
        counts[r["field_name"]][r["kind"]][_symbol(r["what"]) if r["kind"] == "symbol" else r["what"]] = r["n"]
    return {f: Codes(most, counts[f]["dialect"], counts[f]["symbol"]) for f, most in fields.items()}


def unpack(df: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """One row per place of each packed text field: `key`, field_name, pos (from 1), degrees (NULL for a place without
    a value), dialect. `fields` maps column names to the largest value allowed. NULL fields give no rows; an empty text
    is one empty place; repeated rows are kept."""
    codes = learned_codes(df, fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple[str, str], tuple[str, list[int | None]]] = {}
        for pdf in frames:
            keys, names, places, values, dialects = [], [], [], [], []
            for name, most in fields.items():
                for k, text in zip(pdf[key], pdf[name]):
                    if text is None:
                        continue
                    got = kept.get((name, text))
                    if got is None:
                        got = parse(text, most, codes[name])[:2]
                        if len(kept) < 200_000 and len(text) < 200:
                            kept[name, text] = got
                    n = len(got[1])
                    keys += [k] * n
                    names += [name] * n
                    places += range(1, n + 1)
                    values += got[1]
                    dialects += [got[0]] * n
            yield pd.DataFrame({key: keys, "field_name": names, "pos": places, "degrees": pd.array(values, "Int64"), "dialect": dialects})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *fields).mapInPandas(run, f"`{key}` {kind}, field_name string, pos int, degrees int, dialect string")
