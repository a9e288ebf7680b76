"""Evaluation passages in training text: suffix arrays over shards of the corpus, binary-searched with every suffix of
every passage.

Each task turns its documents into shards of at most `shard_words` words and builds a suffix array of each shard by
prefix doubling, ranking the test suffixes along with it. Binary search then gives, for every test suffix, all places of
the shard that agree with it in `min_words` words, without those that a longer match covers; the ranks of the doubling
give the length of each longest verbatim match. Words that no passage holds cannot match and end a suffix. There is no
shuffle of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, SHARD_WORDS, TEST_WORDS = 10, 2_000_000, 1_000_000
MATCHES = "doc_id bigint, item_id bigint, words int, doc_word int, item_word int"
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s[^<>]{0,200})?/?>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, accents, markup tags and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        text = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf") and (c >= " " or c.isspace()))
    else:
        text = text.lower()
    return _WORD.findall(_TAG.sub(" ", text) if "<" in text else text)


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _rank_tables(a: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: table k holds the dense ranks of the 2**k-word substrings from each position, the last one those of
    the whole suffixes. Positions behind the end count as 0."""
    tables = [_dense(a)]
    while tables[-1].max(initial=0) + 1 < len(a) and 2 ** len(tables) < 2 * len(a):
        rank, step = tables[-1], 2 ** (len(tables) - 1)
        nxt = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
        tables.append(_dense(rank * (nxt.max(initial=0) + 1) + nxt))
    return tables


def _ranks(tables: list[np.ndarray], length: int) -> np.ndarray:
    """Dense ranks of the `length`-word substrings: two pieces of a power of two that together cover them."""
    k = min(length.bit_length() - 1, len(tables) - 1)
    if 2**k >= length or k == len(tables) - 1:
        return tables[k]
    step = length - 2**k
    nxt = np.concatenate([tables[k][step:] + 1, np.zeros(min(step, len(tables[k])), np.int64)])
    return _dense(tables[k] * (nxt.max(initial=0) + 1) + nxt)


def _common(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes from a and from b share, from the longest power of two down."""
    a, b, n = a.copy(), b.copy(), len(tables[0])
    length = np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = tables[k][a[inside]] == tables[k][b[inside]]
        for x in (length, a, b):
            x[same] += 2**k
    return length


def shard_matches(corpus: np.ndarray, tests: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corpus position, test position, length) of every maximal match of min_words or more words. Both arrays hold word
    numbers, 0 between texts and for words that no passage holds; matches never cross a 0."""
    none = np.zeros(0, np.int64)
    n = len(corpus)
    # words left before the next 0, from each position
    both = np.concatenate([[0], corpus, [0], tests, [0]])
    zeros = np.flatnonzero(both == 0)
    left = zeros[np.searchsorted(zeros, np.arange(len(both)))] - np.arange(len(both))
    full = left >= min_words
    starts = np.flatnonzero(full)
    if not len(starts):
        return none, none, none
    edge = np.zeros(len(both) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_words, -1)
    keep = np.cumsum(edge[:-1]) > 0
    keep[np.minimum(np.flatnonzero(keep) + 1, len(both) - 1)] = True  # with the 0 behind each piece
    place = np.flatnonzero(keep)
    small, ok = both[place], full[place]
    small = np.where(small == 0, -np.arange(len(small)), small)  # no two ends are alike
    tables = _rank_tables(small)
    is_test = place > n + 1
    c, t = np.flatnonzero(ok & ~is_test), np.flatnonzero(ok & is_test)
    if not len(c) or not len(t):
        return none, none, none
    # the suffix array of the shard; among suffixes alike in min_words words those with the same word before stand together
    head = _ranks(tables, min_words)
    width = int(both.max()) + 1
    before = both[place - 1]
    key = head[c] * width + before[c]
    order = c[np.lexsort((tables[-1][c], key))]
    heads, keys = head[order], np.sort(key)
    low, high = np.searchsorted(heads, head[t], "left"), np.searchsorted(heads, head[t], "right")
    # what the word before extends is part of a longer match, unless there is no word before
    own = head[t] * width + before[t]
    some = before[t] != 0
    inner = np.where(some, np.searchsorted(keys, own, "left"), low)
    outer = np.where(some, np.searchsorted(keys, own, "right"), low)
    lo, hi, of = np.concatenate([low, outer]), np.concatenate([inner, high]), np.concatenate([t, t])
    count = hi - lo
    test = np.repeat(of, count)
    at = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    length = _common(tables, at, test)
    return place[at] - 1, place[test] - n - 2, length


def _search(ids: list[int], passages: list[list[str]], min_words: int, shard_words: int):
    number: dict[str, int] = {}
    flat: list[int] = []
    item_of, word_of = [], []
    for item, ws in zip(ids, passages):
        for k, w in enumerate(ws):
            flat.append(number.setdefault(w, len(number) + 1))
            item_of.append(item)
            word_of.append(k)
        flat.append(0)
        item_of.append(-1)
        word_of.append(-1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests, items, offsets = np.array(flat, np.int64), np.array(item_of, np.int64), np.array(word_of, np.int64)
        get = number.get

        def shard(docs: list[int], codes: list[int], sizes: list[int]) -> pd.DataFrame:
            a, b, length = shard_matches(np.array(codes, np.int64), tests, min_words)
            start = np.concatenate([[0], np.cumsum(sizes)])
            d = np.searchsorted(start, a, "right") - 1
            return pd.DataFrame({"doc_id": np.array(docs, np.int64)[d] if len(docs) else d, "item_id": items[b], "words": length, "doc_word": a - start[d], "item_word": offsets[b]})

        docs, codes, sizes = [], [], []
        for pdf in frames:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                if len(ws) < min_words:
                    continue
                docs.append(doc)
                codes.extend([get(w, 0) for w in ws])
                codes.append(0)
                sizes.append(len(ws) + 1)
                if len(codes) >= shard_words:
                    yield shard(docs, codes, sizes)
                    docs, codes, sizes = [], [], []
        if docs:
            yield shard(docs, codes, sizes)

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, words, doc_word, item_word: the longest verbatim match of every document with every item of
    which it holds min_words successive words or more, and where it begins (in words from 0).

    The items are the stated query set: they are searched against all documents in blocks of at most TEST_WORDS words.
    NULL ids, NULL or short texts match nothing; a repeated doc_id or item_id counts as one document or item.
    """
    blocks: list[tuple[list[int], list[list[str]]]] = [([], [])]
    size = 0
    for r in items.select("item_id", "passage").filter("item_id is not null and passage is not null").toLocalIterator():
        ws = words(r["passage"])
        if len(ws) < min_words:
            continue
        if size and size + len(ws) > TEST_WORDS:
            blocks.append(([], []))
            size = 0
        blocks[-1][0].append(r["item_id"])
        blocks[-1][1].append(ws)
        size += len(ws)
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    found = None
    for ids, passages in blocks:
        part = docs.mapInPandas(_search(ids, passages, min_words, shard_words), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("words", "doc_word", "item_word"), F.struct("words", -F.col("doc_word"), -F.col("item_word"))).alias("m")).select("doc_id", "item_id", "m.words", "m.doc_word", "m.item_word")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no passage. Rows without doc_id stay."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
