"""Sources mixed to target shares by entropy balancing.

Every document gets a rate, as near to one use as the shares allow: the entropy-balancing dual has one multiplier for
each source, and the rates tilt exponentially in the document's tokens, cut off at the source's largest number of uses.
Newton steps on the dual run over a distributed histogram of (source, tokens). Rates are rounded to copies by a hash of
the document; an offset for each source, found by narrowing bounds over all documents, brings the rounded tokens to the
target.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NEWTON, ROUNDS, POINTS, TOLERANCE = 60, 5, 15, 1e-9


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of every document; a NULL text has none. `path`: a .tiktoken vocabulary that every
    executor can read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        kept = tiktoken.__dict__.setdefault("_kept", {})  # one encoder for each worker process
        if path not in kept:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = kept[path].encode_ordinary
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def _pick(of: dict[str, float], source: Column, default: float = 0.0) -> Column:
    if not of:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(float(v)))]), source), F.lit(default))


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: doc_id, source, tokens, rate, copies for every document of a target source; copies never exceed the source's
    max_repeat. report: one row per target source with documents, tokens (its size), target_share, target_tokens,
    max_repeat, falls_short, used_tokens and actual_share of the mix. The total of the mix is the sum of the sizes. A
    source falls short where target_share x total > max_repeat x size; it then gives all it may. Documents of other or
    NULL sources take no part; targets with NULL in a field are left out. With no tokens at all, every share is NULL.
    `targets` is a table of sources, collected here; it has a row for each source, not for each document.
    """
    from tidemark.session import materialize

    want = {r["source"]: (float(r["target_share"]), int(r["max_repeat"])) for r in targets.select("source", "target_share", "max_repeat").dropna().dropDuplicates(["source"]).collect()}
    spark = documents.sparkSession
    sizes = materialize(count_tokens(documents.filter(F.col("source").isin(list(want)) if want else F.lit(False)), path), "tokens")
    hist = materialize(sizes.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    known = {r["source"]: r for r in hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("size")).collect()}
    size = {s: int(known[s]["size"]) if s in known else 0 for s in want}
    docs = {s: int(known[s]["docs"]) if s in known else 0 for s in want}
    total = sum(size.values())
    goal = {s: share * total for s, (share, _) in want.items()}
    short = {s: goal[s] > cap * size[s] for s, (_, cap) in want.items()}
    cap = {s: c for s, (_, c) in want.items()}
    unit = {s: size[s] / docs[s] if docs[s] and size[s] else 1.0 for s in want}
    free = [s for s in want if not short[s] and size[s] and goal[s] > 0]

    def rate(lam: dict[str, float]) -> Column:
        tilt = F.exp(F.least(_pick(lam, F.col("source")) * F.col("tokens") / _pick(unit, F.col("source"), 1.0), F.lit(50.0)))
        return F.when(F.col("source").isin([s for s in want if short[s]]), _pick(cap, F.col("source"))).otherwise(F.least(tilt, _pick(cap, F.col("source"))))

    # Newton with a bracket for each source: the tokens used grow with the multiplier
    lam = {s: math.log(goal[s] / size[s]) for s in free}
    low, high, open_ = {s: -60.0 for s in free}, {s: 60.0 for s in free}, set(free)
    for _ in range(NEWTON):
        if not open_:
            break
        r = rate(lam)
        weight = F.col("n") * F.col("tokens") * r
        inner = F.when(r < _pick(cap, F.col("source")), weight * F.col("tokens") / _pick(unit, F.col("source"), 1.0)).otherwise(0.0)
        got = {x["source"]: (x["f"], x["d"]) for x in hist.groupBy("source").agg(F.sum(weight).alias("f"), F.sum(inner).alias("d")).collect()}
        for s in list(open_):
            f, d = got[s][0] - goal[s], got[s][1]
            if abs(f) <= TOLERANCE * goal[s] or high[s] - low[s] < 1e-12:
                open_.discard(s)
                continue
            low[s], high[s] = (lam[s], high[s]) if f < 0 else (low[s], lam[s])
            step = lam[s] - f / d if d > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    rates = sizes.withColumn("rate", rate(lam) if want else F.lit(0.0))
    if any(g <= 0 for g in goal.values()):
        rates = rates.withColumn("rate", F.when(F.col("source").isin([s for s in want if goal[s] <= 0]), 0.0).otherwise(F.col("rate")))
    spot = (F.xxhash64("doc_id", F.lit(11)).cast("double") / F.lit(2.0**64)) + 0.5

    def copies(shift: dict[str, float]) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.floor(F.col("rate") + spot + _pick(shift, F.col("source"))).cast("double"), _pick(cap, F.col("source"))))

    lo, hi = {s: -1.0 for s in free}, {s: 1.0 for s in free}
    spread = materialize(rates.select("source", "tokens", "rate", "doc_id"), "rates")
    best = {s: (math.inf, 0.0) for s in free}
    for _ in range(ROUNDS if free else 0):  # each round tries POINTS offsets between the bounds of each source
        tried = {s: [lo[s] + (hi[s] - lo[s]) * (k + 1) / (POINTS + 1) for k in range(POINTS)] for s in free}
        sums = [F.sum(F.col("tokens") * copies({s: tried[s][k] for s in free})).alias(f"u{k}") for k in range(POINTS)]
        got = {x["source"]: x for x in spread.groupBy("source").agg(*sums).collect()}
        for s in free:
            used = [got[s][f"u{k}"] for k in range(POINTS)]
            best[s] = min([best[s], *((abs(u - goal[s]), t) for u, t in zip(used, tried[s]))])
            under = sum(u < goal[s] for u in used)
            edges = [lo[s], *tried[s], hi[s]]
            lo[s], hi[s] = edges[under], edges[under + 1]
    shift = {s: b for s, (_, b) in best.items()}
    out = spread.withColumn("copies", copies(shift).cast("int")).select("doc_id", "source", "tokens", "rate", "copies")
    used = {x["source"]: x["u"] for x in out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("u")).collect()}
    whole = sum(used.values())
    rows = [(s, docs[s], size[s], share, goal[s], c, short[s], int(used.get(s, 0)), used.get(s, 0) / whole if whole else None) for s, (share, c) in want.items()]
    kind = "source string, documents bigint, tokens bigint, target_share double, target_tokens double, max_repeat int, falls_short boolean, used_tokens bigint, actual_share double"
    return out, spark.createDataFrame(rows, kind)
