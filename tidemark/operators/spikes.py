"""Spikes, stuck values and impossible readings, relative to each series' own behaviour.

Every reading gets a deviation: how far it lies beyond the course of its series on both sides, with at most two
successors, which is to say how fast the series leaves its course and returns. Quantile sketches (KLL) of the readings'
distance from the course are built per series, data column and hour context on every partition and merged; a deviation
outside their interquartile fences, expanded to six times the usual scatter, is a spike. A context with few readings
leans on the whole series. Stuck values are runs without variance. Series are worked on in blocks (see blocks.py), so a
hot one is spread over many tasks; readings are shuffled once for order, and once more by their deviations alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeunits import seconds
from tidemark.operators.blocks import BLOCK_ROWS, ordered_blocks, starts, whole_groups
from tidemark.operators.units import decide_units
from tidemark.session import materialize, sized

DATA, VARS = ["east", "north", "up"], ["east_var", "north_var", "up_var"]
SKETCH_K, CONTEXTS = 400, 4
#: Readings of the whole series that a context is averaged with.
LEAN = 200.0
#: Half the interquartile range of a normal distribution; the expansion of the fences that puts them at six scatters.
QUARTILE = 0.6744897501960817
FENCE_IQR = (6.0 - QUARTILE) / (2 * QUARTILE)
LONGEST, COURSE, BOTH_SIDES = 3, 8, 2
STUCK = 6
LIMIT_UM, VAR_RATIO = 100e6, 25.0
SCORES = "series_id bigint, block int, hour int, obs_id bigint, " + ", ".join(f"{k}_{c} {t}" for c in DATA for k, t in (("off", "float"), ("dev", "float"), ("stuck", "boolean")))


def _course(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value its place in an array where the groups are parted by NaN; the median of the COURSE values from
    each place on; how many values that median has."""
    pad = COURSE + LONGEST
    place = np.arange(len(x)) + pad * (np.cumsum(starts(group)) if len(x) else np.zeros(0, int))
    long = np.full((place[-1] + 1 if len(x) else 0) + 2 * pad, np.nan)
    long[place] = x
    win = np.sort(np.lib.stride_tricks.sliding_window_view(long, COURSE), axis=1)  # NaN last
    k = (~np.isnan(win)).sum(axis=1)
    i = np.arange(len(win))
    med = (win[i, np.maximum(k - 1, 0) // 2] + win[i, np.minimum(k // 2, COURSE - 1)]) / 2
    return place, np.where(k >= BOTH_SIDES, med, np.nan), long


def deviations(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value: its distance from the course (NaN where a side is missing); its deviation, the largest distance by
    which an excursion of at most LONGEST values that it is part of stays beyond the course on both sides (positive
    above, negative below, NaN for none); and the courses before and after that excursion, as (lower, upper)."""
    n = len(x)
    off, dev, low, high = (np.full(n, np.nan) for _ in range(4))
    if not n:
        return off, dev, low, high
    place, med, long = _course(x, group)
    before = med[place - COURSE]
    off = x - (before + med[place + 1]) / 2
    best = np.zeros(n)
    with np.errstate(invalid="ignore", over="ignore"):
        for length in range(1, LONGEST + 1):
            after = med[place + length]
            top, bottom = np.maximum(before, after), np.minimum(before, after)
            run = np.stack([long[place + k] for k in range(length)])
            up, down = (run - top).min(axis=0), (bottom - run).min(axis=0)
            size = np.where(up > 0, up, np.where(down > 0, -down, 0.0))
            size[np.isnan(up) | np.isnan(down)] = 0.0
            for k in range(length):
                to = np.flatnonzero(size != 0)
                to = to[np.abs(size[to]) > best[to + k]]
                best[to + k] = np.abs(size[to])
                dev[to + k], low[to + k], high[to + k] = size[to], bottom[to], top[to]
    return off, dev, low, high


def stuck_in(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which values stand in a run of STUCK or more equal ones."""
    if not len(x):
        return np.zeros(0, bool)
    new = starts(x, group)
    run = np.cumsum(new) - 1
    return np.bincount(run)[run] >= STUCK


def _score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scores of every core reading. A copy of an epoch is measured against the excursion of its first reading."""
    for pdf in whole_groups(frames, ["series_id", "block"]):
        sid, sec, core = pdf["series_id"].to_numpy(np.int64), pdf["sec"].to_numpy(np.int64), pdf["core"].to_numpy(bool)
        group = np.cumsum(starts(sid, pdf["block"].to_numpy()))
        out = pdf[["series_id", "block", "obs_id"]].copy()
        out["hour"] = (sec % 86400 * CONTEXTS // 86400).astype(np.int32)
        for c in DATA:
            x = pdf[c].to_numpy(float)
            has = np.flatnonzero(~np.isnan(x))
            first = starts(group[has], sec[has])
            head = has[first]
            off, dev, low, high = deviations(x[head], group[head])
            stuck = stuck_in(x[head], group[head])
            of = np.cumsum(first) - 1  # the first reading that each reading is, or is a copy of
            v, own = x[has], dev[of]
            with np.errstate(invalid="ignore", over="ignore"):
                beyond = np.where(own > 0, np.minimum(own, v - high[of]), np.maximum(own, v - low[of]))
                beyond = np.where(np.sign(beyond) == np.sign(own), beyond, np.nan)
            cols = {f"off_{c}": np.full(len(x), np.nan, np.float32), f"dev_{c}": np.full(len(x), np.nan, np.float32), f"stuck_{c}": np.zeros(len(x), bool)}
            cols[f"off_{c}"][head] = off
            cols[f"dev_{c}"][has] = beyond
            cols[f"stuck_{c}"][has] = stuck[of] & (v == x[head][of])
            for k, a in cols.items():
                out[k] = a
        yield out[core]


def _fences(scores: DataFrame) -> DataFrame:
    """Per series: scatter_<column> (robust standard deviation around the course) and, for each hour context, low_ and
    high_<column>_<hour>."""
    sketch = lambda c, h: F.kll_sketch_agg_float(F.when((F.col("hour") == h) & ~F.isnan(f"off_{c}"), F.col(f"off_{c}")), SKETCH_K)
    per = scores.groupBy("series_id").agg(*[sketch(c, h).alias(f"k_{c}_{h}") for c in DATA for h in range(CONTEXTS)])
    for c in DATA:
        whole = F.col(f"k_{c}_0")
        for h in range(1, CONTEXTS):
            whole = F.kll_sketch_merge_float(whole, F.col(f"k_{c}_{h}"))
        per = per.withColumn(f"k_{c}", whole)
    n = lambda k: F.kll_sketch_get_n_float(k)
    q = lambda k, p: F.when(n(k) > 0, F.kll_sketch_get_quantile_float(k, F.lit(float(p))).cast("double"))
    quart = per.select("series_id", *[x for c in DATA for k in (f"k_{c}", *(f"k_{c}_{h}" for h in range(CONTEXTS))) for x in (n(k).cast("double").alias(f"n_{k}"), q(k, 0.25).alias(f"a_{k}"), q(k, 0.75).alias(f"b_{k}"))])

    def leaned(side: str, c: str, h: int) -> Column:
        w = F.col(f"n_k_{c}_{h}") / (F.col(f"n_k_{c}_{h}") + LEAN)
        return w * F.coalesce(f"{side}_k_{c}_{h}", F.lit(0.0)) + (1 - w) * F.col(f"{side}_k_{c}")

    cols = [((F.col(f"b_k_{c}") - F.col(f"a_k_{c}")) / (2 * QUARTILE)).alias(f"scatter_{c}") for c in DATA]
    for c in DATA:
        for h in range(CONTEXTS):
            a, b = leaned("a", c, h), leaned("b", c, h)
            cols += [(a - FENCE_IQR * (b - a)).alias(f"low_{c}_{h}"), (b + FENCE_IQR * (b - a)).alias(f"high_{c}_{h}")]
    return quart.select("series_id", *cols)


def _listed(cols: str, c: str) -> Column:
    return F.array_contains(F.split(F.regexp_replace(F.coalesce(cols, F.lit("")), r"\s", ""), ","), c)


def implausible(obs: DataFrame, series: DataFrame, units: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faulty readings: obs_id, series_id, col_name, reason ('limit', 'spike', 'stuck', 'variance'); one row for each
    reading and reason, repeated rows of `obs` counting once.

    limit: a data value of 100 m or more in size. spike: a deviation (see `deviations`) outside the fences of its series
    and hour context. stuck: a run of six or more equal values at successive epochs, copies and epochs without value
    passed over. variance: zero or less, or more than 25 times the column's median in the series. A copy of an epoch is
    faulty if it equals a faulty reading, or lies beyond the fences itself where its first reading does. Only columns in the
    series' own data_cols and var_cols are judged; NULL and NaN never are; rows without obs_id or of an unknown series
    are left out. Series without scatter have no spikes.
    `units`: series_id, um_per_unit; found from notes, unit fields and numbers where not given. `block_rows`: readings of
    a series up to which it stays whole; a longer one is cut into blocks with halos of at least block_rows / 33 readings,
    which must exceed the 17 that the checks look at, and the course next to a cut is taken from those.
    """
    if block_rows < 600:
        raise ValueError("block_rows must be 600 or more")
    value = {c: F.when(~F.isnan(c), F.col(c)) for c in DATA}
    readings = (
        obs.select("series_id", "obs_id", seconds("t").alias("sec"), *[v.alias(c) for c, v in value.items()])
        .filter("series_id is not null and sec is not null and coalesce(east, north, up) is not null")
    )
    blocks = ordered_blocks(readings, "series_id", "sec", counted=obs.select("series_id"), block_rows=block_rows)
    order = ["series_id", "block", "sec", F.col("obs_id").asc_nulls_last()]
    scores = materialize(blocks.repartition("series_id", "block").sortWithinPartitions(*order).mapInPandas(_score, SCORES), "scores")
    fences = materialize(_fences(scores), "fences")  # a row for each series
    if units is None:
        units = decide_units(series, fences.select("series_id", (F.col("scatter_east") * 2**0.5).alias("delta")))
    known = series.filter("series_id is not null").dropDuplicates(["series_id"])
    known = known.select("series_id", *[_listed("data_cols", c).alias(f"is_{c}") for c in DATA], *[_listed("var_cols", c).alias(f"is_{c}") for c in VARS])
    # spikes and stuck values: every reading meets the fences of its context; the key holds the block, so that none is hot
    per_hour = F.array(*[F.struct(F.lit(h).alias("hour"), *[F.col(f"{side}_{c}_{h}").cast("float").alias(f"{side}_{c}") for c in DATA for side in ("low", "high")]) for h in range(CONTEXTS)])
    ruled = (
        fences.join(known.select("series_id", *[f"is_{c}" for c in DATA]), "series_id")
        .join(scores.select("series_id", "block").distinct(), "series_id")
        .select("series_id", "block", *[f"is_{c}" for c in DATA], F.explode(per_hour).alias("f"))
        .select("series_id", "block", "f.*", *[f"is_{c}" for c in DATA])
    )
    seen = [x for c in DATA for x in (F.when(~F.isnan(f"dev_{c}"), F.col(f"dev_{c}")).alias(f"dev_{c}"), f"stuck_{c}")]
    suspects = scores.filter(F.col("obs_id").isNotNull()).select("series_id", "block", "hour", "obs_id", *seen).filter(" or ".join(f"dev_{c} is not null or stuck_{c}" for c in DATA))
    near = suspects.join(ruled.hint("merge"), ["series_id", "block", "hour"])

    def course_reasons(c: str) -> Column:
        outside = (F.col(f"high_{c}") > F.col(f"low_{c}")) & ((F.col(f"dev_{c}") > F.col(f"high_{c}")) | (F.col(f"dev_{c}") < F.col(f"low_{c}")))
        pair = lambda why: F.struct(F.lit(c).alias("col_name"), F.lit(why).alias("reason"))
        return F.array(F.when(F.col(f"is_{c}") & outside, pair("spike")), F.when(F.col(f"is_{c}") & F.col(f"stuck_{c}"), pair("stuck")))

    by_course = near.withColumn("_x", F.explode(F.filter(F.concat(*[course_reasons(c) for c in DATA]), lambda x: x.isNotNull()))).select("obs_id", "series_id", "_x.col_name", "_x.reason")
    # limits and variances need no neighbours
    var_medians = obs.groupBy("series_id").agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(c), F.col(c)), SKETCH_K).alias(c) for c in VARS])
    median = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(0.5)))
    var_medians = var_medians.select("series_id", *[median(c).alias(f"most_{c}") for c in VARS])
    um, rule = F.col("um_per_unit"), known.join(units.select("series_id", "um_per_unit"), "series_id", "left").join(var_medians, "series_id", "left")
    mask = sum((F.col(f"is_{c}").cast("int") * 2**k for k, c in enumerate(DATA)), F.lit(0))
    rule = materialize(rule.select("series_id", (LIMIT_UM / um).alias("_limit"), mask.alias("_mask"), *[F.when(F.col(f"is_{c}"), VAR_RATIO * F.col(f"most_{c}")).alias(f"most_{c}") for c in VARS]), "rules")

    def alone_bad(c: str) -> Column:
        if c in DATA:
            bad = (F.col("_mask").bitwiseAND(2 ** DATA.index(c)) != 0) & (F.abs(c) >= F.col("_limit"))
        else:
            bad = F.col(f"most_{c}").isNotNull() & ((F.col(c) <= 0) | (F.col(c) > F.col(f"most_{c}")))
        return F.when(bad & ~F.isnan(c), F.lit(c))

    alone = (
        obs.select("obs_id", "series_id", *DATA, *VARS)
        .filter("obs_id is not null")
        .join(sized(rule), "series_id")
        .withColumn("col_name", F.explode(F.filter(F.array(*[alone_bad(c) for c in DATA + VARS]), lambda x: x.isNotNull())))
        .select("obs_id", "series_id", "col_name", F.when(F.col("col_name").isin(DATA), "limit").otherwise("variance").alias("reason"))
    )
    return by_course.unionByName(alone).distinct()
