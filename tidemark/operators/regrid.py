"""Irregular readings onto a regular grid, holes filled by low-rank factorisation or marked.

The grid of one sampling interval is a source-by-time matrix, seen through windows of consecutive slots. In every window
alternating least squares fits a low-rank model to the observed cells of all series that reach into it; a hole takes the
model's value if enough other series and enough of its own readings support it, and is marked otherwise. Observed cells
are never changed.

A window of at most `tile_cells` cells is solved by one task. A larger one is split by series into parts of about that
size: a series' factors need its own row only, and the factors of the times follow from sums over the series, which are
added up over the parts in each round. The fill is the same however a window is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeunits import seconds
from tidemark.operators.blocks import starts, whole_groups
from tidemark.session import materialize, sized

DATA = ["east", "north", "up"]
WINDOW, TILE_CELLS = 32, 250_000
PARTS = "step_s bigint, win bigint, part bigint, series array<bigint>, lo array<bigint>, hi array<bigint>, has array<int>, cells binary"
#: Cell states in the result: the reading itself, a value from the factorisation, a hole without support, and a column
#: that the series does not have.
OBSERVED, FILLED, MARKED, ABSENT = 0, 1, 2, 3
#: RIDGE: how many times the variance left by the fit its factors are drawn to zero.
ROUNDS, RANK, RIDGE = 8, 2, 10.0
GRID = "series_id bigint, slot bigint, empty boolean, " + ", ".join(f"{c} double, {c}_state tinyint" for c in DATA)


def slot_readings(obs: DataFrame, series: DataFrame) -> DataFrame:
    """series_id, step_s, slot and the data columns of every row with a reading. Only columns in the series' own
    data_cols count; NULL and NaN are no readings. Series whose step_s is NULL or not positive have no grid and are
    left out."""
    own = series.filter("series_id is not null and step_s > 0").dropDuplicates(["series_id"])
    own = own.select("series_id", F.col("step_s").cast("bigint").alias("step_s"), *[F.array_contains(F.split(F.regexp_replace(F.coalesce("data_cols", F.lit("")), r"\s", ""), ","), c).alias(f"_{c}") for c in DATA])
    cols = {c: F.when(F.col(f"_{c}") & ~F.isnan(c), F.col(c)) for c in DATA}
    return (
        obs.select("series_id", seconds("t").alias("sec"), *DATA)
        .filter("sec is not null")
        .join(sized(own), "series_id")
        .select("series_id", "step_s", F.floor(F.col("sec") / F.col("step_s")).cast("bigint").alias("slot"), *[v.alias(c) for c, v in cols.items()])
        .filter(F.coalesce(*DATA).isNotNull())
    )


# --- alternating least squares, in pieces that add up over parts ---


def _scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each source's readings about its median in units of its spread (0 where there are none; clipped, so that faulty
    ones do not bend the courses), the mask of readings, medians and spreads."""
    seen = ~np.isnan(values)
    with np.errstate(all="ignore"):
        mid = _nanmedian_rows(values)
        spread = 1.4826 * _nanmedian_rows(np.abs(values - mid[:, None]))
        spread = np.where((spread > 0) & np.isfinite(spread), spread, 1.0)
        z = np.where(seen, np.clip((values - mid[:, None]) / spread[:, None], -12, 12), 0.0)
    return z, seen.astype(float), mid, spread


def _first_sums(z: np.ndarray, m: np.ndarray) -> np.ndarray:
    """times x 2: sum and number of the readings."""
    return np.column_stack([z.sum(axis=0), m.sum(axis=0)])


def _first_courses(sums: np.ndarray) -> np.ndarray:
    """times x (RANK + 1): the first course starts at the mean over sources, the second at a line, further ones at noise;
    the last column is the ridge."""
    y = np.random.default_rng(7).normal(0, 0.1, (len(sums), RANK + 1))
    y[:, 0] = sums[:, 0] / np.maximum(sums[:, 1], 1)
    if RANK > 1:
        y[:, 1] = np.linspace(-1, 1, len(sums))
    y[:, RANK] = RIDGE
    return y


def _pairs(f: np.ndarray) -> np.ndarray:
    return (f[:, :, None] * f[:, None, :]).reshape(len(f), -1)


def _solved(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    k = b.shape[1]
    return np.linalg.solve(a.reshape(-1, k, k) + ridge * np.eye(k), b[:, :, None])[:, :, 0]


def _with_offset(y: np.ndarray) -> np.ndarray:
    return np.column_stack([y[:, :RANK], np.ones(len(y))])


def _sources(z: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The loadings and the offset of each source, given the courses."""
    f = _with_offset(y)
    return _solved(m @ _pairs(f), z @ f, y[0, RANK])


def _time_sums(z: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """times x (RANK² + RANK + 2): the normal equations of the courses; squares left by the present ones, and readings."""
    load = x[:, :RANK]
    left = m * (z - x @ _with_offset(y).T)
    return np.column_stack([m.T @ _pairs(load), (z - m * x[:, RANK:]).T @ load, (left**2).sum(axis=0), m.sum(axis=0)])


def _courses(sums: np.ndarray) -> np.ndarray:
    ridge = max(RIDGE * sums[:, -2].sum() / max(sums[:, -1].sum(), 1.0), 0.01)
    y = _solved(sums[:, : RANK * RANK], sums[:, RANK * RANK : -2], ridge)
    return np.column_stack([y, np.full(len(y), ridge)])


def _model(mid: np.ndarray, spread: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mid[:, None] + spread[:, None] * (x @ _with_offset(y).T)


def als(values: np.ndarray) -> np.ndarray:
    """Low-rank fit of a sources x times matrix with NaN holes: each source has its offset and its loadings on RANK
    common courses."""
    z, m, mid, spread = _scaled(values)
    y = _first_courses(_first_sums(z, m))
    for _ in range(ROUNDS - 1):
        y = _courses(_time_sums(z, m, _sources(z, m, y), y))
    return _model(mid, spread, _sources(z, m, y), y)


def _nanmedian_rows(a: np.ndarray) -> np.ndarray:
    s = np.sort(a, axis=1)  # NaN last
    k = (~np.isnan(a)).sum(axis=1)
    i = np.arange(len(a))
    return np.where(k > 0, (s[i, np.maximum(k - 1, 0) // 2] + s[i, np.minimum(k // 2, a.shape[1] - 1)]) / 2, np.nan)


# --- tiles ---


def _tiles(pdf: pd.DataFrame, window: int) -> Iterator[tuple[tuple, dict]]:
    """(step_s, win, part) and the content of each tile of a frame in which a segment's span row comes before its cells:
    series, lo, hi, has (bits of the columns it has), and cells, columns x segments x window with NaN holes."""
    span = pdf["lo"].notna().to_numpy()
    seg = np.cumsum(span) - 1
    head, cells = pdf[span], pdf[~span]
    keys = [head[k].to_numpy(np.int64) for k in ("step_s", "win", "part")]
    first = np.flatnonzero(starts(*keys))
    last = np.append(first[1:], len(head))
    lo, hi, series = (head[k].to_numpy(np.int64) for k in ("lo", "hi", "series_id"))
    has = sum(head[f"has_{c}"].to_numpy(bool).astype(np.int32) << k for k, c in enumerate(DATA))
    of, slot = seg[~span], cells["slot"].to_numpy(np.int64)
    values = cells[DATA].to_numpy(float)
    bounds = np.searchsorted(of, np.append(first, len(head)))
    for a, b, p, q in zip(first, last, bounds[:-1], bounds[1:]):
        box = np.full((len(DATA), b - a, window), np.nan)
        box[:, of[p:q] - a, slot[p:q] - keys[1][a] * window] = values[p:q].T
        yield tuple(k[a] for k in keys), {"series": series[a:b], "lo": lo[a:b], "hi": hi[a:b], "has": has[a:b], "cells": box}


def _rows(tile: dict, win: int, window: int, fitted) -> pd.DataFrame:
    """The grid rows of a tile. `fitted`(column number, values) gives the model of a column and the number of readings in
    each slot over all series, or None if there is nothing to fit."""
    lo, hi = tile["lo"] - win * window, tile["hi"] - win * window
    inside = (np.arange(window) >= lo[:, None]) & (np.arange(window) <= hi[:, None])
    r, k = np.nonzero(inside)
    out = {"series_id": tile["series"][r], "slot": k + win * window, "empty": np.isnan(tile["cells"]).all(axis=0)[r, k]}
    for j, c in enumerate(DATA):
        values = tile["cells"][j]
        hole = np.isnan(values) & inside
        has = (tile["has"] >> j & 1).astype(bool)
        state = np.where(hole, MARKED, OBSERVED).astype(np.int8)
        got = fitted(j, values) if hole[has].any() else None
        if got is not None:
            fill = hole & got[1]
            values = np.where(fill, got[0], values)
            state[fill] = FILLED
        out[c] = values[r, k]
        out[f"{c}_state"] = np.where(has[r], state[r, k], ABSENT).astype(np.int8)
    return pd.DataFrame(out)


def _supported(values: np.ndarray, in_slot: np.ndarray, others: int, own: int) -> np.ndarray:
    return (in_slot >= others) & ((~np.isnan(values)).sum(axis=1) >= own)[:, None]


def _fill(window: int, others: int, own: int):
    """Windows that are one tile. All segments of a batch are laid end to end; only tiles with enough series are looped over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, ["step_s", "win", "part"]):
            span = pdf["lo"].notna().to_numpy()
            seg = np.cumsum(span) - 1  # a segment's span row comes before its cells
            head, cells = pdf[span], pdf[~span]
            step, win, lo, hi = (head[k].to_numpy(np.int64) for k in ("step_s", "win", "lo", "hi"))
            offset = np.concatenate([[0], np.cumsum(hi - lo + 1)])
            of = np.repeat(np.arange(len(lo)), hi - lo + 1)
            slot = np.arange(offset[-1]) - offset[of] + lo[of]
            at = offset[seg[~span]] + cells["slot"].to_numpy(np.int64) - lo[seg[~span]]
            values = np.full((len(DATA), offset[-1]), np.nan)
            values[:, at] = cells[DATA].to_numpy(float).T
            out = {"series_id": head["series_id"].to_numpy(np.int64)[of], "slot": slot, "empty": np.isnan(values).all(axis=0)}
            first = np.flatnonzero(starts(step, win))
            last = np.append(first[1:], len(lo))
            wide = last - first > others
            for c, v in zip(DATA, values):
                has = head[f"has_{c}"].to_numpy(bool)
                hole = np.isnan(v)
                state = np.where(hole, MARKED, OBSERVED).astype(np.int8)
                for a, b in zip(first[wide], last[wide]):
                    cut = slice(offset[a], offset[b])
                    if not (hole[cut] & has[of[cut]]).any():
                        continue
                    mat = np.full((b - a, window), np.nan)
                    r, k = of[cut] - a, slot[cut] - win[a] * window
                    mat[r, k] = v[cut]
                    fill = hole[cut] & _supported(mat, (~np.isnan(mat)).sum(axis=0), others, own)[r, k]
                    if fill.any():
                        v[cut] = np.where(fill, als(mat)[r, k], v[cut])
                        state[cut][fill] = FILLED
                out[c] = v
                out[f"{c}_state"] = np.where(has[of], state, ABSENT).astype(np.int8)
            yield pd.DataFrame(out)

    return run


def _fill_split(tiles: DataFrame, window: int, others: int, own: int) -> DataFrame:
    """Windows of several tiles: in each round every part adds to the sums of its window's times."""
    shape = (len(DATA), window)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(frames, ["step_s", "win", "part"]):
            for key, tile in _tiles(pdf, window):
                yield pd.DataFrame([(*key, tile["series"], tile["lo"], tile["hi"], tile["has"], tile["cells"].tobytes())], columns=[x.split()[0] for x in PARTS.split(", ")])

    parts = materialize(tiles.mapInPandas(pack, PARTS), "parts")  # a row holds about tile_cells cells

    def cells_of(blob: bytes) -> np.ndarray:
        box = np.frombuffer(blob)
        return box.reshape(len(DATA), -1, window)

    def summed(df: DataFrame, rows) -> DataFrame:
        """step_s, win, sums: rows(cells, state) added up over the parts of each window."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in frames:
                for k, blob in enumerate(pdf["cells"]):
                    key = pdf["step_s"].iloc[k], pdf["win"].iloc[k]
                    held[key] = held.get(key, 0) + rows(cells_of(blob), np.asarray(pdf["state"].iloc[k]) if "state" in pdf else None)
            yield pd.DataFrame([(*k, v.ravel()) for k, v in held.items()], columns=["step_s", "win", "v"])

        each = df.mapInPandas(run, "step_s bigint, win bigint, v array<double>").select("step_s", "win", F.posexplode("v").alias("i", "v"))
        each = each.groupBy("step_s", "win", "i").agg(F.sum("v").alias("v"))
        return each.groupBy("step_s", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums"))

    def stepped(sums: DataFrame, then, name: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = [np.stack([then(x) for x in np.asarray(v, float).reshape(*shape, -1)]).ravel() for v in pdf["sums"]]
                yield pdf[["step_s", "win"]].assign(state=out)

        return materialize(sums.mapInPandas(run, "step_s bigint, win bigint, state array<double>"), name)

    first = summed(parts, lambda box, _: np.stack([_first_sums(*_scaled(v)[:2]) for v in box]))
    first = materialize(first, "slots")
    state = stepped(first, _first_courses, "courses")

    def round_sums(box: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for v, c in zip(box, y.reshape(*shape, RANK + 1)):
            z, m, _, _ = _scaled(v)
            out.append(_time_sums(z, m, _sources(z, m, c), c))
        return np.stack(out)

    for _ in range(ROUNDS - 1):
        state = stepped(summed(parts.join(sized(state), ["step_s", "win"]), round_sums), _courses, "courses")
    ready = parts.join(sized(state), ["step_s", "win"]).join(sized(first), ["step_s", "win"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                y, n = np.asarray(r.state).reshape(*shape, RANK + 1), np.asarray(r.sums).reshape(*shape, 2)[:, :, 1]

                def fitted(j: int, values: np.ndarray, y=y, n=n):
                    z, m, mid, spread = _scaled(values)
                    return _model(mid, spread, _sources(z, m, y[j]), y[j]), _supported(values, n[j], others, own)

                tile = {"series": r.series, "lo": r.lo, "hi": r.hi, "has": r.has, "cells": cells_of(r.cells)}
                yield _rows(tile, r.win, window, fitted)

    return ready.mapInPandas(run, GRID)


def _grid(cells: DataFrame, spans: DataFrame, window: int, tile_cells: int, others: int, own: int) -> DataFrame:
    win = lambda c: F.floor(F.col(c) / window).cast("bigint")
    segments = (
        spans.withColumn("win", F.explode(F.sequence(win("first"), win("last"))))
        .withColumn("lo", F.greatest("first", F.col("win") * window))
        .withColumn("hi", F.least("last", (F.col("win") + 1) * window - 1))
    )
    # only windows above the limit are split: at most (all cells) / tile_cells of them
    large = segments.groupBy("step_s", "win").agg((F.count("*") * window).alias("n")).filter(F.col("n") > tile_cells)
    large = materialize(large.select("step_s", "win", F.ceil(F.col("n") / tile_cells).cast("bigint").alias("parts")), "large")
    keys = ["step_s", "win", "series_id"]
    none = lambda kind: F.lit(None).cast(kind)
    both = segments.select(*keys, none("bigint").alias("slot"), *[none("double").alias(c) for c in DATA], "lo", "hi", *[f"has_{c}" for c in DATA]).unionByName(
        cells.withColumn("win", win("slot")).select(*keys, "slot", *DATA, none("bigint").alias("lo"), none("bigint").alias("hi"), *[none("boolean").alias(f"has_{c}") for c in DATA])
    )

    def laid(df: DataFrame) -> DataFrame:
        return df.repartition("step_s", "win", "part").sortWithinPartitions("step_s", "win", "part", "series_id", F.col("lo").isNull(), "slot")

    if large.isEmpty():
        return laid(both.withColumn("part", F.lit(0).cast("bigint"))).mapInPandas(_fill(window, others, own), GRID)
    split = both.join(sized(large), ["step_s", "win"]).withColumn("part", F.pmod(F.xxhash64("series_id"), F.col("parts"))).drop("parts")
    whole = both.join(sized(large.drop("parts")), ["step_s", "win"], "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    return laid(whole).mapInPandas(_fill(window, others, own), GRID).unionByName(_fill_split(laid(split), window, others, own))


def _cells(obs: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    readings = slot_readings(obs, series)
    cells = readings.groupBy("series_id", "step_s", "slot").agg(*[F.avg(c).alias(c) for c in DATA])
    spans = readings.groupBy("series_id", "step_s").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), *[(F.count(c) > 0).alias(f"has_{c}") for c in DATA])
    return cells, materialize(spans, "spans")  # a row for each series


def regular_grid(obs: DataFrame, series: DataFrame, window: int = WINDOW, tile_cells: int = TILE_CELLS, others: int = 3, own: int = 8) -> DataFrame:
    """One row for every step_s period of each series from its first to its last one with a reading: series_id, slot,
    empty (no reading in any of its columns) and, for east, north and up, the value and its state (OBSERVED, FILLED,
    MARKED or ABSENT). A hole is filled if at least `others` other series have a reading in its slot and its own series
    at least `own` in its window; MARKED and ABSENT cells are NaN. `tile_cells` bounds what a task holds and changes no
    value. An empty table gives an empty grid."""
    return _grid(*_cells(obs, series), window, tile_cells, others, own)


def held_out(obs: DataFrame, series: DataFrame, one_in: int = 20, **kw) -> DataFrame:
    """How well the factorisation fills: about one in `one_in` of the cells inside each series' span, chosen by a hash, are
    hidden, filled from the rest and compared. step_s, col_name, hidden, filled, error (median absolute error of the
    filled in units of the series' scatter about its median; 1 is what the median itself would give)."""
    cells, spans = _cells(obs, series)
    ends = spans.select("series_id", F.col("first").alias("_first"), F.col("last").alias("_last"))
    hide = (F.pmod(F.xxhash64("series_id", "slot"), F.lit(one_in)) == 0) & (F.col("slot") > F.col("_first")) & (F.col("slot") < F.col("_last"))
    cells = cells.join(sized(ends), "series_id").withColumn("_hide", hide)
    grid = _grid(cells.filter(~F.col("_hide")), spans, kw.pop("window", WINDOW), kw.pop("tile_cells", TILE_CELLS), kw.pop("others", 3), kw.pop("own", 8))
    got = grid.select("series_id", "slot", *[F.col(c).alias(f"_{c}") for c in DATA], *[f"{c}_state" for c in DATA])
    parts = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).alias("value"), F.col(f"_{c}").alias("fill"), F.col(f"{c}_state").alias("state")) for c in DATA])
    each = cells.filter("_hide").join(got, ["series_id", "slot"]).select("series_id", "step_s", F.explode(parts).alias("x")).select("series_id", "step_s", "x.*").filter("value is not null and state <> 3")
    scatter = each.groupBy("series_id", "col_name").agg(F.percentile_approx("value", 0.5, 1000).alias("_mid"))
    each = each.join(scatter, ["series_id", "col_name"]).withColumn("_filled", F.col("state") == FILLED)
    off, base = F.abs(F.col("fill") - F.col("value")), F.abs(F.col("value") - F.col("_mid"))
    by = each.groupBy("series_id", "step_s", "col_name").agg(F.count("*").alias("hidden"), F.count_if("_filled").alias("filled"), F.percentile_approx(F.when(F.col("_filled"), off), 0.5, 1000).alias("_off"), F.percentile_approx(base, 0.5, 1000).alias("_base"))
    ratio = F.when(F.col("_base") > 0, F.col("_off") / F.col("_base"))
    return by.groupBy("step_s", "col_name").agg(F.sum("hidden").alias("hidden"), F.sum("filled").alias("filled"), F.percentile_approx(ratio, 0.5, 1000).alias("error"))


def long_grid(grid: DataFrame, series: DataFrame) -> DataFrame:
    """The grid with one row per series, slot and data column: series_id, slot, t, col_name, value, state
    ('observed', 'filled' or 'marked'; value NULL if marked)."""
    names = F.array(*[F.lit(x) for x in ("observed", "filled", "marked")])
    step = series.filter("series_id is not null").dropDuplicates(["series_id"]).select("series_id", "step_s")
    parts = F.array(*[F.struct(F.lit(c).alias("col_name"), F.when(~F.isnan(c), F.col(c)).alias("value"), F.col(f"{c}_state").cast("int").alias("state")) for c in DATA])
    return (
        grid.join(sized(step), "series_id")
        .withColumn("x", F.explode(parts))
        .filter(F.col("x.state") != ABSENT)
        .select("series_id", "slot", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, slot * step_s)").alias("t"), "x.col_name", "x.value", F.element_at(names, F.col("x.state") + 1).alias("state"))
    )
