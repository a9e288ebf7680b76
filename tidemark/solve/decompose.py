"""Common modes of a network: principal and independent components of the epochs x stations matrix.

The matrix stays a table of readings. For up to GRAM_STATIONS stations the sums over pairs of stations are added up over
partitions and their eigenvectors taken; for more, a subspace of a few vectors is multiplied by the matrix and its transpose, as
two grouped sums, until it holds the leading components. The rotation to independent components works on the few
component values of each epoch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeunits import seconds
from tidemark.session import materialize, sized
from tidemark.solve.fields import _sums

#: Stations up to which their square matrix is worked on in one place (2 MB).
GRAM_STATIONS = 512
#: Vectors beyond those asked for, rounds at most, and the change of the eigenvalues at which the subspace is done.
SPARE, ROUNDS, SETTLED = 8, 200, 1e-12


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(cells: DataFrame, by: str, vectors: DataFrame, p: int, other: str) -> DataFrame:
    """Per `other`: v, the array of sum(x * vector) over the readings; `vectors` has `by` and v."""
    j = cells.join(sized(vectors), by)
    out = j.groupBy(other).agg(*[F.sum(F.col("x") * F.get("v", F.lit(k))).alias(f"_{k}") for k in range(p)])
    return out.select(other, F.array(*[f"_{k}" for k in range(p)]).alias("v"))


def _inner(df: DataFrame, p: int, a: str = "v", b: str = "v") -> np.ndarray:
    """p x p sums of products; only these numbers come back."""
    r = df.agg(*[F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(j))).alias(f"{i}_{j}") for i in range(p) for j in range(p)]).first()
    return np.array([[r[f"{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])


def _turned(df: DataFrame, m: np.ndarray, key: str) -> DataFrame:
    """v times the small matrix m."""
    return df.select(key, F.array(*[sum((F.get("v", F.lit(i)) * float(m[i, j]) for i in range(len(m))), F.lit(0.0)) for j in range(m.shape[1])]).alias("v"))


def _by_gram(cells: DataFrame, names: list[str], num: int) -> tuple[np.ndarray, DataFrame]:
    s = len(names)
    at = {n: i for i, n in enumerate(names)}
    rows = cells.groupBy("t").agg(F.collect_list(F.struct("station", "x")).alias("row"))  # at most a value a station

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(pdf), s))
        for k, row in enumerate(pdf["row"]):
            for c in row:
                m[k, at[c["station"]]] = c["x"]
        return (m.T @ m).ravel()

    lam, vec = np.linalg.eigh(_sums(rows, s * s, gram).reshape(s, s))
    lam, vec = lam[::-1][:num], vec[:, ::-1][:, :num]
    return lam, cells.sparkSession.createDataFrame([(n, [float(x) for x in vec[i]]) for i, n in enumerate(names)], "station string, v array<double>")


def _by_subspace(cells: DataFrame, count: int, num: int) -> tuple[np.ndarray, DataFrame]:
    p = min(num + SPARE, count)
    start = [F.pmod(F.xxhash64("station", F.lit(k)), F.lit(1_000_003)) / 500_001.5 - 1 for k in range(p)]
    q = cells.select("station").distinct().select("station", F.array(*start).alias("v"))
    last = None
    for _ in range(ROUNDS):
        lam, u = np.linalg.eigh(_inner(q, p))
        q = materialize(_turned(q, u / np.sqrt(np.maximum(lam, lam.max() * 1e-14)), "station"), "subspace")
        y = _times(cells, "station", q, p, "t")
        z = materialize(_times(cells, "t", materialize(y, "scores"), p, "station"), "subspace")
        both = q.join(z.select("station", F.col("v").alias("z")), "station")
        lam, u = np.linalg.eigh(_inner(both, p, "v", "z"))
        lam, u = lam[::-1], u[:, ::-1]
        if last is not None and np.abs(lam - last)[:num].max() <= SETTLED * abs(lam[0]):
            break
        last, q = lam, z
    return lam[:num], _turned(q if last is None else both.select("station", "v"), u[:, :num], "station")


def _signed(vec: DataFrame, num: int) -> tuple[DataFrame, np.ndarray]:
    """The loadings turned so that the largest of each component is positive, and the signs."""
    top = vec.agg(*[F.max_by(F.get("v", F.lit(k)), F.abs(F.get("v", F.lit(k)))).alias(str(k)) for k in range(num)]).first()
    flip = np.diag([1.0 if top[k] >= 0 else -1.0 for k in range(num)])
    return _turned(vec, flip, "station"), flip


def common_modes(obs: DataFrame, column: str, num: int = 1, method: str = "pca", rounds: int = 100, seed: int = 0, detrend: bool = False, impute: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, spatial, temporal): station, t, value of the sum of `num` components; station, comp, loading; t, comp,
    value. method 'pca' or 'ica' (symmetric, log cosh). Series are taken about their means, or with `detrend` about their
    lines in time, which the model then holds; missing readings count as the mean or line. The model stands where there is
    a reading; with `impute` it keeps the readings and stands for the missing ones at the other stations' epochs between a
    station's first and last. Components are signed so that the largest loading is positive. Duplicate epochs of a station
    are averaged. With fewer than `num` stations there are as many components as stations."""
    d = obs.select("station", "t", column).dropna().groupBy("station", "t").agg(F.avg(column).alias("y"), F.any_value(seconds("t") / 86400.0).alias("day"))
    line = d.groupBy("station").agg(F.avg("y").alias("_b"), F.avg("day").alias("_d"), F.coalesce(F.regr_slope("y", "day"), F.lit(0.0)).alias("_a"), F.min("t").alias("_first"), F.max("t").alias("_last"))
    line = materialize(line if detrend else line.withColumn("_a", F.lit(0.0)), "lines")  # a row a station
    base = F.col("_b") + F.col("_a") * (F.col("day") - F.col("_d"))
    cells = materialize(d.join(sized(line), "station").select("station", "t", "day", "y", (F.col("y") - base).alias("x")), "cells")
    count = line.count()
    num = min(num, count)
    spark, kind = obs.sparkSession, obs.schema["t"].dataType.simpleString()
    if not num:
        empty = lambda schema: spark.createDataFrame([], schema)
        return empty(f"station string, t {kind}, value double"), empty("station string, comp int, loading double"), empty(f"t {kind}, comp int, value double")
    if count <= GRAM_STATIONS:
        lam, vec = _by_gram(cells, sorted(r[0] for r in line.select("station").collect()), num)
    else:
        lam, vec = _by_subspace(cells, count, num)
    vec = _signed(materialize(vec, "loadings"), num)[0]
    if method == "ica":
        n = max(cells.select("t").distinct().count(), 1)
        root = np.sqrt(np.maximum(lam / n, 1e-300))
        white = materialize(_turned(_times(cells, "station", vec, num, "t"), np.diag(1 / root), "t"), "white")
        w = _rotation(white, num, n, rounds, seed)
        turn = np.diag(root) @ w.T  # loadings of the sources
        temporal, vec = _turned(white, w.T, "t"), materialize(_turned(vec, turn, "station"), "loadings")
    else:
        temporal = _times(cells, "station", vec, num, "t")
    vec, flip = _signed(vec, num)
    temporal = materialize(_turned(temporal, flip, "t"), "temporal")
    v, y = vec.select("station", F.col("v").alias("_v")), temporal.select("t", F.col("v").alias("_y"))
    if impute:
        month = lambda t: F.date_trunc("month", t)
        spans = line.withColumn("_m", F.explode(F.sequence(month("_first"), month("_last"), F.expr("interval 1 month"))))
        grid = spans.join(y.withColumn("_m", month("t")), "_m").filter("t between _first and _last").withColumn("day", seconds("t") / 86400.0)
        every = grid.join(cells.select("station", "t", F.col("y").alias("_own")), ["station", "t"], "left").join(sized(v), "station")
        model = every.select("station", "t", F.coalesce("_own", base + _dot("_v", "_y")).alias("value"))
    else:
        mean = F.col("_a") * (F.col("day") - F.col("_d")) + F.when(F.lit(detrend), F.col("_b")).otherwise(0.0)
        model = cells.join(sized(v), "station").join(y, "t").join(sized(line), "station").select("station", "t", (_dot("_v", "_y") + mean).alias("value"))
    spatial = vec.select("station", F.posexplode("v").alias("comp", "loading"))
    return model, spatial, temporal.select("t", F.posexplode("v").alias("comp", "value"))


def _rotation(white: DataFrame, num: int, n: int, rounds: int, seed: int) -> np.ndarray:
    """The rotation that makes whitened components independent, by symmetric fixed-point steps."""
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(num, num)))[0]
    for _ in range(rounds):

        def step(p: pd.DataFrame, w=w) -> np.ndarray:
            x = np.stack(p["v"].to_numpy())
            y = np.tanh(x @ w.T)
            return np.concatenate([(y.T @ x).ravel(), (1 - y**2).sum(axis=0)])

        v = _sums(white, num * num + num, step) / n
        u, _, vt = np.linalg.svd(v[: num * num].reshape(num, num) - v[num * num :, None] * w)
        new = u @ vt
        moved = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if moved < 1e-6:
            break
    return w
