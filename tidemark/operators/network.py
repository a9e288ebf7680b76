"""Operators across stations: neighbours, weighted medians, matrices, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize, sized

#: Fixed value: mean earth radius in kilometres.
EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def neighbours(stations: DataFrame, radius_km: float, of: DataFrame | None = None) -> DataFrame:
    """Pairs (station, other, km) of stations not farther apart than radius_km, itself with km 0 included; with `of`
    (station) only its stations come first.

    Stations meet in cubes as wide as the radius, each looking into its own and the 26 around it, so pairs beyond the
    radius are only formed within neighbouring cubes. Stations without a position are left out."""
    st = stations.select("station", "lat", "lon").dropna().dropDuplicates(["station"])
    size = max(radius_km, 1.0)
    la, lo = F.radians("lat"), F.radians("lon")
    xyz = {"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)}
    st = st.withColumns({k: F.floor(v * EARTH_KM / size).cast("int") for k, v in xyz.items()})
    near = st
    for k in xyz:
        near = near.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    near = near.select(F.col("station").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), *xyz)
    if of is not None:
        st = st.join(of.select("station").distinct(), "station", "left_semi")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))
    return st.join(near, list(xyz)).withColumn("km", km).filter(F.col("km") <= radius_km).select("station", "other", "km")


def nearest_mean_distance(pairs: DataFrame, k: int) -> DataFrame:
    """Mean distance of each station to its k nearest other stations among `pairs`."""
    w = Window.partitionBy("station").orderBy("km", "other")
    return pairs.filter("station <> other").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy("station").agg(F.avg("km").alias("mean_km"))


#: Half the way around the earth and a little more.
EVERYWHERE_KM = 20_100.0


def nearest_k(stations: DataFrame, k: int) -> DataFrame:
    """station, mean_km: the mean distance to the k nearest other stations, or to all if there are fewer. The radius
    begins at the mean spacing and doubles for the stations that have not found k others within it, so that only pairs of a
    size near k are formed for each."""
    st = materialize(stations.select("station", "lat", "lon").dropna().dropDuplicates(["station"]), "stations")
    n = st.count()
    radius = min(EVERYWHERE_KM, 2 * EARTH_KM * (2 * (k + 1) / max(n, 1)) ** 0.5)
    left, found = st.select("station"), None
    while True:
        near = neighbours(st, radius, left).filter("station <> other")
        counted = materialize(near.withColumn("_r", F.row_number().over(Window.partitionBy("station").orderBy("km", "other"))).filter(F.col("_r") <= k).groupBy("station").agg(F.avg("km").alias("mean_km"), F.count("*").alias("_n")), "nearest")
        last = radius >= EVERYWHERE_KM
        done = counted if last else counted.filter(F.col("_n") >= k)
        found = done if found is None else found.unionByName(done)
        left = materialize(left.join(done, "station", "left_anti"), "left")
        if last or left.isEmpty():
            return found.select("station", "mean_km")
        radius = min(EVERYWHERE_KM, radius * 2)


#: Weights below this are none.
LEAST_WEIGHT = 1e-6


def coupling(stations: DataFrame, k: int, low: float, high: float) -> DataFrame:
    """station, other, km, weight = exp(-km / D) down to LEAST_WEIGHT; D is the station's mean distance to its k nearest
    within [low, high] km. Stations of like reach are joined together, so that one with a long reach does not widen that
    of the others."""
    scale = nearest_k(stations, k).select("station", F.least(F.greatest("mean_km", F.lit(low)), F.lit(high)).alias("_scale"))
    reach = F.col("_scale") * -math.log(LEAST_WEIGHT)
    scale = materialize(scale.withColumn("_class", F.ceil(F.log2(F.greatest(reach, F.lit(1.0)))).cast("int")), "reach")
    out = None
    for r in sorted(x[0] for x in scale.select("_class").distinct().collect()):  # powers of two
        mine = scale.filter(F.col("_class") == r)
        pairs = neighbours(stations, min(2.0**r, EVERYWHERE_KM), mine).join(mine, "station")
        part = pairs.select("station", "other", "km", F.exp(-F.col("km") / F.col("_scale")).alias("weight")).filter(F.col("weight") >= LEAST_WEIGHT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else neighbours(stations, 1.0).withColumn("weight", F.lit(1.0))


def distance_weights(pairs: DataFrame, k: int, low: float, high: float, by_neighbour: bool = False) -> DataFrame:
    """weight = exp(-km / D), D the mean distance to the k nearest within [low, high]: of the station itself, or with
    by_neighbour of the other one."""
    scale = nearest_mean_distance(pairs, k).select(F.col("station").alias("other" if by_neighbour else "station"), F.least(F.greatest("mean_km", F.lit(low)), F.lit(high)).alias("_scale"))
    return pairs.join(scale, "other" if by_neighbour else "station").select("station", "other", "km", F.exp(-F.col("km") / F.col("_scale")).alias("weight"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, percentile: float = 0.5) -> DataFrame:
    """First value, in order, whose cumulated weight reaches percentile x total. A NULL value has weight 0; equal values
    are added up before, so a group is ordered over its distinct values. Groups without a value give NULL."""
    w = F.when(F.col(value).isNotNull(), F.coalesce(F.col(weight), F.lit(0.0))).otherwise(0.0)
    d = df.groupBy(*keys, value).agg(F.sum(w).alias("_w"))
    total = d.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    run = F.sum("_w").over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_run", run).join(total, list(keys))
    # a hair of slack, so that the order of adding does not decide
    return d.groupBy(*keys).agg(F.min(F.when(F.col("_run") >= F.col("_all") * percentile - 1e-12 * F.col("_all"), F.col(value))).alias("weighted_median"))


def spatial_mean(pairs: DataFrame, values: DataFrame, value: str, length_km: float) -> DataFrame:
    """Mean of the others' values weighted by exp(-km / length), NULLs left out."""
    v = values.select(F.col("station").alias("other"), value).dropna()
    w = F.exp(-F.col("km") / length_km)
    return pairs.join(v, "other").groupBy("station").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("spatial_mean"))


def wide(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """One row per epoch, one column per station in `names` (a bounded list that the caller states)."""
    return df.groupBy("t").pivot("station", list(names)).agg(F.first(column, ignorenulls=True))


def tall(df: DataFrame, names: Sequence[str], column: str, drop_missing: bool = True) -> DataFrame:
    """The reverse of `wide`."""
    out = df.unpivot(["t"], list(names), "station", column).select("station", "t", column)
    return out.na.drop("any") if drop_missing else out


TILE, TILE_EPOCHS = 64, 2000
_PAIR_SUMS = ["n", "x", "y", "xx", "yy", "xy", "t", "tt", "xt", "yt"]


def pair_correlation(df: DataFrame, column: str, pairs: DataFrame, detrend: bool = False, floor_n: int = 2) -> DataFrame:
    """Absolute correlation of each pair of stations (station < other) in `pairs` at common epochs: station, other, n,
    corr; with detrend, of what is left of a line through the common epochs.

    Stations are gathered in tiles of about TILE; every two tiles with a pair between them meet once for each block of
    epochs and add up all their pairs as products of matrices. A reading is sent once a tile, not once a partner."""
    a = pairs.filter("station < other").select("station", "other").distinct()
    day = F.expr("timestampdiff(SECOND, timestamp_ntz'2000-01-01 00:00:00', t)") / 86400.0
    d = df.select("station", "t", F.col(column).cast("double").alias("x"), day.alias("day")).dropna()
    counts = d.groupBy("station").agg(F.count("*").alias("_n"), F.avg("x").alias("_x"))
    size = counts.agg(F.count("*").alias("s"), F.sum("_n").alias("n")).first()
    tiles, blocks = max(1, -(-size["s"] // TILE)), max(1, -(-(size["n"] or 0) // max(size["s"], 1) // TILE_EPOCHS))
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    block = F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int")
    d = d.join(sized(counts), "station").select("station", "t", "day", (F.col("x") - F.col("_x")).alias("x"), tile("station").alias("tile"), block.alias("block"))
    meet = a.select(F.least(tile("station"), tile("other")).alias("p"), F.greatest(tile("station"), tile("other")).alias("q")).distinct()
    halves = meet.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("tile"))
    both = d.join(sized(halves), "tile")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, i = np.unique(pdf["station"].to_numpy(str), return_inverse=True)
        times, k = np.unique(pdf["t"].to_numpy(), return_inverse=True)
        of = np.zeros(len(names), int)
        of[i] = pdf["tile"]
        x, m, t = np.zeros((len(names), len(times))), np.zeros((len(names), len(times))), np.zeros(len(times))
        x[i, k], m[i, k], t[k] = pdf["x"], 1.0, pdf["day"]
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        first, second = np.flatnonzero(of == p), np.flatnonzero(of == q)
        s = [m @ m.T, x @ m.T, m @ x.T, (x * x) @ m.T, m @ (x * x).T, x @ x.T, (m * t) @ m.T, (m * t * t) @ m.T, (x * t) @ m.T, m @ (x * t).T]
        a, b = np.meshgrid(first, second, indexing="ij")
        keep = (s[0][a, b] > 0) & ((names[a] < names[b]) if p == q else (a != b))
        a, b = a[keep], b[keep]
        swap = names[a] > names[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pd.DataFrame({"station": names[a], "other": names[b]} | {c: v[a, b] for c, v in zip(_PAIR_SUMS, s)})

    sums = both.groupBy("p", "q", "block").applyInPandas(run, "station string, other string, " + ", ".join(f"{c} double" for c in _PAIR_SUMS))
    sums = sums.join(a, ["station", "other"], "left_semi").groupBy("station", "other").agg(*[F.sum(c).alias(c) for c in _PAIR_SUMS])
    c = F.col

    def corr(u: str, v: str, uv: str) -> Column:
        full = lambda w, ww: F.greatest(c("n") * c(ww) - c(w) * c(w), F.lit(0.0))
        return F.try_divide(c("n") * c(uv) - c(u) * c(v), F.sqrt(full(u, u * 2) * full(v, v * 2)))

    xy = corr("x", "y", "xy")
    if detrend:
        xt, yt = corr("x", "t", "xt"), corr("y", "t", "yt")
        xy = F.try_divide(xy - xt * yt, F.sqrt((1 - xt * xt) * (1 - yt * yt)))
    return sums.filter(c("n") >= floor_n).select("station", "other", c("n").cast("bigint").alias("n"), F.abs(xy).alias("corr"))


def mean_correlation(correlations: DataFrame) -> DataFrame:
    """mean_corr and n over the pairs above the diagonal."""
    return correlations.agg(F.avg("corr").alias("mean_corr"), F.count("corr").alias("n"))


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """point_id, station, km: the station nearest to each point (point_id, lat, lon; ties: first by name). The points are
    a bounded query set held against all stations."""
    p = points.select("point_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).dropna()
    st = stations.select("station", "lat", "lon").dropna()
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    found = st.join(sized(p)).withColumn("km", km).groupBy("point_id").agg(F.min(F.struct("km", "station")).alias("m"))
    return found.select("point_id", "m.station", "m.km")


def worst_stations(stats: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k stations with the largest total: the root of the summed squares of `columns` (ties: first by name)."""
    total = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return stats.withColumn("total", total).filter("total is not null").orderBy(F.desc("total"), "station").limit(k)


def by_latitude(df: DataFrame, stations: DataFrame) -> DataFrame:
    """`df` with lat, from north to south, stations of equal latitude by name."""
    return df.join(stations.select("station", "lat").dropDuplicates(["station"]), "station").orderBy(F.desc("lat"), "station")


def point_in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        if ay == by:
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside = inside != crosses
    return inside


def mean_longitude(lon: str) -> Column:
    """Circular mean in degrees; an aggregate."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(lon))), F.sum(F.cos(F.radians(lon)))))
