"""Surface displacement of buried point sources (Okada 1985, Bulletin of the Seismological Society of America 75(4)), as
column expressions, and what earthquakes may have done to stations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.events import KM_LAT, KM_LAT_COS, KM_LON, events_in_reach, interval_events


def point_source(x: Column, y: Column, depth: Column, dip: Column, rake: Column, potency: Column, ratio: float = 0.5) -> tuple[Column, Column, Column]:
    """Displacement along strike, to the left of it, and up, of a shear dislocation at `depth` under the origin, at (x, y) at the
    surface. x points along strike, y to the left; all lengths in one unit, potency (slip times area) in its cube; angles
    in degrees. `ratio` is mu / (lambda + mu) of the half space."""
    sd, cd = F.sin(F.radians(dip)), F.cos(F.radians(dip))
    p, q = y * cd + depth * sd, y * sd - depth * cd
    r = F.sqrt(x * x + y * y + depth * depth)
    rd = r + depth
    r3, r5 = r * r * r, r * r * r * r * r
    # the terms of the half space
    i1 = ratio * y * (1 / (r * rd * rd) - x * x * (3 * r + depth) / (r3 * rd * rd * rd))
    i2 = ratio * x * (1 / (r * rd * rd) - y * y * (3 * r + depth) / (r3 * rd * rd * rd))
    i3 = ratio * x / r3 - i2
    i4 = ratio * (-x * y * (2 * r + depth) / (r3 * rd * rd))
    i5 = ratio * (1 / (r * rd) - x * x * (2 * r + depth) / (r3 * rd * rd))
    strike_slip = [3 * x * x * q / r5 + i1 * sd, 3 * x * y * q / r5 + i2 * sd, 3 * x * depth * q / r5 + i4 * sd]
    dip_slip = [3 * x * p * q / r5 - i3 * sd * cd, 3 * y * p * q / r5 - i1 * sd * cd, 3 * depth * p * q / r5 - i5 * sd * cd]
    along, up = F.cos(F.radians(rake)), F.sin(F.radians(rake))
    return tuple(-potency / (2 * math.pi) * (along * s + up * d) for s, d in zip(strike_slip, dip_slip))  # type: ignore[return-value]


def displacements(events: DataFrame, stations: DataFrame, rigidity: float = 48e9, ratio: float = 0.5) -> DataFrame:
    """eq_id, origin_time, station, east_mm, north_mm, up_mm of every event (eq_id, origin_time, lat, lon, depth_km, mw,
    mo_nm, strike, dip, rake as numbers) at every station in its reach (see events_in_reach). A missing moment follows from
    the magnitude. Events without a plane, or at no depth, are left out; the earth is flat around the event."""
    ev = events.select("eq_id", "origin_time", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("depth_km").alias("_d"), "strike", "dip", "rake", F.coalesce("mo_nm", F.pow(F.lit(10.0), 1.5 * F.col("mw") + 9.1)).alias("_mo"))
    ev = ev.dropna().filter("_d > 0").dropDuplicates(["eq_id"])
    st = stations.select("station", F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).dropna().dropDuplicates(["station"])
    near = events_in_reach(events, stations).select("eq_id", "station").join(ev, "eq_id").join(st, "station")
    north = (F.col("_slat") - F.col("_lat")) * (F.lit(KM_LAT) - KM_LAT_COS * F.cos(F.radians(2 * F.col("_lat"))))
    east = (F.col("_slon") - F.col("_lon")) * KM_LON * F.cos(F.radians("_lat"))
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    x, y = east * s + north * c, north * s - east * c
    u, v, w = point_source(x, y, F.col("_d"), F.col("dip"), F.col("rake"), F.col("_mo") / rigidity / 1e9, ratio)
    mm = 1e6  # of a kilometre
    return near.select("eq_id", "origin_time", "station", ((u * s - v * c) * mm).alias("east_mm"), ((u * c + v * s) * mm).alias("north_mm"), (w * mm).alias("up_mm"))


def dislocation_steps(obs: DataFrame, events: DataFrame, stations: DataFrame, threshold_mm: float, **kw) -> DataFrame:
    """Steps to expect: station, t, step_time, total, n, where the displacements (length of the vector, added up) of the events between two epochs
    of a station reach threshold_mm. See events.interval_events."""
    d = displacements(events, stations, **kw)
    size = F.sqrt(F.col("east_mm") ** 2 + F.col("north_mm") ** 2 + F.col("up_mm") ** 2)
    return interval_events(obs, d.select("station", F.col("origin_time").alias("time"), size.alias("size")), threshold_mm)
