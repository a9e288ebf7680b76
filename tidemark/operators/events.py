"""Catalogs joined to stations in time and space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.availability import availability_intervals
from tidemark.operators.network import EARTH_KM, haversine_km
from tidemark.operators.series import in_blocks


def next_epoch(events: DataFrame, obs: DataFrame) -> DataFrame:
    """As-of join: for each event (station, time) the first epoch of its station at or after it (next_t, NULL if none).
    Events and epochs are ordered together in one pass; repeated events count once."""
    ev = events.select("station", F.col("time").alias("t")).distinct().withColumn("_event", F.lit(True))
    both = ev.unionByName(obs.select("station", "t").distinct().withColumn("_event", F.lit(False)))
    blocks, _ = in_blocks(both)
    # from the latest back, so that the frame only grows; an epoch at the event's own time comes before it and counts
    w = Window.partitionBy("station", "block").orderBy(F.col("_us").desc(), F.col("_event").cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.withColumn("next_t", F.last(F.when(~F.col("_event"), F.col("t")), ignorenulls=True).over(w)).filter("core and _event")
    # a block that ends without another epoch looks into the blocks after it
    firsts = blocks.filter("core and not _event").groupBy("station", "block").agg(F.min("t").alias("_first"))
    every = blocks.select("station", "block").distinct().join(firsts, ["station", "block"], "left")
    later = F.last("_first", ignorenulls=True).over(Window.partitionBy("station").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("station", "block", later.alias("_later"))
    return found.join(every, ["station", "block"], "left").select("station", F.col("t").alias("time"), F.coalesce("next_t", "_later").alias("next_t"))


def interval_events(obs: DataFrame, events: DataFrame, threshold: float) -> DataFrame:
    """Range join: events (station, time, size) that fall in (t, next t] of a station's epochs, summed; intervals whose
    sum reaches the threshold give a step at their last event: station, t, step_time, total, n."""
    ev = events.select("station", "time", F.col("size").cast("double").alias("size"))
    nxt = next_epoch(ev, obs)
    first = obs.groupBy("station").agg(F.min("t").alias("_first"))
    hit = ev.join(nxt, ["station", "time"]).filter("next_t is not null").join(first, "station").filter("next_t > _first")
    per = hit.groupBy("station", F.col("next_t").alias("t")).agg(F.sum("size").alias("total"), F.max("time").alias("step_time"), F.count("*").alias("n"))
    return per.filter(F.col("total") >= threshold).select("station", "t", "step_time", "total", "n")


#: Kilometres of a degree of latitude (with its cosine term) and of longitude at the equator, and the
#: reach of an earthquake of magnitude m, 10^(m/2 - 0.8) km.
KM_LAT, KM_LAT_COS, KM_LON = 111.13292, 0.55982, 111.41284


def reach_km(mw: Column) -> Column:
    return F.pow(F.lit(10.0), mw / 2 - 0.8)


def events_in_reach(events: DataFrame, stations: DataFrame, cell: float = 2.0) -> DataFrame:
    """Spatial join: (eq_id, station, distance_km) where the distance on a flat earth around the event, its depth and
    the station's height included, is below the event's reach. Both sides meet in latitude-longitude cells of `cell`
    degrees, so no pair farther apart than the reach is formed except within a cell. Rows with NULL in any of the
    numbers needed are left out; a NULL height is 0; repeated events count once."""
    ev = events.select("eq_id", "lat", "lon", F.coalesce("depth_km", F.lit(0.0)).alias("depth_km"), "mw").dropna().dropDuplicates(["eq_id"])
    st = stations.select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.coalesce("alt", F.lit(0.0)).alias("salt")).dropna().dropDuplicates(["station"])
    cos = F.cos(F.radians("lat"))
    km_lat = F.lit(KM_LAT) - F.lit(KM_LAT_COS) * F.cos(F.radians(2 * F.col("lat")))
    r = reach_km(F.col("mw"))
    dlat = F.least(r / km_lat, F.lit(180.0))
    dlon = F.when(cos > 1e-6, F.least(r / (KM_LON * cos), F.lit(720.0))).otherwise(720.0)
    idx = lambda c: F.floor(c / cell).cast("int")
    low, high = F.greatest(F.col("lat") - dlat, F.lit(-90.0)), F.least(F.col("lat") + dlat, F.lit(90.0))
    west, east = F.greatest(F.col("lon") - dlon, F.lit(-180.0)), F.least(F.col("lon") + dlon, F.lit(360.0))
    ev = ev.withColumn("_y", F.explode(F.sequence(idx(low), idx(high)))).withColumn("_x", F.explode(F.sequence(idx(west), idx(east))))
    st = st.withColumn("_y", idx(F.col("slat"))).withColumn("_x", idx(F.col("slon")))
    dy, dx = (F.col("slat") - F.col("lat")) * km_lat, (F.col("slon") - F.col("lon")) * KM_LON * cos
    dz = F.col("salt") / 1000.0 + F.col("depth_km")
    return ev.join(st, ["_y", "_x"]).withColumn("distance_km", F.sqrt(dy * dy + dx * dx + dz * dz)).filter(F.col("distance_km") < r).select("eq_id", "station", "distance_km")


def maintenance_in_span(maintenance: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct maintenance times (station, time) within the first and last epoch of their station."""
    span = obs.groupBy("station").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return maintenance.select("station", "time").dropna().distinct().join(span, "station").filter("time between _a and _b").select("station", "time")


def augment(catalog: DataFrame, found: DataFrame, columns: list[str], keep_missing: bool = True) -> DataFrame:
    """Left join of detected values on (station, time); without keep_missing, rows where all are NULL go."""
    out = catalog.join(found.select("station", "time", *columns), ["station", "time"], "left")
    return out if keep_missing else out.na.drop("all", subset=columns)


def unknown(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Detected (station, time) that no catalog explains."""
    return found.join(catalog.select("station", "time").distinct(), ["station", "time"], "left_anti")


def sessions(times: DataFrame, gap_days: float) -> DataFrame:
    """Ranges of network-wide times, split where neighbouring distinct times are more than gap_days apart: start_t, end_t,
    n. The last range counts. The times are worked on in blocks like those of one station."""
    d = times.select(F.lit("").alias("station"), F.col("time").alias("t")).dropna()
    return availability_intervals(d, gap_days).select("start_t", "end_t", "n")


def events_for_stations(events: DataFrame, targets: DataFrame, circle_km: float, big_mw: float = 7.5, pad_days: float = 0.0, cell: float = 2.0) -> DataFrame:
    """The events that may explain a station's series: eq_id, station, km where the event falls into the target's window
    (targets: station, lat, lon, t_start, t_end, widened by pad_days) and is within circle_km or larger than big_mw. Near
    pairs meet in latitude-longitude cells, large events and targets in the months of the window: an event has one place, a
    target is repeated for each cell within the circle and each month, so every pair is formed once. Rows with NULL in any of
    the columns needed are left out, repeated events and targets count once."""
    ev = events.select("eq_id", F.col("lat").alias("elat"), F.col("lon").alias("elon"), "origin_time", "mw").dropna(subset=["eq_id", "elat", "elon", "origin_time"]).dropDuplicates(["eq_id"])
    pad = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pad_days * 86_400.0))
    tg = targets.select("station", "lat", "lon", (F.col("t_start") - pad).alias("_a"), (F.col("t_end") + pad).alias("_b")).dropna().dropDuplicates(["station"])
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    inside = F.col("origin_time").between(F.col("_a"), F.col("_b"))
    is_big = F.coalesce(F.col("mw") > big_mw, F.lit(False))
    dlat = F.lit(circle_km / (EARTH_KM * math.radians(1)) + 1e-9)
    cos = F.cos(F.radians(F.least(F.abs(F.col("lat")) + dlat, F.lit(90.0))))
    dlon = F.when(cos > 1e-6, F.least(dlat / cos, F.lit(360.0))).otherwise(360.0)
    wide = int(math.ceil(360 / cell))
    idx = lambda c: F.floor(c / cell).cast("int")
    month = lambda t: (F.year(t) * 12 + F.month(t)).cast("int")
    west = idx(F.col("lon") - dlon)
    across = F.array_distinct(F.transform(F.sequence(west, F.least(idx(F.col("lon") + dlon), west + wide)), lambda x: F.pmod(x, F.lit(wide))))
    places = lambda first, last, by_month: F.transform(F.sequence(first, last), lambda y: F.struct(y.alias("_y"), F.lit(by_month).alias("_by_month")))
    tg = tg.select("*", F.inline(F.concat(places(idx(F.col("lat") - dlat), idx(F.col("lat") + dlat), False), places(month("_a"), month("_b"), True))))
    # months have the column -1, that no cell has
    tg = tg.withColumn("_x", F.explode(F.when(F.col("_by_month"), F.array(F.lit(-1))).otherwise(across)))
    ev = ev.withColumn("_y", F.when(is_big, month("origin_time")).otherwise(idx(F.col("elat")))).withColumn("_x", F.when(is_big, -1).otherwise(F.pmod(idx(F.col("elon")), F.lit(wide))))
    # a merge by hint: Spark's estimate counts a target once however often it is repeated, and would have them all broadcast
    pairs = ev.join(tg.hint("merge"), ["_y", "_x"])
    return pairs.filter(inside).withColumn("km", km).filter(is_big | (F.col("km") <= circle_km)).select("eq_id", "station", "km")
