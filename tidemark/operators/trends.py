"""Linear trends as sums, so that they combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeunits import elapsed


def _fit(x: str, t: Column, w: Column) -> dict[str, Column]:
    ok = F.col(x).isNotNull() & w.isNotNull()
    one = lambda e: F.sum(F.when(ok, e))
    return {"sw": one(w), "st": one(w * t), "stt": one(w * t * t), "sx": one(w * F.col(x)), "stx": one(w * t * F.col(x)), "n": F.count(F.when(ok, 1))}


def trend(df: DataFrame, column: str, var: str | None = None, unit: str = "D", ref: str = "2000-01-01", start: str | None = None, end: str | None = None) -> DataFrame:
    """Per station: n, slope per `unit`, intercept at `ref` and the slope's formal deviation of the (inverse variance)
    weighted least-squares line. Fewer than two distinct epochs: NULL. Times are centred on the station's mean before
    the sums of squares, which keeps them accurate. `start` and `end` bound the epochs (inclusive). For a trend through fits, give the frame of
    solve.api.sum_fits and its fit_ and var_ columns."""
    if start:
        df = df.filter(F.col("t") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col("t") <= F.lit(end).cast("timestamp_ntz"))
    w = F.lit(1.0) if var is None else F.when(F.col(var) > 0, 1.0 / F.col(var))
    d = df.withColumn("_t", elapsed("t", f"'{ref}'", unit)).withColumn("_w", w)
    mid = d.groupBy("station").agg(F.avg(F.when(F.col(column).isNotNull() & F.col("_w").isNotNull(), F.col("_t"))).alias("_mid"))
    s = d.join(mid, "station").withColumn("_c", F.col("_t") - F.col("_mid"))
    s = s.groupBy("station").agg(F.first("_mid").alias("_mid"), *[v.alias(k) for k, v in _fit(column, F.col("_c"), F.col("_w")).items()])
    det = F.col("sw") * F.col("stt") - F.col("st") * F.col("st")
    ok = (F.col("n") > 1) & (det > 0)
    slope = (F.col("sw") * F.col("stx") - F.col("st") * F.col("sx")) / det
    return s.select(
        "station",
        "n",
        F.when(ok, slope).alias("slope"),
        F.when(ok, (F.col("sx") - slope * F.col("st")) / F.col("sw") - slope * F.col("_mid")).alias("intercept"),
        F.when(ok, F.sqrt(F.col("sw") / det)).alias("slope_sd"),
    )


def trend_change(df: DataFrame, events: DataFrame, column: str, window_days: float, min_change: float = 0.0, var: str | None = None) -> DataFrame:
    """Per station and event (`events`: station, time): slope per day over the window_days before the event's day, and
    from that day on, their difference, and its sign (0 below min_change). An epoch belongs to every event within the
    window, so the join holds one row for each epoch and event near it. With `var` the slopes are weighted by the inverse
    variances; epochs whose variance is not positive are left out."""
    day = F.date_trunc("day", F.col("time")).cast("timestamp_ntz")
    ev = events.select("station", "time").distinct().withColumn("_day", day)
    weight = F.lit(1.0) if var is None else F.when(F.col(var) > 0, 1.0 / F.col(var))
    d = df.select("station", "t", column, weight.alias("_w")).filter(F.col(column).isNotNull() & F.col("_w").isNotNull())
    # epochs and events meet in buckets of the window's length: an epoch looks into its own and its two neighbours
    size = window_days * 86_400
    bucket = lambda c: F.floor(elapsed(c, "'1970-01-01'", "s") / size).cast("bigint")
    ev = ev.withColumn("_b", bucket("_day"))
    d = d.withColumn("_b", F.explode(F.array(bucket("t") - 1, bucket("t"), bucket("t") + 1)))
    dt = elapsed("t", "_day", "D")
    j = d.join(ev, ["station", "_b"]).withColumn("_dt", dt).filter(F.col("_dt").between(-window_days, window_days))
    before, after = F.col("_dt") < 0, F.col("_dt") >= 0

    def slope(side: Column) -> Column:
        if var is None:
            return F.regr_slope(F.when(side, F.col(column)), F.when(side, F.col("_dt")))
        w, x, y = F.when(side, F.col("_w")), F.col("_dt"), F.col(column)
        sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
        det = sw * F.sum(w * x * x) - sx * sx
        return F.when(F.count(w) > 1, F.try_divide(sw * F.sum(w * x * y) - sx * sy, det))

    out = j.groupBy("station", "time").agg(slope(before).alias("slope_before"), slope(after).alias("slope_after"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"))
    change = F.col("slope_after") - F.col("slope_before")
    return out.withColumn("change", change).withColumn("sign", F.when(F.abs(change) >= min_change, F.signum(change)).otherwise(F.when(change.isNotNull(), 0.0)).cast("int"))
