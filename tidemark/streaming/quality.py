"""Series statistics and normal equations kept up to date as readings arrive. Both are sums, so late rows within the
watermark simply add to their window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(stream: DataFrame, column: str, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """station, window start, n, mean and deviation of each (tumbling or sliding) window. Readings later than `late` are
    dropped by the watermark; NULL and NaN are no readings."""
    x = F.when(~F.isnan(column), F.col(column))
    w = F.window("t", window, slide) if slide else F.window("t", window)
    agg = stream.withWatermark("t", late).groupBy(w.alias("w"), "station").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return agg.select("station", F.col("w.start").alias("start_t"), "n", "mean", "sd")


def line_sums(stream: DataFrame, column: str, late: str = "2 days", window: str = "30 days") -> DataFrame:
    """The five sums of a line through each station's readings, per window; adding windows gives the line of any span."""
    x = F.when(~F.isnan(column), F.col(column))
    t = F.unix_timestamp("t") / 86400.0 - 10957.0  # days since 2000
    ok = x.isNotNull()
    agg = stream.withWatermark("t", late).groupBy(F.window("t", window).alias("w"), "station").agg(F.count(x).alias("n"), F.sum(F.when(ok, t)).alias("st"), F.sum(F.when(ok, t * t)).alias("stt"), F.sum(x).alias("sx"), F.sum(t * x).alias("stx"))
    return agg.select("station", F.col("w.start").alias("start_t"), "n", "st", "stt", "sx", "stx")


def line_of(sums: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Slope per day and intercept at 2000-01-01 from any number of line_sums rows."""
    s = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "st", "stt", "sx", "stx")])
    det = F.col("n") * F.col("stt") - F.col("st") ** 2
    slope = F.try_divide(F.col("n") * F.col("stx") - F.col("st") * F.col("sx"), det)
    return s.select(*keys, "n", slope.alias("slope"), F.try_divide(F.col("sx") - slope * F.col("st"), F.col("n")).alias("intercept"))
