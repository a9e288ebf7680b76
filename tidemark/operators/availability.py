"""How complete series are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import in_blocks, only_core


def _steps(df: DataFrame) -> DataFrame:
    blocks, w = in_blocks(df.select("station", "t"))
    return only_core(blocks.withColumn("gap_days", (F.col("_us") - F.lag("_us").over(w)) / 86_400e6))


def reliability(df: DataFrame) -> DataFrame:
    """Per station: n_obs, length_days, median_step_days and reliability = n_obs / (round(length / median step) + 1),
    rounded half to even. A station with one epoch has NULL."""
    steps = _steps(df)
    median = exact_quantiles(steps, "station", "gap_days", [0.5]).select("station", F.get("q", F.lit(0)).alias("median_step_days"))
    s = steps.groupBy("station").agg(F.count("*").alias("n_obs"), F.sum("gap_days").alias("length_days")).join(median, "station")
    return s.withColumn("reliability", F.try_divide(F.col("n_obs"), F.bround(F.try_divide(F.col("length_days"), F.col("median_step_days")), 0) + 1))


def quality_gate(df: DataFrame, min_reliability: float = 0.5, min_days: float = 365.0) -> DataFrame:
    """The stations whose reliability and length exceed the bounds, with the figures of `reliability`."""
    return reliability(df).filter((F.col("reliability") > min_reliability) & (F.col("length_days") > min_days))


def availability_metrics(df: DataFrame, sampling_days: float = 1.0) -> DataFrame:
    """Per station: number of records, first and last day, length in days and number x sampling / length."""
    length = F.datediff("recency", "age") + F.lit(sampling_days)
    return (
        df.groupBy("station")
        .agg(F.count("*").alias("number"), F.to_date(F.min("t")).alias("age"), F.to_date(F.max("t")).alias("recency"))
        .withColumn("length_days", length)
        .withColumn("reliability", F.col("number") * sampling_days / F.col("length_days"))
    )


def availability_intervals(df: DataFrame, sampling_days: float) -> DataFrame:
    """Stretches without a hole longer than the sampling: station, start_t, end_t, n (epochs). Holes are found in blocks;
    a block that begins inside a stretch takes the stretch's start from the blocks before it."""
    blocks, w = in_blocks(df.select("station", "t").distinct())
    new = F.coalesce((F.col("_us") - F.lag("_us").over(w)) / 86_400e6 > sampling_days, F.lit(True))
    cored = blocks.withColumn("_new", new & F.col("core") & (F.lag("_us").over(w).isNotNull() | (F.col("block") == 0))).filter("core")
    own = F.last(F.when(F.col("_new"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cored = cored.withColumn("_own", own)
    ends = cored.groupBy("station", "block").agg(F.max("_own").alias("_own"))
    before = F.last("_own", ignorenulls=True).over(Window.partitionBy("station").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("station", "block", before.alias("_before"))
    return (
        cored.join(ends, ["station", "block"])
        .groupBy("station", F.coalesce("_own", "_before").alias("start_t"))
        .agg(F.max("t").alias("end_t"), F.count("*").alias("n"))
    )
