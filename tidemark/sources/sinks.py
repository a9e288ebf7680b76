"""Writers. Parquet partitioned for pruning by station prefix keeps later per-station work local to few files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Partitioned by a hash bucket of the station, sorted by station and time within files."""
    b = F.pmod(F.xxhash64("station"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", b).repartition("bucket").sortWithinPartitions("station", "t").write.partitionBy("bucket").mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by station: joins and aggregates by station then need no shuffle."""
    df.write.bucketBy(buckets, "station").sortBy("station", "t").mode("overwrite").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
