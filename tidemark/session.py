"""Session settings and the few things that depend on where the session runs."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gzip
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table of series or stations may be broadcast.
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; keyword names use `__` for `.`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session in one process, as in tests, gets a folder of
    its own where that is unset; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    at = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, at, True)
    return f"file://{at}"


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by `release` or at the end of the program."""
    at = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_at_end)
    _WRITTEN.append(at)
    return at


def shared_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file from the driver, gzip if its name ends so."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(gzip.compress(text.encode()) if path.endswith(".gz") else text.encode()))
    finally:
        out.close()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back. Survives the loss of executors. The table stays
    until `release` or the end of the program, since results read it lazily."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release() -> None:
    """Delete every table that `materialize` wrote in this program; results that still read them must be done."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        for at in _WRITTEN:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.clear()


def _release_at_end() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release()


def _width(df: DataFrame):
    """Bytes of a row in memory: 8 for each field, the text of strings, 16 for each entry of arrays and maps."""
    total = F.lit(24 + 8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            total = total + F.coalesce(F.greatest(F.size(f.name), F.lit(0)) * 16, F.lit(0))
        elif kind == "struct":
            total = total + F.lit(8 * len(f.dataType.fields))
    return total


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if its rows take at most `most` bytes (BROADCAST_BYTES by default; they are added up
    here); else as it is, and the join shuffles under AQE's skew handling."""
    size = df.agg(F.sum(_width(df)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df
