"""Series derived from the star-schema tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def ship(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of shipments per flag and status: three components with variances and covariances."""
    li = table(spark, d, "lineitem")
    n = F.count("*")
    p, q, s = F.col("l_extendedprice") / 1000, F.col("l_quantity"), F.col("l_discount") * 100
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("station"), F.col("l_shipdate").alias("t")).agg(
        F.avg(p).alias("east"), F.avg(q).alias("north"), F.avg(s).alias("up"),
        (F.var_samp(p) / n).alias("east_var"), (F.var_samp(q) / n).alias("north_var"), (F.var_samp(s) / n).alias("up_var"),
        (F.covar_samp(p, q) / n).alias("east_north_cov"), (F.covar_samp(p, s) / n).alias("east_up_cov"), (F.covar_samp(q, s) / n).alias("north_up_cov"),
        n.alias("n"),
    )


def nat(spark: SparkSession, d: str) -> DataFrame:
    """Daily order totals per nation, with gaps."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == c["c_custkey"]).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("station"), F.col("o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1e5).alias("total"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    """Irregular readings per user."""
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("station"), F.col("ts").alias("t")).agg(F.avg("value").alias("value"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    """Error events as a catalog per user."""
    return table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("station"), F.col("ts").alias("time"), F.col("value").alias("size"))


def sta(spark: SparkSession, d: str) -> DataFrame:
    """A position for each nation."""
    return table(spark, d, "nation").select(F.col("n_name").alias("station"), (-60.0 + 5.0 * F.col("n_nationkey")).alias("lat"), (-170.0 + 14.0 * F.col("n_nationkey")).alias("lon"), F.lit(0.0).alias("alt"))


SQL = {
    "ship": """ship as (select l_returnflag || l_linestatus as station, l_shipdate as t,
  avg(l_extendedprice / 1000) as east, avg(l_quantity) as north, avg(l_discount * 100) as up,
  var_samp(l_extendedprice / 1000) / count(*) as east_var, var_samp(l_quantity) / count(*) as north_var, var_samp(l_discount * 100) / count(*) as up_var,
  covar_samp(l_extendedprice / 1000, l_quantity) / count(*) as east_north_cov, covar_samp(l_extendedprice / 1000, l_discount * 100) / count(*) as east_up_cov,
  covar_samp(l_quantity, l_discount * 100) / count(*) as north_up_cov, count(*) as n
  from lineitem group by all)""",
    "nat": """nat as (select n_name as station, o_orderdate as t, sum(o_totalprice) / 1e5 as total
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)""",
    "ev": "ev as (select cast(user_id as varchar) as station, ts as t, avg(value) as value from events group by all)",
    "err": "err as (select cast(user_id as varchar) as station, ts as time, value as size from events where event_type = 'error')",
    "sta": "sta as (select n_name as station, -60.0 + 5.0 * n_nationkey as lat, -170.0 + 14.0 * n_nationkey as lon, 0.0 as alt from nation)",
}


NUDGE = 1.37e-8


def with_views(names: str, rest: str) -> str:
    """`rest` is either a select or further CTEs followed by one, joined by a comma."""
    more = rest.lstrip().startswith("|")
    return "with " + ",\n".join(SQL[n] for n in names.split()) + ("," if more else "") + "\n" + rest.lstrip().removeprefix("|").lstrip(",")


def r6(c: str, alias: str | None = None, digits: int = 6):
    """Rounded column free of negative zero. The nudge keeps decimal data off the halves, where engines round apart."""
    return (F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(alias or c)


def q6(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr} + {NUDGE}, {digits}) + 0.0 as {alias}"
