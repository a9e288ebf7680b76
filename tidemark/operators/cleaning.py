"""Rolling medians, outlier removal and residual statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import in_blocks, only_core


def _middle(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    at = lambda k: F.get(s, k)
    return F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)


def rolling_median(df: DataFrame, columns: Sequence[str], kernel: int, shrink: bool = True, key: str = "station") -> DataFrame:
    """Median over `kernel` (odd) rows centred on each row of a station. With `shrink` the window stays symmetric at the
    ends of the series, else it is cut off there. NULLs take part in the window but not in the median and stay NULL."""
    if kernel % 2 == 0 or kernel < 1:
        raise ValueError("kernel must be odd")
    half = kernel // 2
    blocks, w = in_blocks(df, key, reach=half)
    span = w.rowsBetween(-half, half)
    if shrink:
        left = F.least(F.lit(half), F.row_number().over(w) - 1)
        size = F.count(F.lit(1)).over(Window.partitionBy(key, "block"))
        blocks = blocks.withColumn("_rn", F.row_number().over(w)).withColumn("_h", F.least(left, size - F.row_number().over(w)))
        for c in columns:
            blocks = blocks.withColumn(f"_w_{c}", F.collect_list(F.struct("_rn", F.col(c).alias("x"))).over(span))
        near = lambda c: F.transform(F.filter(f"_w_{c}", lambda p: (F.abs(p["_rn"] - F.col("_rn")) <= F.col("_h")) & p["x"].isNotNull()), lambda p: p["x"])
    else:
        for c in columns:
            blocks = blocks.withColumn(f"_w_{c}", F.collect_list(c).over(span))
        near = lambda c: F.col(f"_w_{c}")
    out = blocks.withColumns({c: F.when(F.col(c).isNotNull(), _middle(near(c))) for c in columns})
    return only_core(out.drop("_rn", "_h", *[f"_w_{c}" for c in columns]))


def clean(df: DataFrame, reference: DataFrame, columns: Sequence[str], std_outlier: float | None = None, iqr_outlier: float | None = None, std_bad: float | None = None, std_thresh: float | None = None, min_obs: int = 100, min_clean_obs: int = 100) -> DataFrame:
    """Outliers of df - reference to NULL, component by component.

    In this order: fewer than min_obs values: the component is all NULL; values with a variance of std_bad² or more are
    NULL (columns `<c>_var`); a residual is an outlier beyond std_outlier population standard deviations and, if both
    are given, also outside the quartiles by iqr_outlier interquartile ranges; fewer than min_clean_obs values left, or
    a residual deviation above std_thresh: all NULL. Quartiles are exact (see quantiles.py). Uncertainties are dropped; epochs missing from `reference` are NULL.
    """
    ref = reference.select("station", "t", *[F.col(c).alias(f"_ref_{c}") for c in columns])
    d = df.join(ref, ["station", "t"], "left")
    for c in columns:
        bad = F.col(f"{c}_var") >= std_bad**2 if std_bad is not None and f"{c}_var" in df.columns else F.lit(False)
        d = d.withColumn(f"_x_{c}", F.when(~F.coalesce(bad, F.lit(False)), F.col(c)))
        d = d.withColumn(f"_r_{c}", F.col(f"_x_{c}") - F.col(f"_ref_{c}"))
    first = d.groupBy("station").agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.stddev_pop(f"_r_{c}").alias(f"_sd_{c}") for c in columns],
    )
    quartiles = {c: exact_quantiles(d, "station", f"_r_{c}", [0.25, 0.75]).withColumnRenamed("q", f"_q_{c}") for c in columns} if iqr_outlier is not None else {}
    for q in quartiles.values():
        first = first.join(q, "station")
    d = d.join(first, "station")
    for c in columns:
        r, out = F.col(f"_r_{c}"), F.lit(std_outlier is not None or iqr_outlier is not None)
        if std_outlier is not None:
            out &= F.abs(r) > std_outlier * F.col(f"_sd_{c}")
        if iqr_outlier is not None:
            low, high = F.get(f"_q_{c}", F.lit(0)), F.get(f"_q_{c}", F.lit(1))
            out &= (r < low - iqr_outlier * (high - low)) | (r > high + iqr_outlier * (high - low))
        keep = (F.col(f"_n_{c}") >= min_obs) & r.isNotNull() & ~F.coalesce(out, F.lit(False))
        d = d.withColumn(f"_x_{c}", F.when(keep, F.col(f"_x_{c}"))).withColumn(f"_r_{c}", F.when(keep, r))
    second = d.groupBy("station").agg(*[F.count(f"_x_{c}").alias(f"_m_{c}") for c in columns], *[F.stddev_pop(f"_r_{c}").alias(f"_se_{c}") for c in columns])
    d = d.join(second, "station")
    fine = lambda c: (F.col(f"_m_{c}") >= min_clean_obs) & (F.lit(True) if std_thresh is None else F.coalesce(F.col(f"_se_{c}") <= std_thresh, F.lit(False)))
    return d.select("station", "t", *[F.when(fine(c), F.col(f"_x_{c}")).alias(c) for c in columns])


def _statistics(c: str, mean: Column, sd: Column, std_outlier: float) -> list[Column]:
    z = F.coalesce(F.col(c), F.lit(0.0))
    return [
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.sqrt(F.avg(F.col(c) * F.col(c))).alias("rms"),
        F.count(c).alias("observations"),
        (F.count("*") - F.count(c)).alias("gaps"),
        F.count_if(z - mean > std_outlier * sd).alias("outliers"),
        F.count_if(F.abs(z - mean) > std_outlier * sd).alias("outliers_two_sided"),
    ]


def residual_stats(df: DataFrame, column: str, std_outlier: float = 3.0) -> DataFrame:
    """Per station: mean, std (sample), rms, observations, gaps, and outliers: values that, with NULL as 0 and the mean
    of that removed, exceed std_outlier population deviations upwards (outliers) or either way (outliers_two_sided)."""
    return component_stats(df, [column], std_outlier).drop("comp")


def component_stats(df: DataFrame, columns: Sequence[str], std_outlier: float = 3.0) -> DataFrame:
    """residual_stats of several components, one row each (comp): one pass for the means and one for the rest."""
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    base = df.groupBy("station").agg(*[x for c in columns for x in (F.avg(z[c]).alias(f"_m_{c}"), F.stddev_pop(z[c]).alias(f"_s_{c}"))])
    names = ["mean", "std", "rms", "observations", "gaps", "outliers", "outliers_two_sided"]
    each = df.join(base, "station").groupBy("station").agg(*[v.alias(f"{n}_{c}") for c in columns for n, v in zip(names, _statistics(c, F.col(f"_m_{c}"), F.col(f"_s_{c}"), std_outlier))])
    rows = F.array(*[F.struct(F.lit(c).alias("comp"), *[F.col(f"{n}_{c}").alias(n) for n in names]) for c in columns])
    return each.select("station", F.explode(rows).alias("x")).select("station", "x.*")


def max_rolling_deviation(df: DataFrame, column: str, kernel: int) -> DataFrame:
    """Per station: the trailing mean over `kernel` epochs (at least half of them with a value) of the demeaned series,
    signed, where it is farthest from zero."""
    mean = df.groupBy("station").agg(F.avg(column).alias("_m"))
    blocks, w = in_blocks(df.join(mean, "station"), reach=kernel)
    span = w.rowsBetween(-(kernel - 1), 0)
    x = F.col(column) - F.col("_m")
    rolled = blocks.withColumn("_roll", F.when(F.count(x).over(span) >= max(kernel // 2, 1), F.avg(x).over(span)))
    return only_core(rolled).groupBy("station").agg(F.max_by("_roll", F.abs(F.col("_roll"))).alias("max_rolling_dev"))
