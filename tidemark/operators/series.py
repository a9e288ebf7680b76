"""Column and row operators on tidy series: one row per (station, t), one column per component.

A frame of this kind has the key column `station`, the time column `t` (TIMESTAMP_NTZ), data columns, and may have a
variance column `<c>_var` per data column and covariance columns `<a>_<b>_cov`. Missing numbers are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.timeunits import micros
from tidemark.operators.blocks import BLOCK_ROWS, ordered_blocks


@dataclass(frozen=True)
class SeriesSpec:
    """What the columns of a series frame mean. Covariances are the upper triangle, row by row."""

    data: tuple[str, ...]
    unit: str = "mm"
    src: str = ""
    var: tuple[str, ...] = ()
    cov: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.var and len(self.var) != len(self.data):
            raise ValueError("as many variance as data columns")
        if self.cov and len(self.cov) != len(self.data) * (len(self.data) - 1) // 2:
            raise ValueError("a covariance column for each pair of data columns")

    def covs_of(self, i: int) -> list[str]:
        """Covariance columns that touch data column i."""
        if not self.cov:
            return []
        pairs = [(a, b) for a in range(len(self.data)) for b in range(a + 1, len(self.data))]
        return [c for c, p in zip(self.cov, pairs) if i in p]

    def renamed(self, unit: str) -> SeriesSpec:
        return replace(self, unit=unit)


def cov_index_map(n: int) -> list[int]:
    """Position in (variances, covariances) of each entry of the n x n matrix, row by row."""
    pair, k = {}, n
    for a in range(n):
        for b in range(a + 1, n):
            pair[a, b] = pair[b, a] = k
            k += 1
    return [a if a == b else pair[a, b] for a in range(n) for b in range(n)]


def block_permutation(n_outer: int, n_inner: int) -> list[int]:
    """Order that brings outer-major blocks to inner-major ones: entry j of the result is the old index."""
    return [o * n_inner + i for i in range(n_inner) for o in range(n_outer)]


def convert_units(df: DataFrame, spec: SeriesSpec, factor: float) -> DataFrame:
    """Data times `factor`, variances and covariances times its square."""
    return df.withColumns({c: F.col(c) * factor for c in spec.data} | {c: F.col(c) * (factor * factor) for c in (*spec.var, *spec.cov)})


def mask_out(df: DataFrame, spec: SeriesSpec, component: str, where: Column | None = None) -> DataFrame:
    """NULL for a component, its variance and every covariance that touches it; in all rows or `where` it holds."""
    i = spec.data.index(component)
    cols = [component, *([spec.var[i]] if spec.var else []), *spec.covs_of(i)]
    hold = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(~hold, F.col(c)) for c in cols})


def cut(df: DataFrame, t_min: str | None = None, t_max: str | None = None, i_min: int | None = None, i_max: int | None = None, keep_inside: bool = True) -> DataFrame:
    """Rows inside the bounds (inclusive) or strictly outside. Index bounds count the epochs of each station from 0; of
    a time and an index bound the tighter one holds. At least one bound must be given."""
    if not (t_min or t_max or i_min or i_max):
        raise ValueError("no bound")
    low, high = F.lit(True), F.lit(True)
    if i_min or i_max:
        df = numbered(df).withColumnRenamed("_row", "_i")
    if t_min:
        low &= F.col("t") >= F.expr(f"timestamp_ntz'{t_min}'")
    if i_min:
        low &= F.col("_i") >= i_min
    if t_max:
        high &= F.col("t") <= F.expr(f"timestamp_ntz'{t_max}'")
    if i_max:
        high &= F.col("_i") <= i_max
    return df.filter(low & high if keep_inside else ~low | ~high).drop("_i", "_us", "block", "core")


def laid(df: DataFrame, key: str = "station", t: str = "t") -> DataFrame:
    """Add _us (time in microseconds). Rows without a time are left out."""
    return df.withColumn("_us", micros(t)).filter("_us is not null")


def in_blocks(df: DataFrame, key: str = "station", t: str = "t", reach: int = 0) -> tuple[DataFrame, WindowSpec]:
    """`df` in ordered blocks (see blocks.py) and the window over a block in time order. Filter on `core` afterwards.
    `reach`: how many rows the work looks to either side; blocks are made large enough for their halos to hold them."""
    rows = max(BLOCK_ROWS, 40 * reach)
    return ordered_blocks(laid(df, key, t), key, "_us", counted=df.select(key), block_rows=rows), Window.partitionBy(key, "block").orderBy("_us")


def numbered(df: DataFrame, key: str = "station") -> DataFrame:
    """Add _row, the place of each row in its station by time from 0: its place in its block and the rows of the blocks
    before."""
    blocks, w = in_blocks(df, key)
    core = blocks.filter("core").withColumn("_in", F.row_number().over(w) - 1)
    sizes = core.groupBy(key, "block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("block").alias("_block"), before.alias("_before"))
    out = core.join(sizes, core[key].eqNullSafe(sizes["_key"]) & (core["block"] == sizes["_block"]))
    return out.withColumn("_row", F.col("_in") + F.col("_before")).drop("_in", "_before", "_key", "_block", "block", "core", "_us")


def only_core(df: DataFrame) -> DataFrame:
    return df.filter("core").drop("block", "core", "_us")


def remove_initial_offset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract each station's first row. An aggregate and a join, so that no station goes through one task."""
    first = df.groupBy("station").agg(*[F.min_by(F.struct(*columns), "t").alias("_first")])
    return df.join(first, "station").withColumns({c: F.col(c) - F.col(f"_first.{c}") for c in columns}).drop("_first")


def combine(left: DataFrame, right: DataFrame, columns: Sequence[tuple[str, str]], op: str, units: tuple[str, str] = ("mm", "mm")) -> DataFrame:
    """left op right at common epochs, column pair by column pair; result columns are named `left<op>right`. Sums and
    differences need equal units. Uncertainties are dropped."""
    if op not in "+-*/" or len(op) != 1:
        raise ValueError(op)
    if op in "+-" and units[0] != units[1]:
        raise ValueError(f"units differ: {units}")
    other = right.select("station", "t", *[F.col(b).alias(f"_r{k}") for k, (_, b) in enumerate(columns)])
    calc = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}[op]
    return left.join(other, ["station", "t"]).select("station", "t", *[calc(F.col(a), F.col(f"_r{k}")).alias(f"{a}{op}{b}") for k, (a, b) in enumerate(columns)])


def copy_uncertainties(target: DataFrame, origin: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance and covariance columns of `origin` at the epochs of `target`; NULL where it has none."""
    return target.drop(*columns).join(origin.select("station", "t", *columns), ["station", "t"], "left")


def posdef(spec: SeriesSpec, tol: float = 1e-9) -> Column:
    """Whether an epoch's covariance matrix is positive definite (leading minors, each above `tol` times the product of
    its variances, so that a singular matrix fails whatever its rounding; up to three components)."""
    v, c = [F.col(x) for x in spec.var], [F.col(x) for x in spec.cov]
    ok = v[0] > 0
    if len(v) > 1:
        ok &= (v[1] > 0) & (v[0] * v[1] - c[0] * c[0] > tol * v[0] * v[1])
    if len(v) == 3:
        a, b, d = c
        det = v[0] * (v[1] * v[2] - d * d) - a * (a * v[2] - d * b) + b * (a * d - v[1] * b)
        ok &= (v[2] > 0) & (det > tol * v[0] * v[1] * v[2])
    return ok


def correlation(cov: str, var_a: str, var_b: str) -> Column:
    """Correlation from covariance; NULL for a variance of zero."""
    return F.when((F.col(var_a) > 0) & (F.col(var_b) > 0), F.col(cov) / F.sqrt(F.col(var_a) * F.col(var_b)))


def dedup(df: DataFrame, keep: str, order: str) -> DataFrame:
    """Rows of repeated (station, t): keep the 'first' or 'last' by `order`, or 'none' of them. NULL keys are kept apart
    by value like any other."""
    cols = df.columns
    packed = F.struct(*cols)
    agg = {"first": F.min_by(packed, order), "last": F.max_by(packed, order), "none": F.min_by(packed, order)}[keep]
    out = df.groupBy("station", "t").agg(agg.alias("_row"), F.count("*").alias("_n"))
    if keep == "none":
        out = out.filter("_n = 1")
    return out.select("_row.*")
