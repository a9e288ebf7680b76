"""Exact quantiles of groups of any size.

Groups of up to HOT rows use the built-in exact percentile, whose state is the group's own histogram. For larger ones mergeable
sketches bracket the ranks asked for, the values below a bracket are counted, and only those inside it are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize, sized

HOT = 1_000_000
#: Size of the sketches and the first width of a bracket as a share of the rows, some ten times the sketch's rank error.
SKETCH_K, BRACKET = 2000, 0.01


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], hot: int | None = None) -> DataFrame:
    """key, q: array of the quantiles of the non-NULL values of each key, interpolated between neighbours (NULL in groups
    without a value). NaN counts as NULL. The result does not depend on `hot`."""
    hot = HOT if hot is None else hot
    d = df.select(key, F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"))
    counts = d.groupBy(key).agg(F.count("_v").alias("_n"))
    large = materialize(counts.filter((F.col("_n") > hot) & F.col(key).isNotNull()), "hot")  # at most rows / hot keys
    if large.isEmpty():
        return d.groupBy(key).agg(F.percentile("_v", list(probs)).alias("q"))
    small = d.join(sized(large.select(key)), key, "left_anti").groupBy(key).agg(F.percentile("_v", list(probs)).alias("q"))
    rest = d.filter("_v is not null").join(sized(large), key)
    out, left = small, materialize(large, "hot")
    width = BRACKET
    while True:
        found = _bracketed(rest.drop("_n").join(sized(left.select(key, "_n")), key), key, probs, width)
        found = materialize(found, "quantiles")
        done = found.filter(~F.exists("q", lambda x: x.isNull()))
        out = out.unionByName(done.select(key, "q"))
        left = materialize(left.join(done.select(key), key, "left_anti"), "hot")
        if left.isEmpty():
            return out
        width = min(1.0, width * 10)  # a sketch was off by more than the bracket


def _bracketed(d: DataFrame, key: str, probs: Sequence[float], width: float) -> DataFrame:
    """The quantiles whose rank lies inside its bracket, NULL for others."""
    ranks = [F.lit(float(p)) for p in probs]
    sketch = d.groupBy(key).agg(F.kll_sketch_agg_double("_v", SKETCH_K).alias("_k"), F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    at = lambda p: F.kll_sketch_get_quantile_double("_k", F.lit(p))
    low = [F.col("_min") if p - width <= 0 else at(p - width) for p in probs]
    high = [F.col("_max") if p + width >= 1 else at(p + width) for p in probs]
    bounds = materialize(sketch.select(key, "_n", F.array(*low).alias("_low"), F.array(*high).alias("_high"), F.array(*[(F.col("_n") - 1) * p for p in ranks]).alias("_pos")), "brackets")
    each = d.select(key, "_v").join(sized(bounds.select(key, "_low", "_high")), key)
    below = each.groupBy(key).agg(*[F.count_if(F.col("_v") < F.get("_low", F.lit(i))).alias(f"_b{i}") for i in range(len(probs))])
    hits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.when(F.col("_v").between(F.get("_low", i), F.get("_high", i)), i)), lambda i: i.isNotNull())
    inside = each.withColumn("_i", F.explode(hits)).groupBy(key, "_i", "_v").agg(F.count("*").alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(key, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_to", run).join(sized(below), key).join(sized(bounds.select(key, "_pos")), key)
    start = F.element_at(F.array(*[F.col(f"_b{i}") for i in range(len(probs))]), F.col("_i") + 1)
    pos = F.get("_pos", F.col("_i"))
    upto, after = start + F.col("_to"), start + F.col("_to") - F.col("_c")
    holds = lambda r: (r >= after) & (r < upto)
    picked = inside.groupBy(key, "_i").agg(F.max(F.when(holds(F.floor(pos)), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil(pos)), F.col("_v"))).alias("_b"), F.first(pos - F.floor(pos)).alias("_f"))
    value = picked.select(key, "_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_q"))
    packed = value.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_q"))).alias("_m"))
    return bounds.select(key).join(packed, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.when(F.col("_m").isNotNull(), F.try_element_at("_m", i))).alias("q"))
