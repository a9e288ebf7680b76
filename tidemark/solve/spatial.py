"""Stations coupled through their weights: each iteration takes, for every parameter, a distance-weighted median of the
neighbours' weights as the start of the next reweighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.network import coupling, weighted_median
from tidemark.session import materialize
from tidemark.solve.api import normal_sums, solve
from tidemark.solve.models import ModelSpec


def spatial_fit(obs: DataFrame, stations: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], penalty: float, spatial_models: Sequence[str], iterations: int = 5, var: Sequence[str] = (), cov: Sequence[str] = (), nearest: int = 4, low_km: float = 1.0, high_km: float = 3000.0, percentile: float = 0.5, zero: float = 1e-6, stop_changed: int = 0, **reweighting) -> tuple[DataFrame, list[dict]]:
    """(params, statistics by iteration: nonzeros, unique_nonzeros by component, l2_diff, changed).

    Stations couple with weights that fall with the distance (see network.coupling) down to a millionth. The observations
    are read once, for the normal sums; each iteration solves from those and writes its parameters to the shared folder.
    Other regularised models start each iteration from the penalty. With `cov` all components are solved together."""
    sums, joint = materialize(normal_sums(obs, specs, data, var, cov), "sums"), bool(cov)
    near = materialize(coupling(stations, nearest, low_km, high_km).select(F.col("station").alias("_to"), F.col("other").alias("station"), F.col("weight").alias("_near")), "near")
    kw = {"iters": 1, "kind": "inv", "eps": 1e-4} | reweighting
    params = materialize(solve(sums, specs, data, "lasso", penalty, joint, **kw), "params")
    stats: list[dict] = []
    for k in range(iterations):
        old = params
        known = params.filter(F.col("model").isin(list(spatial_models)) & F.col("regularized"))
        spread = known.select("station", "model", "par_ix", "comp", "weight").join(near, "station")
        median = weighted_median(spread, ["_to", "model", "par_ix", "comp"], "weight", "_near", percentile)
        weights = median.select(F.col("_to").alias("station"), "model", "par_ix", "comp", F.col("weighted_median").alias("weight")).filter("weight is not null")
        others = params.filter(~F.col("model").isin(list(spatial_models)) & F.col("regularized")).select("station", "model", "par_ix", "comp", F.lit(float(penalty)).alias("weight"))
        params = materialize(solve(sums, specs, data, "lasso", penalty, joint, weights.unionByName(others), **kw), "params")
        stats.append({"iteration": k + 1} | _statistics(params, old, spatial_models, zero))
        if stats[-1]["changed"] <= stop_changed:
            break
    return params, stats


def _statistics(params: DataFrame, old: DataFrame, models: Sequence[str], zero: float) -> dict:
    keys = ["station", "model", "par_ix", "comp"]
    both = params.filter(F.col("model").isin(list(models))).join(old.select(*keys, F.col("value").alias("_old")), keys)
    on, was = F.abs("value") > zero, F.abs("_old") > zero
    r = both.agg(F.count_if(on).alias("nonzeros"), F.sqrt(F.sum((F.col("value") - F.col("_old")) ** 2)).alias("l2_diff"), F.count_if(on != was).alias("changed")).first()
    unique = both.filter(on).groupBy("comp").agg(F.countDistinct("model", "par_ix").alias("n"))
    return {"nonzeros": r["nonzeros"], "l2_diff": r["l2_diff"], "changed": r["changed"], "unique_nonzeros": {x["comp"]: x["n"] for x in unique.collect()}}
