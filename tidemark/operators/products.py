"""The tables behind pictures of a network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import remove_initial_offset
from tidemark.solve.models import ModelSpec, design


def displacement_paths(obs: DataFrame, east: str = "east", north: str = "north") -> DataFrame:
    """station, t, de, dn, distance and azimuth (degrees from north) since the first epoch with both components."""
    d = obs.select("station", "t", F.col(east).alias("de"), F.col(north).alias("dn")).dropna()
    d = remove_initial_offset(d, ["de", "dn"])
    return d.withColumns({"distance": F.sqrt(F.col("de") ** 2 + F.col("dn") ** 2), "azimuth": F.pmod(90 - F.degrees(F.atan2("dn", "de")), F.lit(360.0))})


def amplitude_phase(params: DataFrame, model: str) -> DataFrame:
    """station, comp, amplitude, phase and month of the largest value of a sinusoid's two parameters."""
    p = params.filter(F.col("model") == model).groupBy("station", "comp").agg(*[F.max(F.when(F.col("par_ix") == i, F.col("value"))).alias(n) for i, n in enumerate("ab")])
    phase = F.atan2("b", "a")
    return p.select("station", "comp", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).alias("amplitude"), phase.alias("phase"), (F.pmod(phase, F.lit(2 * np.pi)) / (2 * np.pi) * 12).alias("month"))


def scalogram(spec: ModelSpec, params: pd.DataFrame, us: np.ndarray) -> pd.DataFrame:
    """scale, j, t, value: each spline's share of the row-normalised size over time (`params` of one station and
    component, in order)."""
    rate = np.abs(np.gradient(design(spec, us), axis=0) if spec.kw.get("splineclass", "ISpline") == "ISpline" else design(spec, us)) * np.abs(params["value"].to_numpy())
    total = rate.sum(axis=1, keepdims=True)
    share = np.divide(rate, total, out=np.zeros_like(rate), where=total > 0)
    rows = [(s[2], j, int(t), share[k, j]) for j, s in enumerate(spec.splines()) for k, t in enumerate(us)]
    return pd.DataFrame(rows, columns=["scale", "j", "t", "value"])


def parameter_correlation(cov: np.ndarray) -> np.ndarray:
    """Correlations of a covariance matrix; NaN where a variance is zero."""
    s = np.sqrt(np.diag(cov))
    with np.errstate(all="ignore"):
        return np.where(np.outer(s, s) > 0, cov / np.outer(s, s), np.nan)


def active_parameters(params: DataFrame, threshold: float) -> DataFrame:
    """params with `active`: whether any component of the parameter is larger than the threshold in size."""
    on = params.groupBy("station", "model", "par_ix").agg((F.max(F.abs("value")) > threshold).alias("active"))
    return params.join(on, ["station", "model", "par_ix"])
