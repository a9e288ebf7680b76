"""Robust trends from pairs of epochs one year apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeunits import decimal_year

OUT = "station string, comp string, intercept double, velocity double, velocity_sd double, n_epochs int, n_pairs int, n_used int, n_steps int, frac_removed double, sd_pairs double"


def year_pairs(t: np.ndarray, steps: np.ndarray, tol: float = 0.001) -> list[tuple[int, int]]:
    """Pairs (i, j) of epochs a year apart within tol, else the next free epoch beyond a year, without a step between
    them. The search for stand-ins goes on from where the last one ended. `t` ascending, in years."""
    out: list[tuple[int, int]] = []
    n, spare = len(t), 0
    following = np.searchsorted(steps, t - tol, "right")  # the first step later than the epoch
    for i in range(n):
        if t[i] > t[-1] + tol - 1:
            break
        step = steps[following[i]] if following[i] < len(steps) else np.inf
        if t[i] > step + tol - 1:
            continue
        j = int(np.searchsorted(t, t[i] + 1 - tol, "left"))
        if j <= i or j >= n:
            continue
        if t[j] > step - tol:
            spare = max(spare, j)
            continue
        spare = max(spare, j)
        if t[j] - t[i] - 1 < tol:
            out.append((i, j))
        elif t[spare] > step - tol:
            spare = 0
        else:
            out.append((i, spare))
            spare = 0 if spare == n - 1 else spare + 1
    return out


def midas_one(t: np.ndarray, x: np.ndarray, steps: np.ndarray, tol: float = 0.001) -> dict:
    n = len(t)
    forward = year_pairs(t, np.sort(steps), tol)
    back = [(n - 1 - j, n - 1 - i) for i, j in year_pairs(-t[::-1], np.sort(-steps), tol)]
    pairs = np.array(forward + back, int).reshape(-1, 2)
    if not len(pairs):
        return {"velocity": np.nan, "intercept": np.nan, "velocity_sd": np.nan, "n_pairs": 0, "n_used": 0, "frac_removed": np.nan, "sd_pairs": np.nan}
    off = x[0] if np.isfinite(x[0]) else 0.0
    y = x - off
    v = (y[pairs[:, 1]] - y[pairs[:, 0]]) / (t[pairs[:, 1]] - t[pairs[:, 0]])
    with np.errstate(all="ignore"):
        mid = np.nanmedian(v)
        dev = np.abs(v - mid)
        v = np.where(dev >= 2 * 1.4826 * np.nanmedian(dev), np.nan, v)
        kept = int(np.isfinite(v).sum())
        mid = np.nanmedian(v)
        sd = 1.4826 * np.nanmedian(np.abs(v - mid))
        return {"velocity": mid, "intercept": np.nanmedian(y - mid * (t - t[0])) + off, "velocity_sd": 1.2533 * sd / np.sqrt(kept / 4) * 3 if kept else np.nan, "n_pairs": len(pairs), "n_used": len(np.unique(pairs)), "frac_removed": (len(pairs) - kept) / len(pairs), "sd_pairs": sd}


def midas(obs: DataFrame, data: list[str], steps: DataFrame | None = None, tol: float = 0.001) -> DataFrame:
    """Trend per year of each station and component, with the intercept at its first epoch (OUT columns).

    The method knows days, not times of day: the first reading of each day counts, which bounds a station by its
    calendar. `steps`: station, time. NULL readings are no values; stations without pairs have NULL."""
    day = obs.groupBy("station", F.to_date("t").alias("day")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c) for c in data])
    rows = day.withColumn("dy", decimal_year("day")).drop("day").withColumn("is_step", F.lit(False))
    if steps is not None:
        s = steps.select("station", decimal_year("time").alias("dy")).dropna().distinct().join(rows.select("station").distinct(), "station", "left_semi")
        rows = rows.unionByName(s.withColumn("is_step", F.lit(True)), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        st = pdf.loc[pdf["is_step"], "dy"].to_numpy(float)
        pdf = pdf[~pdf["is_step"]].sort_values("dy")
        out = []
        for c in data:
            r = midas_one(pdf["dy"].to_numpy(float), pdf[c].to_numpy(float), st, tol)
            out.append({"station": pdf["station"].iloc[0], "comp": c, "n_epochs": len(pdf), "n_steps": len(st)} | r)
        return pd.DataFrame(out)[[f.split()[0] for f in OUT.split(", ")]]

    return rows.groupBy("station").applyInPandas(run, OUT)
