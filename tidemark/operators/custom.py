"""Functions of the user on each series or on the whole network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import in_blocks


def on_each_series(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, reach: int | None = None) -> DataFrame:
    """`function` on the rows of each station, by time, as pandas. Without `reach` a station is one call, whatever its
    size, and may return any rows of `schema`. With `reach`, the number of rows to either side that a row's result depends on, long stations
    are cut into blocks with halos; the function must then return the columns `station` and `t` and its results are kept
    for the rows that belong to the block."""
    if reach is None:
        return df.groupBy("station").applyInPandas(lambda pdf: function(pdf.sort_values("t", kind="stable").reset_index(drop=True)), schema)
    blocks, _ = in_blocks(df, reach=reach)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us", kind="stable").reset_index(drop=True)
        out = function(pdf.drop(columns=["block", "core", "_us"]))
        return out[out["t"].isin(pdf.loc[pdf["core"], "t"])]

    return blocks.groupBy("station", "block").applyInPandas(run, schema)


def on_network(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`function` on the frame of all stations: whatever DataFrame operations it is made of are distributed."""
    return df.transform(function)


def on_epochs(df: DataFrame, column: str, function: Callable[[pd.Series], pd.Series], schema: str, minimum: int = 1) -> DataFrame:
    """`function` across the network at each epoch: it gets the values of `column` by station (a row a station) and
    returns values by station; epochs with fewer than `minimum` readings are left out. `schema` names station, t and the
    result column."""
    name = schema.split(",")[-1].split()[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.groupby("station")[column].mean()
        if len(x) < minimum:
            return pd.DataFrame({"station": pd.Series(dtype=object), "t": pdf["t"].iloc[:0], name: pd.Series(dtype=float)})
        out = function(x)
        return pd.DataFrame({"station": list(out.index), "t": pdf["t"].iloc[0], name: out.to_numpy()})

    return df.select("station", "t", column).filter(F.col(column).isNotNull()).groupBy("t").applyInPandas(run, schema)
