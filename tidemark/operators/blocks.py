"""Ordered work within a key, without ever putting a hot key into one task.

`ordered_blocks` cuts the rows of every key that is larger than `block_rows` at approximate quantiles of the
ordering column and hands each block the neighbouring sixteenth of a block on either side as a halo. Keys below the
limit, which is nearly all, stay whole and cost nothing. `whole_groups` then lets a Python function see complete
blocks, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
CELLS = 16


def ordered_blocks(df: DataFrame, key: str, order: str, counted: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `block` (int) and `core` (boolean) to `df`.

    Every row is core in exactly one block of its key; rows near a cut appear again, with core false, in the block
    across the cut. A halo holds at least block_rows/33 rows, blocks at most about block_rows rows.
    `counted`: a frame with the same key column and at least as many rows of each key that is cheaper to count.
    Rows need a non-null integer `order`. An empty frame gives an empty frame.
    """
    counts = (df if counted is None else counted).groupBy(key).count()
    whole = df.withColumn("block", F.lit(0)).withColumn("core", F.lit(True))
    classes = [
        r[0]
        for r in counts.filter(F.col("count") > block_rows)
        .select(F.ceil(F.log2(F.col("count") / F.lit(float(block_rows)))).cast("int").alias("k"))
        .distinct()
        .collect()  # at most one row per power of two
    ]
    if not classes:
        return whole
    hot = counts.filter(F.col("count") > block_rows).select(key, F.ceil(F.log2(F.col("count") / F.lit(float(block_rows)))).cast("int").alias("_k"))
    cuts = None
    for k in sorted(classes):
        n = CELLS * 2**k
        # rank error of the sketch: 1/64 of a cell
        part = (
            df.select(key, order)
            .join(F.broadcast(hot.filter(F.col("_k") == k).select(key)), key)  # at most rows/block_rows keys
            .groupBy(key)
            .agg(F.percentile_approx(order, [i / n for i in range(1, n)], n * 64).alias("_cuts"))
            .withColumn("_n", F.lit(2**k))
        )
        cuts = part if cuts is None else cuts.unionByName(part)
    marked = df.join(F.broadcast(cuts), key, "left")
    cell = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    marked = marked.withColumn("_cell", F.when(F.col("_cuts").isNull(), F.lit(None)).otherwise(cell))
    own = F.floor(F.col("_cell") / F.lit(CELLS)).cast("int")
    at = F.pmod(F.col("_cell"), F.lit(CELLS))
    places = F.when(F.col("_cell").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.lit(True).alias("core")))).otherwise(
        F.filter(
            F.array(
                F.struct(own.alias("block"), F.lit(True).alias("core")),
                F.struct(F.when((at == 0) & (own > 0), own - 1).alias("block"), F.lit(False).alias("core")),
                F.struct(F.when((at == CELLS - 1) & (own < F.col("_n") - 1), own + 1).alias("block"), F.lit(False).alias("core")),
            ),
            lambda p: p["block"].isNotNull(),
        )
    )
    return marked.withColumn("_place", F.explode(places)).select(*df.columns, F.col("_place.block").alias("block"), F.col("_place.core").alias("core"))


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition sorted by `keys` so that no group is split. Holds one batch and one group."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        same = not held or all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
        if cut == 0 and same:
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def starts(*cols: np.ndarray) -> np.ndarray:
    """True where a new run of equal key values begins."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new
