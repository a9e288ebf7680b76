"""Steps in series: a window with and without an offset in its middle, compared by the corrected Akaike criterion.

Residual sums of squares come from moments over ROWS frames, centred on the middle of each window in time and on the
station's mean in value, so they stay accurate. Everything is a window expression over blocks of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import in_blocks, only_core

MIN_SIDE = 2


def aicc(rss: Column, n: Column, k: int) -> Column:
    """n ln(rss/n) + 2K + 2K(K+1)/(n-K-1); NULL where n-K-1 <= 0 or rss is not positive."""
    return F.when((n - k - 1 > 0) & (rss > 0), n * F.log(rss / n) + 2.0 * k + 2.0 * k * (k + 1) / (n - k - 1))


def _scored(d: DataFrame, ok: Column, max_del: float) -> DataFrame:
    """probability, var0 and var1 from the number and the sums of t, x, tt, tx, xx on both sides (a before, b from the row
    on)."""
    c = F.col
    n = c("_na") + c("_nb")
    tm, xm = (c("_ta") + c("_tb")) / n, (c("_xa") + c("_xb")) / n
    stt = c("_tta") + c("_ttb") - n * tm * tm
    stx = c("_txa") + c("_txb") - n * tm * xm
    sxx = c("_xxa") + c("_xxb") - n * xm * xm
    rss0 = sxx - F.try_divide(stx * stx, stt)
    # with an offset on the second side each side has its own mean and both share the slope
    wtt = c("_tta") - c("_ta") * c("_ta") / c("_na") + c("_ttb") - c("_tb") * c("_tb") / c("_nb")
    wtx = c("_txa") - c("_ta") * c("_xa") / c("_na") + c("_txb") - c("_tb") * c("_xb") / c("_nb")
    wxx = c("_xxa") - c("_xa") * c("_xa") / c("_na") + c("_xxb") - c("_xb") * c("_xb") / c("_nb")
    rss1 = wxx - F.try_divide(wtx * wtx, wtt)
    ok = ok & (c("_na") >= MIN_SIDE) & (c("_nb") >= MIN_SIDE)
    d = d.withColumn("_rss0", F.when(ok, rss0)).withColumn("_rss1", F.when(ok, rss1)).withColumn("_n", n)
    delta = aicc(c("_rss0"), c("_n"), 3) - aicc(c("_rss1"), c("_n"), 4)
    return d.withColumn("probability", F.when(delta > max_del, delta)).withColumn("var0", c("_rss0") / c("_n")).withColumn("var1", c("_rss1") / c("_n"))


def step_scores(df: DataFrame, column: str, kernel: int, max_del: float = 0.0, kernel_min: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Per row: station, t, probability (AICc difference if the step wins by more than max_del, else NULL), var0, var1
    (residual variance without and with the step). The window is `kernel` (odd) rows centred on the row; nearer to an end of
    the series it shrinks on both sides, down to `kernel_min` rows (default: kernel, no shrinking), below which a row has
    no score. Rows with fewer than two values on either side have none. The step begins at the row itself. `only`: station,
    t of the rows wanted."""
    if kernel % 2 == 0 or kernel < 3:
        raise ValueError("kernel must be odd and at least 3")
    half, least = kernel // 2, kernel if kernel_min is None else kernel_min
    mean = df.groupBy("station").agg(F.avg(column).alias("_m"))
    blocks, w = in_blocks(df.select("station", "t", column).join(mean, "station"), reach=2 * half)
    pre, post = w.rowsBetween(-half, -1), w.rowsBetween(0, half)
    whole = Window.partitionBy("station", "block")
    d = blocks.withColumn("_x", F.col(column) - F.col("_m")).withColumn("_day", F.when(F.col(column).isNotNull(), (F.col("_us") - F.min("_us").over(whole)) / 86_400e6))
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_h", F.least(F.col("_rn") - 1, F.count(F.lit(1)).over(whole) - F.col("_rn")))
    s = lambda e, frame: F.coalesce(F.sum(e).over(frame), F.lit(0.0))
    x, tt = F.col("_x"), F.col("_day")
    values = {"t": tt, "x": x, "tt": tt * tt, "tx": tt * x, "xx": x * x}
    main = d
    for side, frame in (("a", pre), ("b", post)):
        main = main.withColumns({f"_n{side}": F.count(x).over(frame).cast("double")} | {f"_{k}{side}": s(v, frame) for k, v in values.items()})
    keep = ["station", "t", "_us", "core", "block", "probability", "var0", "var1"]
    shrunk = F.col("_h") < half
    if least >= kernel:
        scored = _scored(main, ~shrunk, max_del).select(*keep)
    else:
        # the rows at the ends of a series meet the rows around them, at most kernel of them each
        inner = _scored(main, F.lit(True), max_del).filter(~shrunk).select(*keep)
        side = lambda near: F.when(near, F.lit(0)).otherwise(1)
        rows = d.withColumn("_cnt", F.count(F.lit(1)).over(whole))
        mine = rows.filter(shrunk & F.col("core")).select("station", "t", "_us", "core", "block", F.col("_rn").alias("_i"), "_h", F.col("_us").alias("_us0"), side(F.col("_rn") - 1 <= F.col("_cnt") - F.col("_rn")).alias("_end"))
        ends = F.filter(F.array(F.when(F.col("_rn") <= 2 * half, 0), F.when(F.col("_cnt") - F.col("_rn") < 2 * half, 1)), lambda e: e.isNotNull())
        other = rows.withColumn("_end", F.explode(ends)).select("station", "block", "_end", F.col("_rn").alias("_j"), F.col("_us").alias("_us1"), "_x")
        pairs = mine.join(other, ["station", "block", "_end"]).filter(F.abs(F.col("_j") - F.col("_i")) <= F.col("_h"))
        pairs = pairs.withColumn("_t", (F.col("_us1") - F.col("_us0")) / 86_400e6)
        t1, x1 = F.when(F.col("_x").isNotNull(), F.col("_t")), F.col("_x")
        each = {"t": t1, "x": x1, "tt": t1 * t1, "tx": t1 * x1, "xx": x1 * x1}
        before = F.col("_j") < F.col("_i")
        aggs = []
        for name, where in (("a", before), ("b", ~before)):
            aggs.append(F.count(F.when(where, x1)).cast("double").alias(f"_n{name}"))
            aggs += [F.coalesce(F.sum(F.when(where, v)), F.lit(0.0)).alias(f"_{k}{name}") for k, v in each.items()]
        outer = pairs.groupBy("station", "t", "_us", "core", "block", "_h").agg(*aggs)
        outer = _scored(outer, 2 * F.col("_h") + 1 >= least, max_del).select(*keep)
        scored = inner.unionByName(outer)
    out = only_core(scored).select("station", "t", "probability", "var0", "var1")
    return out if only is None else out.join(only.select("station", "t").distinct(), ["station", "t"], "left_semi")


def over_components(scores: list[DataFrame]) -> DataFrame:
    """The scores of several components as one: at each row the highest, with the variances that belong to it."""
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    best = F.max_by(F.struct("probability", "var0", "var1"), F.coalesce("probability", F.lit(-1.0)))
    return every.groupBy("station", "t").agg(best.alias("_b")).select("station", "t", "_b.*")


def step_peaks(scores: DataFrame, threshold: float, max_steps: int | None = None) -> DataFrame:
    """Local maxima of the score at or above the threshold: strict peaks, of a plateau the (left of the) middle, never
    an end of the series; with max_steps the highest of each station (ties: earlier first). Adds varred =
    (var0 - var1) / var0."""
    blocks, w = in_blocks(scores)
    d = blocks.withColumn("_p", F.coalesce("probability", F.lit(-1.0)))
    d = d.withColumn("_run", F.sum(F.coalesce((F.col("_p") != F.lag("_p").over(w)).cast("int"), F.lit(1))).over(w))
    edge = d.groupBy("station", "block", "_run").agg(F.first("_p").alias("_p"), F.min("_us").alias("_a"), F.count("*").alias("_len"))
    g = Window.partitionBy("station", "block").orderBy("_a")
    edge = edge.withColumn("_before", F.lag("_p").over(g)).withColumn("_after", F.lead("_p").over(g))
    tops = edge.filter((F.col("_p") > F.col("_before")) & (F.col("_p") > F.col("_after")) & (F.col("_p") >= threshold)).select("station", "block", "_run", "_len")
    place = F.row_number().over(Window.partitionBy("station", "block", "_run").orderBy("_us")) - 1
    hit = d.join(tops, ["station", "block", "_run"]).withColumn("_k", place).filter(F.col("_k") == F.floor((F.col("_len") - 1) / 2))
    out = only_core(hit).select("station", "t", "probability", "var0", "var1", F.try_divide(F.col("var0") - F.col("var1"), F.col("var0")).alias("varred"))
    if max_steps is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("station").orderBy(F.desc("probability"), "t"))).filter(F.col("_r") <= max_steps).drop("_r")
    return out
