"""Models fitted to all stations of a network, and evaluated.

Only sums travel: every task adds the normal equations of the rows it holds, station by station, and the pieces are
added up row by row of the matrix. A station of any length costs one small matrix, no task ever holds its rows, and
solving again with other weights (reweighting, spatial coupling) reads the sums, not the observations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import starts
from tidemark.operators.series import laid
from tidemark.session import sized
from tidemark.solve import dense
from tidemark.solve.models import ModelSpec, columns, design_all

SUMS = "station string, comp string, i int, v array<double>"
PARAMS = "station string, model string, par_ix int, comp string, value double, var double, weight double, observable boolean, regularized boolean, n bigint, kkt double"
HELD_BYTES = 64 << 20


def normal_sums(obs: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], var: Sequence[str] = (), cov: Sequence[str] = ()) -> DataFrame:
    """station, comp, i, v: row i of GᵀWG, then GᵀWd, and for each column the number of non-zeros, largest and smallest
    value, and (n, dᵀWd). Without `cov` each component is on its own with W = 1/variance (1 without `var`; rows whose
    variance is not positive are left out); with `cov` all are solved together under comp '*', parameter-major, with
    each epoch's inverse covariance matrix, and rows with a NULL in any component are left out."""
    c, p = len(data), sum(s.num_parameters for s in specs)
    size = p * c if cov else p

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = [(s, k, i, a[i]) for (s, k), a in held.items() for i in range(size + 5)]
            return pd.DataFrame(out, columns=["station", "comp", "i", "v"])

        def add(key: tuple[str, str], g: np.ndarray, q: np.ndarray, b: np.ndarray, n: int, dd: float) -> None:
            a = held.get(key)
            if a is None:
                a = held[key] = np.zeros((size + 5, size))
                a[size + 2], a[size + 3] = -np.inf, np.inf
            wide = np.repeat(g, c, axis=1) if cov else g
            a[:size] += q
            a[size] += b
            a[size + 1] += (np.abs(wide) > 1e-8).sum(axis=0)
            a[size + 2] = np.maximum(a[size + 2], wide.max(axis=0))
            a[size + 3] = np.minimum(a[size + 3], wide.min(axis=0))
            a[size + 4, 0] += n
            a[size + 4, min(1, size - 1)] += dd if size > 1 else 0.0

        for pdf in frames:
            for station, part in pdf.groupby("station", sort=False):
                g = design_all(specs, part["_us"].to_numpy(np.int64))
                x = part[list(data)].to_numpy(float)
                if cov:
                    v, k = part[list(var)].to_numpy(float), part[list(cov)].to_numpy(float)
                    m = np.zeros((len(part), c, c))
                    m[:, range(c), range(c)] = v
                    at = 0
                    for i in range(c):
                        for j in range(i + 1, c):
                            m[:, i, j] = m[:, j, i] = k[:, at]
                            at += 1
                    ok = np.isfinite(x).all(axis=1) & np.isfinite(m).all(axis=(1, 2))
                    if not ok.any():
                        continue
                    w = np.linalg.pinv(m[ok], hermitian=True)
                    go, xo = g[ok], x[ok]
                    q = np.einsum("np,nq,nab->paqb", go, go, w, optimize=True).reshape(size, size)
                    wx = np.einsum("nab,nb->na", w, xo)
                    add((station, "*"), go, q, (go.T @ wx).ravel(), int(ok.sum()), float((xo * wx).sum()))
                else:
                    for j, name in enumerate(data):
                        ok = np.isfinite(x[:, j])
                        w = np.ones(len(part))
                        if var:
                            v = part[var[j]].to_numpy(float)
                            ok &= np.isfinite(v) & (v > 0)
                            w = 1 / np.where(ok, v, 1.0)
                        if ok.any():
                            go, wo = g[ok], w[ok]
                            gw = go * wo[:, None]
                            add((station, name), go, go.T @ gw, gw.T @ x[ok, j], int(ok.sum()), float((wo * x[ok, j] ** 2).sum()))
            if len(held) * (size + 5) * size * 8 > HELD_BYTES:
                yield rows()
                held.clear()
        if held:
            yield rows()

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # pieces of one row of one matrix stand together; the last may go on in the next batch
        last: tuple | None = None

        def joined(i: int, a: np.ndarray) -> np.ndarray:
            return a.max(axis=0) if i == size + 2 else a.min(axis=0) if i == size + 3 else a.sum(axis=0)

        for pdf in frames:
            if not len(pdf):
                continue
            s, k, i = (pdf[x].to_numpy() for x in ("station", "comp", "i"))
            v = np.stack(pdf["v"].to_numpy())
            first = np.flatnonzero(starts(s, k, i))
            out = []
            for a, b in zip(first, np.append(first[1:], len(s))):
                key, piece = (s[a], k[a], int(i[a])), joined(int(i[a]), v[a:b])
                if last and last[0] == key:
                    piece = joined(key[2], np.stack([last[1], piece]))
                elif last:
                    out.append((*last[0], last[1]))
                last = (key, piece)
            yield pd.DataFrame(out, columns=["station", "comp", "i", "v"])
        if last:
            yield pd.DataFrame([(*last[0], last[1])], columns=["station", "comp", "i", "v"])

    need = ["station", "_us", *data, *var, *cov]
    parts = laid(obs).filter("station is not null").select(*need).mapInPandas(run, SUMS)
    return parts.repartition("station", "comp").sortWithinPartitions("station", "comp", "i").mapInPandas(total, SUMS)


def _slot(specs: Sequence[ModelSpec], data: Sequence[str], joint: bool):
    """Place of a parameter row (model, par_ix, comp) in the vector of its group."""
    place, at = {}, 0
    for s in specs:
        place[s.name] = at
        at += s.num_parameters
    first = F.element_at(F.create_map(*[x for n, v in place.items() for x in (F.lit(n), F.lit(v))]), F.col("model")) + F.col("par_ix")
    return first * len(data) + F.array_position(F.array(*[F.lit(d) for d in data]), F.col("comp")).cast("int") - 1 if joint else first


def _with_vectors(sums: DataFrame, rows: DataFrame, value: str, i: int, size: int, slot, joint: bool) -> DataFrame:
    """The sums with one more row `i` a group: `value` of `rows` by place, NaN where it has none."""
    packed = rows.select("station", F.lit("*").alias("comp") if joint else "comp", slot.cast("int").alias("k"), F.col(value).cast("double").alias("x"))
    packed = packed.groupBy("station", "comp").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("w"))
    return sums.unionByName(packed.select("station", "comp", F.lit(i).alias("i"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at("w", k), F.lit(float("nan")))).alias("v")))


COVARIANCE = "station string, comp string, size int, cov array<double>"


def solve(sums: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], solver: str = "plain", penalty: float = 0.0, joint: bool = False, weights: DataFrame | None = None, formal_covariance: bool = True, signs: dict[str, int] | None = None, cov_zero: float = 1e-6, active: DataFrame | None = None, covariance: bool = False, **reweighting) -> DataFrame:
    """PARAMS rows from normal sums. solver: 'plain', 'ridge' or 'lasso' (with iters, kind, eps, scale, coupled for
    reweighting). A column without non-zeros, or of a regularised model with one or a constant value, is not observable:
    value 0, no variance. `weights`: station, model, par_ix, comp, weight to start the lasso from. `signs`: model name
    to +1 or -1 for parameters that may not have the other sign. `active`: station, model, par_ix, active; a parameter
    with active false is frozen: value 0, variance 0, left out of the fit. With `covariance`, COVARIANCE rows instead: the matrix of all
    parameters of a group, row by row, 0 where a parameter is not in the fit."""
    c, p = len(data), sum(s.num_parameters for s in specs)
    owner = [(s.name, k, s.regularize) for s in specs for k in range(s.num_parameters)]
    inner1 = np.array([x for s in specs for x in s.internal_scales()])
    sign1 = np.array([(signs or {}).get(n, 0) for n, _, _ in owner])
    size = p * c if joint else p
    label = [(*o, comp) for o in owner for comp in data] if joint else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        extra = {i: np.stack(g["v"].to_numpy())[0] for i, g in pdf[pdf["i"] < 0].groupby("i")}
        pdf = pdf[pdf["i"] >= 0].sort_values("i")
        if not len(pdf):  # weights of a group without readings
            return pd.DataFrame(columns=[f.split()[0] for f in (COVARIANCE if covariance else PARAMS).split(", ")])
        station, comp = pdf["station"].iloc[0], pdf["comp"].iloc[0]
        a = np.stack(pdf["v"].to_numpy())
        q, b, count, top, low = a[:size], a[size], a[size + 1], a[size + 2], a[size + 3]
        names = label or [(*o, comp) for o in owner]
        reg = np.array([x[2] for x in names])
        inner = np.repeat(inner1, c) if joint else inner1
        sign = np.repeat(sign1, c) if joint else sign1
        ok = (count > 0) & (~reg | ((count > 1) & (top > low)))
        frozen = extra[-2] == 0 if -2 in extra else np.zeros(size, bool)
        m, var, w, kkt = np.zeros(size), np.full(size, np.nan), np.full(size, np.nan), 0.0
        cov = np.zeros((size, size))
        var[frozen] = 0.0
        k = np.flatnonzero(ok & ~frozen)
        if len(k):
            qq, bb = q[np.ix_(k, k)], b[k]
            if solver == "ridge":
                qq = qq + np.diag(np.where(reg[k], penalty, 0.0))
            if solver == "lasso":
                init = np.where(np.isnan(extra[-1]), penalty, extra[-1])[k] if -1 in extra else None
                m[k], w[k], _, kkt = dense.lasso(qq, bb, reg[k], penalty, inner=inner[k], init=init, sign=sign[k], **reweighting)
            elif sign[k].any():
                m[k] = dense.bounded(qq, bb, sign[k])
            else:
                m[k] = dense.plain(qq, bb)
            if formal_covariance:
                used = k if solver != "lasso" else k[np.abs(m[k] * inner[k]) > cov_zero]
                if len(used):
                    part = np.ix_(used, used)
                    cov[part] = dense.pinvh(q[part] + (np.diag(np.where(reg[used], penalty, 0.0)) if solver == "ridge" else 0.0))
                    var[used] = np.diag(cov)[used]
        if covariance:
            return pd.DataFrame({"station": [station], "comp": [comp], "size": [size], "cov": [cov.ravel()]})
        n = int(a[size + 4][0])
        return pd.DataFrame([(station, x[0], x[1], x[3], m[i], var[i], w[i], bool(ok[i]), bool(x[2]), n, kkt) for i, x in enumerate(names)], columns=[f.split()[0] for f in PARAMS.split(", ")])

    rows, slot = sums, _slot(specs, data, joint)
    if weights is not None:
        rows = _with_vectors(rows, weights, "weight", -1, size, slot, joint)
    if active is not None:
        every = active.select("station", "model", "par_ix", "active").distinct().withColumn("comp", F.explode(F.array(*[F.lit(x) for x in data])))
        rows = _with_vectors(rows, every, "active", -2, size, slot, joint)
    return rows.groupBy("station", "comp").applyInPandas(run, COVARIANCE if covariance else PARAMS)  # a matrix to a group


def frozen(params: DataFrame, threshold: float = 1e-10) -> DataFrame:
    """station, model, par_ix, active: a parameter is active if it exceeds the threshold in size in any component. For
    `solve`; leaving it away unfreezes."""
    return params.groupBy("station", "model", "par_ix").agg(F.coalesce(F.max(F.abs("value")) > threshold, F.lit(False)).alias("active"))


def covariance_block(cov: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], model: str, par_ix: int) -> DataFrame:
    """station, comp, other, value: the block of one parameter between the components of a joint covariance."""
    at, low = {}, 0
    for s in specs:
        at[s.name], low = low, low + s.num_parameters
    first = (at[model] + par_ix) * len(data)
    cells = F.array(*[F.struct(F.lit(a).alias("comp"), F.lit(b).alias("other"), F.get("cov", F.col("size") * (first + i) + first + j).alias("value")) for i, a in enumerate(data) for j, b in enumerate(data)])
    return cov.filter("comp = '*'").select("station", F.explode(cells).alias("x")).select("station", "x.*")


def parameter_correlation(cov: DataFrame) -> DataFrame:
    """station, comp, i, j, corr of the parameters of each COVARIANCE row, for i < j; NULL where a variance is 0."""
    at = lambda i, j: F.get("cov", F.col("size") * i + j)
    pairs = cov.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda k: k > F.col("i"))))
    i, j = F.col("i"), F.col("j")
    return pairs.select("station", "comp", "i", "j", F.when((at(i, i) > 0) & (at(j, j) > 0), at(i, j) / F.sqrt(at(i, i) * at(j, j))).alias("corr"))


def two_components(params: DataFrame, block: DataFrame, model: str, par_ix: int, first: str, second: str) -> DataFrame:
    """station, value and variance of one parameter in two components, and their covariance (NULL without `block`)."""
    one = params.filter((F.col("model") == model) & (F.col("par_ix") == par_ix))
    pick = lambda comp, name: F.max(F.when(F.col("comp") == comp, F.col(name)))
    wide = one.groupBy("station").agg(pick(first, "value").alias("ve"), pick(second, "value").alias("vn"), pick(first, "var").alias("ve_var"), pick(second, "var").alias("vn_var"))
    cross = block.filter((F.col("comp") == first) & (F.col("other") == second)).select("station", F.col("value").alias("ve_vn_cov"))
    return wide.join(cross, "station", "left")


def stacked(params: DataFrame, model: str) -> DataFrame:
    """station, comp, values (the parameters of a model in order) and stackable: whether all stations have equally many."""
    rows = params.filter(F.col("model") == model).groupBy("station", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("par_ix", "value"))), lambda x: x["value"]).alias("values"))
    sizes = rows.agg((F.countDistinct(F.size("values")) == 1).alias("stackable"))
    return rows.join(F.broadcast(sizes))  # one row


def sum_fits(fits: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """The fits of several models (rows with `model`, from evaluate by_model) added up by station and epoch; variances,
    where there are any, add up too."""
    d = fits if models is None else fits.filter(F.col("model").isin(list(models)))
    cols = [c for c in fits.columns if c.startswith(("fit_", "var_"))]
    return d.groupBy("station", "t").agg(*[F.sum(c).alias(c) for c in cols])


def fit(obs: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], solver: str = "plain", var: Sequence[str] = (), cov: Sequence[str] = (), **kw) -> DataFrame:
    """Sums and solution in one: see normal_sums and solve."""
    return solve(normal_sums(obs, specs, data, var, cov), specs, data, solver, joint=bool(cov), **kw)


def _dense(values: str, size: int):
    """Array of `size` from a map of positions, 0 where it has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(values, i), F.lit(0.0)))


def evaluate(obs: DataFrame, params: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], by_model: bool = False) -> DataFrame:
    """Model values at the epochs of `obs`: station, t, fit_<comp> of all models together, or with by_model one row for
    each model with the same columns and `model`. Unobservable parameters count as 0. Stations without parameters are
    left out."""
    owner = [(s.name, k) for s in specs for k in range(s.num_parameters)]
    place = F.create_map(*[x for i, (n, k) in enumerate(owner) for x in (F.lit(f"{n}\x01{k}"), F.lit(i))])
    at = F.element_at(place, F.concat_ws("\x01", "model", F.col("par_ix").cast("string")))
    packed = (
        params.groupBy("station")
        .agg(*[F.map_from_entries(F.collect_list(F.when(F.col("comp") == c, F.struct(at.alias("i"), "value")))).alias(f"m_{c}") for c in data])
        .select("station", *[_dense(f"m_{c}", len(owner)).alias(f"p_{c}") for c in data])
    )
    g = [x for s in specs for x in columns(s)]
    rows = laid(obs.select("station", "t")).join(sized(packed), "station")
    rows = rows.withColumn("_g", F.array(*g))

    def dot(c: str, low: int, high: int):
        zero = F.lit(0.0)
        return F.aggregate(F.zip_with(F.slice("_g", low + 1, high - low), F.slice(f"p_{c}", low + 1, high - low), lambda a, b: a * b), zero, lambda s, x: s + x)

    if not by_model:
        return rows.select("station", "t", *[dot(c, 0, len(owner)).alias(f"fit_{c}") for c in data])
    parts, low = [], 0
    for s in specs:
        high = low + s.num_parameters
        parts.append(F.struct(F.lit(s.name).alias("model"), *[dot(c, low, high).alias(f"fit_{c}") for c in data]))
        low = high
    return rows.select("station", "t", F.explode(F.array(*parts)).alias("x")).select("station", "t", "x.*")


def evaluate_variance(obs: DataFrame, cov: DataFrame, specs: Sequence[ModelSpec], data: Sequence[str], rows_at_once: int = 200_000) -> DataFrame:
    """Formal covariance of the fit at the epochs of `obs`: station, t, var_<comp>, and with a joint `cov` also
    cov_<comp>_<other>. A station's epochs are spread over as many groups as it has `rows_at_once`; stations without a
    covariance are left out."""
    joint = [(a, b) for i, a in enumerate(data) for b in data[i + 1 :]]
    names = [f"var_{c}" for c in data] + [f"cov_{a}_{b}" for a, b in joint]
    rows = laid(obs.select("station", "t"))
    parts = rows.groupBy("station").agg(F.ceil(F.count("*") / rows_at_once).cast("int").alias("_n"))
    kind = obs.schema["t"].dataType.simpleString()
    held = cov.groupBy("station").agg(F.collect_list(F.struct("comp", "size", "cov")).alias("held"))
    held = held.join(parts, "station").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    rows = rows.join(sized(parts), "station").withColumn("part", F.pmod(F.xxhash64("t"), F.col("_n")).cast("int")).drop("_n")

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=pdf.index, columns=names)
        out.insert(0, "t", pdf["t"])
        out.insert(0, "station", pdf["station"])
        if not len(pdf) or not len(known):
            return out.iloc[:0]
        g = design_all(specs, pdf["_us"].to_numpy(np.int64))
        c = len(data)
        for x in known["held"].iloc[0]:
            m = np.asarray(x["cov"], float).reshape(x["size"], x["size"])
            if x["comp"] != "*":
                out[f"var_{x['comp']}"] = ((g @ m) * g).sum(axis=1)
                continue
            for i, a in enumerate(data):
                out[f"var_{a}"] = ((g @ m[i::c, i::c]) * g).sum(axis=1)
                for j in range(i + 1, c):
                    out[f"cov_{a}_{data[j]}"] = ((g @ m[i::c, j::c]) * g).sum(axis=1)
        return out

    got = rows.groupBy("station", "part").cogroup(held.groupBy("station", "part")).applyInPandas(run, f"station string, t {kind}, " + ", ".join(f"{n} double" for n in names))
    return got.select("station", "t", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def residuals(obs: DataFrame, fits: DataFrame, data: Sequence[str]) -> DataFrame:
    """obs - fit at common epochs."""
    return obs.select("station", "t", *data).join(fits, ["station", "t"]).select("station", "t", *[(F.col(c) - F.col(f"fit_{c}")).alias(c) for c in data])
