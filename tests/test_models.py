import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.operators import products
from tidemark.operators.series import SeriesSpec, block_permutation, cov_index_map
from tidemark.solve import api, decompose, dense, fields, midas, noise, spatial
from tidemark.solve.models import ModelSpec, center_times, clamped_bspline_basis, columns, design, design_all, exponent_index, from_arch, to_arch, transient_periods
from tidemark.sources import netjson

US = 86_400_000_000
DAY0 = int(np.datetime64("2000-01-01", "us").astype(np.int64))
SPECS = [
    ModelSpec("step", "Step", {"steptimes": ["2001-05-01", "2000-03-01"]}),
    ModelSpec("poly", "Polynomial", {"order": 2}, "2000-06-01", "Y"),
    ModelSpec("bs", "BSpline", {"degree": 3, "scale": 90.0, "num_splines": 4, "spacing": 60.0}),
    ModelSpec("is", "ISpline", {"degree": 2, "scale": 50.0, "num_splines": 2}),
    ModelSpec("set", "SplineSet", {"degree": 2, "t_center_start": "2000-01-01", "t_center_end": "2001-12-31", "list_num_knots": [3, 5]}, regularize=True),
    ModelSpec("decay", "DecayingSplineSet", {"degree": 2, "t_center_start": "2000-05-01", "list_scales": [20.0, 80.0], "list_num_splines": [3, 2]}),
    ModelSpec("sin", "Sinusoid", {"period": 365.25}, t_start="2000-03-01", t_end="2001-03-01"),
    ModelSpec("log", "Logarithmic", {"tau": [5.0, 50.0]}, "2000-08-01"),
    ModelSpec("exp", "Exponential", {"tau": 30.0}, "2000-08-01", t_end="2001-01-01"),
    ModelSpec("atan", "Arctangent", {"tau": 20.0}, "2001-01-01"),
    ModelSpec("tanh", "HyperbolicTangent", {"tau": 20.0}, "2001-01-01"),
    ModelSpec("mod", "AmpPhModulatedSinusoid", {"period": 100.0, "degree": 2, "num_bases": 6}, t_start="2000-02-01", t_end="2001-09-01"),
    ModelSpec("mod3", "AmpPhModulatedSinusoid", {"period": 365.25, "degree": 3, "num_bases": 4}, t_start="2000-02-01", t_end="2001-09-01"),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_columns_equal_numpy(spark, spec):
    us = DAY0 + np.arange(-30, 760, 3, dtype=np.int64) * US + 3_600_000_000
    df = spark.createDataFrame(pd.DataFrame({"_us": us}))
    got = df.select("_us", *[c.cast("double").alias(f"g{i}") for i, c in enumerate(columns(spec))]).toPandas().sort_values("_us").to_numpy()[:, 1:].astype(float)
    want = design(spec, us)
    assert want.shape[1] == spec.num_parameters == len(spec.internal_scales())
    assert np.allclose(got, want, atol=1e-12)


def test_splines():
    us = DAY0 + np.arange(0, 400, dtype=np.int64) * US
    whole = design(ModelSpec("b", "BSpline", {"degree": 2, "scale": 50.0, "num_splines": 15}), us[100:300])
    assert np.allclose(whole.sum(axis=1), 1)  # a partition of unity
    rise = design(ModelSpec("i", "ISpline", {"degree": 2, "scale": 50.0}, "2000-06-01"), us)[:, 0]
    assert rise[0] == 0 and rise[-1] == 1 and (np.diff(rise) >= 0).all()
    h = clamped_bspline_basis(np.linspace(0, 1, 101), 2, 6)
    assert np.allclose(h.sum(axis=1), 1) and h.shape == (101, 6)
    mod = design(ModelSpec("m", "AmpPhModulatedSinusoid", {"period": 100.0, "degree": 2, "num_bases": 5}, t_start="2000-02-01", t_end="2001-01-01"), us)
    assert mod.shape == (400, 10) and not mod[:20].any()
    assert ModelSpec("s", "SplineSet", {"degree": 2, "t_center_start": "2000-01-01", "t_center_end": "2020-01-01", "list_num_knots": [4, 8, 16, 32, 64, 128]}).num_parameters == 264
    with pytest.raises(ValueError):
        ModelSpec("l", "Logarithmic", {"tau": 1.0}, "2000-01-02", t_start="2000-01-01")


def test_json():
    for s in SPECS:
        assert ModelSpec.from_json(s.to_json()) == s
    back = from_arch(json.loads(json.dumps(to_arch(SPECS))))
    assert [(s.name, s.num_parameters) for s in back] == [(s.name, s.num_parameters) for s in SPECS]
    text = netjson.dump("net", {"A": [1, 2, 3]}, {"d": SPECS[:2]}, {"A": {"d": [SPECS[0]], "gone": [SPECS[3]]}}, {"A": {"d": {"type": "tenv3", "kw_args": {}}}})
    net = netjson.load(text)
    assert [m.name for m in net["stations"]["A"]["models"]["d"]] == ["step", "poly"] and list(net["stations"]["A"]["unused"]) == ["gone"]


def test_index_maps():
    assert cov_index_map(2) == [0, 2, 2, 1]
    assert SeriesSpec(("a", "b", "c"), var=("x", "y", "z"), cov=("ab", "ac", "bc")).covs_of(1) == ["ab", "bc"]
    b = np.zeros((4, 4))
    b[:2, :2], b[2:, 2:] = [[0, 1], [2, 3]], 1
    p = block_permutation(2, 2)
    assert b[np.ix_(p, p)].tolist() == [[0, 0, 1, 0], [0, 1, 0, 1], [2, 0, 3, 0], [0, 1, 0, 1]]


# --- dense solvers ---


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_lasso_optimality(seed):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(60, 25)) @ rng.normal(size=(25, 25))
    y = rng.normal(size=60)
    q, b = g.T @ g, g.T @ y
    lam = np.where(np.arange(25) < 3, 0, rng.uniform(0.5, 40, 25))
    m, kkt = dense.feature_sign(q, b, lam)
    grad = 2 * (b - q @ m)
    tol = 1e-5 * max(1, np.abs(b).max())
    assert (np.abs(grad) <= lam + tol).all()
    on = m != 0
    assert np.allclose(grad[on], (lam * np.sign(m))[on], atol=tol) and kkt <= tol


def test_bounded():
    rng = np.random.default_rng(1)
    g, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    sign = np.array([1, -1, 0, 1, 1, 0])
    m = dense.bounded(g.T @ g, g.T @ y, sign)
    grad = g.T @ (y - g @ m)
    assert (m * sign >= 0).all() and np.allclose(grad[(m != 0) | (sign == 0)], 0, atol=1e-8) and (grad * sign <= 1e-8).all()


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_lasso_with_signs(seed):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(60, 12)) @ rng.normal(size=(12, 12))
    y = rng.normal(size=60) * 5
    q, b = g.T @ g, g.T @ y
    lam = np.where(np.arange(12) < 4, 0, rng.uniform(0.5, 40, 12))
    sign = rng.integers(-1, 2, 12)
    m, _ = dense.feature_sign(q, b, lam, sign=sign)
    assert (m * sign >= 0).all()
    grad, tol = 2 * (b - q @ m), 2e-5 * max(1, np.abs(b).max())
    on = m != 0
    assert np.allclose(grad[on], (lam * np.sign(m))[on], atol=tol)
    assert (np.where(sign != 0, grad * sign, np.abs(grad))[~on] <= lam[~on] + tol).all()


def test_published_single_station(spark):
    """Residual deviation 0.009065 of the simple one-station series."""
    t = pd.date_range("2000-01-01", "2000-12-31")
    us = t.to_numpy("datetime64[us]").astype(np.int64)
    specs = [ModelSpec("p", "Polynomial", {"order": 1}), ModelSpec("a", "Sinusoid", {"period": 365.25}), ModelSpec("s", "Step", {"steptimes": ["2000-03-01", "2000-10-10", "2000-10-15"]})]
    truth = design_all(specs, us) @ np.array([-1, 5e-3, 0.3, 0, 0.5, 0.2, -0.01])
    x = truth + np.random.default_rng(1).normal(scale=0.01, size=len(t))
    obs = spark.createDataFrame(pd.DataFrame({"station": "S", "t": t, "total": x})).withColumn("t", F.col("t").cast("timestamp_ntz"))
    p = api.fit(obs, specs, ["total"])
    res = api.residuals(obs, api.evaluate(obs, p, specs, ["total"]), ["total"]).toPandas().total
    assert res.std() == pytest.approx(0.009065, abs=2e-6)


def test_published_transient_station():
    """Plain 2.046, ridge 2.088274, L1 2.0778 and L0 2.07156 residual deviations; 264, 76±2 and 67±2 non-zeros."""
    t = pd.date_range("2000-01-01", "2020-01-01")
    us = t.to_numpy("datetime64[us]").astype(np.int64)
    base = [ModelSpec("p", "Polynomial", {"order": 1}), ModelSpec("a", "Sinusoid", {"period": 365.25}), ModelSpec("h", "Sinusoid", {"period": 365.25 / 2})]
    arc = [ModelSpec(f"t{k}", "Arctangent", {"tau": tau}, when) for k, (tau, when) in enumerate(((100.0, "2002-07-01"), (50.0, "2010-01-01"), (300.0, "2016-01-01")))]
    truth = design_all(base, us) @ np.array([-20, 200 / (20 * 365.25), -5, 0, 0, 5]) + design_all(arc, us) @ np.array([40, -4, -20])
    rng = np.random.default_rng(0)
    x = truth + rng.normal(scale=2, size=len(t)) + noise.powerlaw(len(t), 1.5, np.random.default_rng(0)) * 2
    splines = ModelSpec("s", "SplineSet", {"degree": 2, "t_center_start": "2000-01-01", "t_center_end": "2020-01-01", "list_num_knots": [4, 8, 16, 32, 64, 128]}, regularize=True)
    specs = [*base, splines]
    g = design_all(specs, us)
    q, b = g.T @ g, g.T @ x
    reg = np.array([s.regularize for s in specs for _ in range(s.num_parameters)])
    inner = np.array([v for s in specs for v in s.internal_scales()])
    sd = lambda m: (x - g @ m).std(ddof=1)
    found = {}
    found["ridge"] = sd(dense.plain(q + np.diag(np.where(reg, 10.0, 0.0)), b))
    m1, _, _, kkt = dense.lasso(q, b, reg, 10.0)
    m0, _, _, _ = dense.lasso(q, b, reg, 10.0, iters=20, eps=1e-4, inner=inner)
    assert found["ridge"] == pytest.approx(2.088274, abs=1e-3)
    assert sd(m1) == pytest.approx(2.07782, abs=2e-3) and kkt < 1e-2
    assert sd(m0) == pytest.approx(2.071561, abs=2e-3)
    assert abs(int((np.abs(m1[reg]) > 1e-4).sum()) - 76) <= 3 and abs(int((np.abs(m0[reg]) > 1e-4).sum()) - 67) <= 3


# --- distributed fits ---


def network(spark, n=6, days=700, seed=0):
    rng = np.random.default_rng(seed)
    t = pd.date_range("2000-01-01", periods=days)
    us = t.to_numpy("datetime64[us]").astype(np.int64)
    specs = [ModelSpec("p", "Polynomial", {"order": 1}, "2000-01-01", "Y"), ModelSpec("a", "Sinusoid", {"period": 365.25})]
    g = design_all(specs, us)
    rows, par = [], {}
    for k in range(n):
        par[f"S{k}"] = rng.normal(size=(4, 2)) * 5
        y = g @ par[f"S{k}"] + rng.normal(size=(days, 2)) * 0.1
        y[rng.random((days, 2)) < 0.05] = np.nan
        rows.append(pd.DataFrame({"station": f"S{k}", "t": t, "e": y[:, 0], "n": y[:, 1], "e_var": rng.uniform(0.5, 2, days), "n_var": rng.uniform(0.5, 2, days), "c": rng.uniform(-0.3, 0.3, days)}))
    pdf = pd.concat(rows)
    return spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("timestamp_ntz")), pdf, specs, par


def test_fits_equal_direct_least_squares(spark):
    obs, pdf, specs, par = network(spark)
    obs = obs.repartition(7)
    cases = {"plain": api.fit(obs, specs, ["e", "n"]), "var": api.fit(obs, specs, ["e", "n"], var=["e_var", "n_var"]), "cov": api.fit(obs, specs, ["e", "n"], var=["e_var", "n_var"], cov=["c"])}
    for kind, df in cases.items():
        got = df.toPandas()
        for s, p in pdf.groupby("station"):
            g = design_all(specs, p.t.to_numpy("datetime64[us]").astype(np.int64))
            mine = got[got.station == s]
            value = np.array([[mine[(mine.comp == c) & (mine.model == m.name) & (mine.par_ix == k)].value.iloc[0] for c in "en"] for m in specs for k in range(m.num_parameters)])
            if kind == "cov":
                ok = p[["e", "n"]].notna().all(axis=1).to_numpy()
                q, b = np.zeros((8, 8)), np.zeros(8)
                for gi, r in zip(g[ok], p[ok].itertuples()):
                    w = np.linalg.inv([[r.e_var, r.c], [r.c, r.n_var]])
                    big = np.kron(gi[:, None], np.eye(2)).T
                    q += big.T @ w @ big
                    b += big.T @ w @ [r.e, r.n]
                want = np.linalg.solve(q, b).reshape(4, 2)
            else:
                want = np.zeros((4, 2))
                for j, c in enumerate("en"):
                    ok = p[c].notna().to_numpy()
                    w = 1 / p[f"{c}_var"].to_numpy()[ok] if kind == "var" else np.ones(ok.sum())
                    want[:, j] = np.linalg.solve((g[ok].T * w) @ g[ok], (g[ok].T * w) @ p[c].to_numpy()[ok])
            assert np.allclose(value, want, atol=1e-7)
    assert np.allclose(value, par["S5"], atol=0.2)


def test_covariances_of_parameters_and_fits(spark):
    obs, pdf, specs, _ = network(spark, 3, 300)
    var, cov = ["e_var", "n_var"], ["c"]
    one = api.normal_sums(obs, specs, ["e", "n"], var)
    both = api.normal_sums(obs, specs, ["e", "n"], var, cov)
    each, joint = api.solve(one, specs, ["e", "n"], covariance=True), api.solve(both, specs, ["e", "n"], joint=True, covariance=True)
    v1 = api.evaluate_variance(obs, each, specs, ["e", "n"]).toPandas().set_index(["station", "t"]).sort_index()
    v2 = api.evaluate_variance(obs, joint, specs, ["e", "n"], rows_at_once=70).toPandas().set_index(["station", "t"]).sort_index()
    block = api.covariance_block(joint, specs, ["e", "n"], "p", 1)
    params = api.solve(both, specs, ["e", "n"], joint=True)
    two = api.two_components(params, block, "p", 1, "e", "n").toPandas().set_index("station")
    for s, p in pdf.groupby("station"):
        g = design_all(specs, p.t.to_numpy("datetime64[us]").astype(np.int64))
        ok = p.e.notna().to_numpy()
        want = np.linalg.inv((g[ok].T / p.e_var.to_numpy()[ok]) @ g[ok])
        assert np.allclose(v1.loc[s].var_e, ((g @ want) * g).sum(axis=1)) and v1.loc[s].cov_e_n.isna().all()
        q, ok = np.zeros((8, 8)), p[["e", "n"]].notna().all(axis=1).to_numpy()
        for gi, r in zip(g[ok], p[ok].itertuples()):
            big = np.kron(gi[:, None], np.eye(2)).T
            q += big.T @ np.linalg.inv([[r.e_var, r.c], [r.c, r.n_var]]) @ big
        full = np.linalg.inv(q)
        at = np.array([np.kron(gi[:, None], np.eye(2)).T @ full @ np.kron(gi[:, None], np.eye(2)) for gi in g])
        for name, i, j in (("var_e", 0, 0), ("var_n", 1, 1), ("cov_e_n", 0, 1)):
            assert np.allclose(v2.loc[s][name], at[:, i, j])
        assert two.ve_vn_cov[s] == pytest.approx(full[2, 3]) and two.vn_var[s] == pytest.approx(full[3, 3])
    parts = api.evaluate(obs, params, specs, ["e", "n"], by_model=True)
    assert np.allclose(api.sum_fits(parts).toPandas().sort_values(["station", "t"]).fit_e, api.evaluate(obs, params, specs, ["e", "n"]).toPandas().sort_values(["station", "t"]).fit_e)
    assert api.stacked(params, "p").filter("stackable and size(values) = 2").count() == 6


def test_frozen_parameters_stay_out_of_the_fit(spark):
    obs, pdf, specs, par = network(spark, 2, 300)
    sums = api.normal_sums(obs, specs, ["e", "n"])
    params = api.solve(sums, specs, ["e", "n"])
    keep = api.frozen(params, 1e6).filter("model = 'a'").unionByName(api.frozen(params).filter("model = 'p'"))
    again = api.solve(sums, specs, ["e", "n"], active=keep).toPandas()
    assert (again[again.model == "a"][["value", "var"]] == 0).all(axis=None)
    alone = api.fit(obs, specs[:1], ["e", "n"]).toPandas()
    key = ["station", "comp", "par_ix"]
    assert np.allclose(again[again.model == "p"].sort_values(key).value, alone.sort_values(key).value)


def test_transient_periods_and_powers():
    spec = ModelSpec("s", "BSpline", {"degree": 2, "scale": 10.0, "num_splines": 2, "spacing": 5.0}, "2000-01-01")
    assert center_times(spec) == [DAY0, DAY0 + 5 * US] and transient_periods(spec)[1] == (DAY0 - 25 * US, DAY0 + 35 * US)
    assert exponent_index(ModelSpec("p", "Polynomial", {"order": 3, "min_exponent": 1}), 2) == 1
    with pytest.raises(ValueError):
        exponent_index(ModelSpec("p", "Polynomial", {"order": 1}), 2)


def test_unobservable_parameters(spark):
    obs, _, specs, _ = network(spark, 1, 50)
    late = ModelSpec("late", "Step", {"steptimes": ["2030-01-01"]})
    flat = ModelSpec("flat", "ISpline", {"degree": 2, "scale": 10.0}, "1990-01-01", regularize=True)
    p = api.fit(obs, [*specs, late, flat], ["e"], "ridge", penalty=1.0).toPandas()
    assert p[p.model.isin(["late", "flat"])][["value", "observable"]].to_numpy().tolist() == [[0.0, False], [0.0, False]]
    assert p[p.model == "late"]["var"].isna().all()


def test_evaluate_by_model_and_sign(spark):
    obs, _, specs, _ = network(spark, 2, 200)
    p = api.fit(obs, specs, ["e", "n"])
    whole = api.evaluate(obs, p, specs, ["e", "n"]).toPandas().sort_values(["station", "t"])
    parts = api.evaluate(obs, p, specs, ["e", "n"], by_model=True).groupBy("station", "t").agg(F.sum("fit_e").alias("e")).toPandas().sort_values(["station", "t"])
    assert np.allclose(whole.fit_e, parts.e)
    up = api.fit(obs, specs, ["e"], signs={"p": 1}).toPandas()
    assert (up[up.model == "p"].value >= 0).all()


def test_spatial_fit_couples(spark):
    rng = np.random.default_rng(3)
    days = 400
    t = pd.date_range("2000-01-01", periods=days)
    us = t.to_numpy("datetime64[us]").astype(np.int64)
    spline = ModelSpec("s", "SplineSet", {"degree": 2, "t_center_start": "2000-01-01", "t_center_end": "2001-02-04", "list_num_knots": [5, 9, 17]}, regularize=True)
    specs = [ModelSpec("p", "Polynomial", {"order": 1}), spline]
    m = np.zeros(spline.num_parameters)
    m[[4, 12]] = [20, -10]
    sig = design(spline, us) @ m
    obs = pd.concat([pd.DataFrame({"station": f"S{k}", "t": t, "x": sig * (1 + 0.1 * k) + rng.normal(size=days) * 2}) for k in range(6)])
    df = spark.createDataFrame(obs).withColumn("t", F.col("t").cast("timestamp_ntz"))
    sta = spark.createDataFrame([(f"S{k}", 0.01 * k, 0.0) for k in range(6)], "station string, lat double, lon double")
    local = api.fit(df, specs, ["x"], "lasso", penalty=10.0).toPandas()
    p, stats = spatial.spatial_fit(df, sta, specs, ["x"], 10.0, ["s"], 4)
    p = p.toPandas()
    on = lambda d: int((d[d.model == "s"].value.abs() > 1e-4).sum())
    assert on(p) <= on(local) and stats[-1]["nonzeros"] == int((p[p.model == "s"].value.abs() > 1e-6).sum())
    act = products.active_parameters(spark.createDataFrame(p), 1e-4)
    assert act.filter("active").count() > 0


@pytest.mark.parametrize("use, amplitude, angle, within", [("nothing", 1.3253632716, 9.4934302719, 0.05), ("variance", 0.94992227405, 4.0764805213, 1e-6), ("covariance", 1.0202124819, 5.8098923752, 0.01)])
def test_published_circle(spark, use, amplitude, angle, within):
    """Errors of the velocities of eight stations around a source, fitted together without and with uncertainties."""
    rng = np.random.default_rng(0)
    t = pd.date_range("2000-01-01", "2001-01-01")
    us, half = t.to_numpy("datetime64[us]").astype(np.int64), len(t) // 2
    line = ModelSpec("line", "Polynomial", {"order": 1}, "2000-01-01", "Y")
    source = ModelSpec("source", "Arctangent", {"tau": 20.0}, "2000-03-01")
    rows, places = [], []
    for k, a in enumerate(np.linspace(0, 2 * np.pi, 8, endpoint=False)):
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        early, late = turn @ np.diag([10, 3]) @ turn.T, np.diag([3, 3])
        noise_ = np.concatenate([rng.multivariate_normal((0, 0), early, half), rng.multivariate_normal((0, 0), late, len(t) - half)])
        y = design(line, us) @ [[0, 0], [6, 0]] + design(source, us) @ ([[8, 0]] @ turn.T) + noise_
        first = np.arange(len(t)) < half
        rows.append(pd.DataFrame({"station": f"S{k}", "t": t, "e": y[:, 0], "n": y[:, 1], "ev": np.where(first, early[0, 0], 3.0), "nv": np.where(first, early[1, 1], 3.0), "c": np.where(first, early[0, 1], 0.0)}))
        places.append((f"S{k}", float(np.sin(a) / 10), float(np.cos(a) / 10)))
    obs = spark.createDataFrame(pd.concat(rows)).withColumn("t", F.col("t").cast("timestamp_ntz"))
    splines = ModelSpec("splines", "SplineSet", {"degree": 2, "t_center_start": "2000-01-01", "t_center_end": "2001-01-01", "list_num_knots": [7, 13]}, "2000-01-01", "D", True)
    kw = {"nothing": {}, "variance": {"var": ["ev", "nv"]}, "covariance": {"var": ["ev", "nv"], "cov": ["c"]}}[use]
    p, _ = spatial.spatial_fit(obs, spark.createDataFrame(places, "station string, lat double, lon double"), [line, splines], ["e", "n"], 10.0, ["splines"], 20, kind="log", eps=1e-8, scale=10.0, **kw)
    v = p.filter("model = 'line' and par_ix = 1").toPandas().pivot(index="station", columns="comp", values=["value", "var"])
    size = np.hypot(v["value"].e, v["value"].n)
    assert np.sqrt(((size - 6) ** 2).mean()) == pytest.approx(amplitude, rel=within)
    assert np.sqrt((np.degrees(np.arccos(v["value"].e / size)) ** 2).mean()) == pytest.approx(angle, rel=within)
    if use == "covariance":
        assert np.allclose(v["var"].loc["S1"], [0.312009, 0.312009], atol=2e-6)
    if use == "variance":
        assert np.allclose(v["var"].loc["S0", ["e", "n"]], [0.397303, 0.226716], atol=2e-6)


# --- trends, modes, fields ---


def test_midas(spark):
    rng = np.random.default_rng(2)
    t = pd.date_range("2000-01-01", "2005-12-31")
    yr = np.arange(len(t)) / 365.25
    x = 3.0 * yr + np.sin(2 * np.pi * yr) + rng.normal(size=len(t)) * 0.5
    x[1000:] += 50
    x[500] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"station": "A", "t": t, "x": x})).withColumn("t", F.col("t").cast("timestamp_ntz"))
    step = spark.createDataFrame([("A", t[1000].to_pydatetime()), ("B", t[0].to_pydatetime())], "station string, time timestamp_ntz")
    for s in (None, step):
        r = midas.midas(df, ["x"], s).toPandas().iloc[0]
        assert r.velocity == pytest.approx(3.0, abs=0.1) and r.n_steps == (s is not None)
    pairs = midas.year_pairs(np.arange(0, 3, 0.25), np.array([1.6]))
    assert all(abs((j - i) * 0.25 - 1) < 1e-9 and not (0.25 * i < 1.6 <= 0.25 * j) for i, j in pairs) and pairs


def test_common_modes(spark):
    rng = np.random.default_rng(1)
    t = pd.date_range("2000-01-01", periods=300)
    src = np.stack([np.sign(np.sin(np.arange(300) / 7)), rng.uniform(-1, 1, 300)])
    mix = rng.normal(size=(8, 2))
    x = mix @ src + rng.normal(size=(8, 300)) * 0.01
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"station": f"S{k}", "t": t, "x": x[k]}) for k in range(8)])).withColumn("t", F.col("t").cast("timestamp_ntz"))
    for method in ("pca", "ica"):
        model, spatial_, temporal = decompose.common_modes(df, "x", 2, method)
        m = model.toPandas().pivot(index="station", columns="t", values="value").sort_index().to_numpy()
        assert np.allclose(m, x - x.mean(axis=1, keepdims=True), atol=0.1)
        s = temporal.toPandas().pivot(index="comp", columns="t", values="value").to_numpy()
        if method == "ica":
            c = np.abs(np.corrcoef(np.vstack([s, src]))[:2, 2:])
            assert (c.max(axis=1) > 0.97).all()
        else:
            assert abs(s[0] @ s[1]) < 1e-6 * np.abs(s[0] @ s[0])
        assert spatial_.count() == 16


@pytest.mark.parametrize("method", ["pca", "ica"])
def test_many_stations_give_the_same_modes(spark, method, monkeypatch):
    rng = np.random.default_rng(4)
    t = pd.date_range("2000-01-01", periods=60)
    x = rng.normal(size=(20, 2)) @ np.stack([np.sign(np.sin(np.arange(60) / 3)), rng.uniform(-2, 2, 60)]) + rng.normal(size=(20, 60)) * 0.05
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"station": f"S{k:02}", "t": t, "x": x[k]}) for k in range(20)])).withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = []
    for limit in (512, 0):
        monkeypatch.setattr(decompose, "GRAM_STATIONS", limit)
        model, loading, temporal = decompose.common_modes(df, "x", 2, method)
        got.append([model.toPandas().sort_values(["station", "t"]).value.to_numpy(), loading.toPandas().sort_values(["station", "comp"]).loading.to_numpy(), temporal.toPandas().sort_values(["t", "comp"]).value.to_numpy()])
    for a, b in zip(*got):
        assert np.allclose(a, b, atol=1e-5)
    z = np.where(np.isnan(x), 0, x - np.nanmean(x, axis=1, keepdims=True))
    u, sv, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(got[0][0], ((u[:, :2] * sv[:2]) @ vt[:2])[~np.isnan(x)], atol=1e-8)


def test_modes_with_lines_and_missing_readings(spark):
    t = pd.date_range("2000-01-01", periods=120)
    k = np.arange(120)
    x = np.array([a * k + b * np.sin(k / 5) for a, b in ((0.1, 1), (-0.2, 2), (0.3, -1), (0, 0.5))])
    x[1, 40:50] = np.nan
    x[2, :5] = np.nan
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"station": f"S{i}", "t": t, "x": x[i]}) for i in range(4)])).withColumn("t", F.col("t").cast("timestamp_ntz"))
    fit = decompose.common_modes(df, "x", 1, detrend=True)[0].toPandas().pivot(index="station", columns="t", values="value").to_numpy()
    assert np.nanmax(np.abs(fit - x)) < 0.6 and np.isnan(fit[1, 40:50]).all()
    full = decompose.common_modes(df, "x", 1, detrend=True, impute=True)[0].toPandas().pivot(index="station", columns="t", values="value").to_numpy()
    seen = ~np.isnan(x)
    assert np.allclose(full[seen], x[seen]) and np.isnan(full[2, :5]).all()
    assert np.abs(full[1, 40:50] - (-0.2 * k + 2 * np.sin(k / 5))[40:50]).max() < 1.5
    assert decompose.common_modes(df.limit(0), "x", 2)[0].count() == 0


def plates(spark):
    """100 stations, the west one turning: the published recipe."""
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(-121, -116, 100), rng.uniform(33, 37, 100)
    return lon, lat


def test_euler_pole_and_field(spark):
    lon, lat = plates(spark)
    rot = geodesy.rotation_vector(np.array([math.radians(-100), math.radians(40), math.radians(0.6) / 1e6]))
    v = []
    for a, b in zip(lon, lat):
        r = geodesy.enu_rotation(b, a)
        v.append((r @ np.cross(rot, geodesy.A * r[2]))[:2])
    v = np.array(v)
    df = spark.createDataFrame(pd.DataFrame({"station": range(100), "lon": lon, "lat": lat, "ve": v[:, 0], "vn": v[:, 1]}))
    got, cov = fields.estimate_euler_pole(df)
    pole, pc = geodesy.euler_pole(got, cov)
    assert np.allclose(got, rot, rtol=1e-8) and math.degrees(pole[0]) == pytest.approx(-100) and (np.diag(pc) > 0).all()
    f = fields.homogeneous_field(df)
    assert f["rotation"] == pytest.approx(rot @ geodesy.enu_rotation(lat.mean(), lon.mean())[2], rel=0.1)  # east and north turn with the longitude
    assert np.abs(f["strain"]).max() < 0.2 * abs(f["rotation"])
    pts = spark.createDataFrame([(1, -118.5, 35.0), (2, 0.0, 0.0)], "point_id bigint, lon double, lat double")
    got = {r["point_id"]: r for r in fields.strain_field(df, pts).collect()}
    assert got[1]["rotation"] == pytest.approx(abs(f["rotation"]), rel=0.05) and got[2]["ve"] is None


def test_published_plates(spark):
    """Mean motion, rotation, pole and the strain at one field point of the published two-plate example."""
    rng = np.random.default_rng(0)
    at = rng.uniform(low=[-121, 33], high=[-116, 37], size=(100, 2))
    west = at[:, 0] < -119
    v = rng.normal(scale=1e-3, size=(100, 2))
    v[west] += [-0.055, 0.045]
    off = at - [-117.1, 35.4]
    d = np.hypot(*off.T)[:, None]
    v += off / d / d**2 / 70
    var = rng.uniform(low=9e-3, high=11e-3, size=(100, 2)) ** 2
    cov = rng.normal(scale=1e-6, size=100)
    df = spark.createDataFrame(pd.DataFrame({"station": [f"S{k}" for k in range(100)], "lon": at[:, 0], "lat": at[:, 1], "ve": v[:, 0], "vn": v[:, 1], "ve_var": var[:, 0], "vn_var": var[:, 1], "ve_vn_cov": cov, "west": west}))
    f = fields.homogeneous_field(df, origin=(-120.5, 35.0))
    assert np.allclose(f["velocity"] * 1e3, [-58.92, 41.94], atol=0.005) and abs(f["rotation"]) * 1e6 == pytest.approx(0.0851, abs=5e-5)
    pole, _ = geodesy.euler_pole(*fields.estimate_euler_pole(df.filter("west")), principal=True)
    assert np.allclose(np.degrees(pole) * [1, 1, 1e6], [6.7, -39.3, 0.6], atol=0.05)
    x, y = np.meshgrid(np.linspace(-121, -116, 50), np.linspace(33, 37, 50)[::-1])
    pts = spark.createDataFrame([(k, float(x.ravel()[k]), float(y.ravel()[k])) for k in range(1200, 1300)], "point_id bigint, lon double, lat double")
    got = fields.strain_field(df, pts, 2.0, "quadratic", "voronoi", 1e6).filter("point_id = 1275").first()
    for name, want in (("ve", -1.6802e-02), ("dilatation", 2.3860e-07), ("strain", 2.4474e-07), ("shear", 1.4304e-07), ("rotation", 7.8567e-08)):
        assert got[name] == pytest.approx(want, rel=1e-4), name
    near = fields.predict_homogeneous(df, f).toPandas().set_index("station")
    assert abs(near.ve.mean() - v[:, 0].mean()) < 0.01
    turn, _ = fields.estimate_euler_pole(df.filter("west"))
    fit = fields.predict_rotation(df.filter("west"), turn).toPandas().set_index("station")
    assert np.abs(fit.ve - pd.Series(v[:, 0], [f"S{k}" for k in range(100)])[fit.index]).median() < 0.01
    for coverage, decay in (("azimuth", "gaussian"), ("none", "quadratic")):
        assert fields.strain_field(df, pts, 2.0, decay, coverage, 1e6).filter("ve is not null").count() == 100


def test_voronoi_areas():
    x, y = np.meshgrid(np.arange(6.0), np.arange(6.0))
    w = fields.voronoi_weights(np.column_stack([x.ravel(), y.ravel()]))
    inner = w.reshape(6, 6)[1:-1, 1:-1]
    assert np.allclose(inner, inner[0, 0]) and w.mean() == pytest.approx(1)
    assert fields._cell_area(np.zeros(2), np.array([[2.0, 0], [0, 2], [-2, 0], [0, -4], [9, 9]]), 100.0) == (pytest.approx(6.0), True)
    assert fields._cell_area(np.zeros(2), np.array([[2.0, 0]]), 100.0)[1] is False


def test_utm():
    """On the central meridian northing is the meridian arc; elsewhere the projection is conformal."""
    lat = np.linspace(0, np.radians(48.858222), 200_001)
    arc = geodesy.A * (1 - geodesy.E2) / (1 - geodesy.E2 * np.sin(lat) ** 2) ** 1.5
    want = geodesy.K0 * np.trapezoid(arc, lat)
    e, n = geodesy.utm(np.array([48.858222]), np.array([3.0]), 31)
    assert e[0] == pytest.approx(500000) and n[0] == pytest.approx(want, abs=1e-3)
    d = 1e-6
    p, q = 48.858222, 2.2945
    e, n = geodesy.utm(np.array([p, p + d, p]), np.array([q, q, q + d]), 31)
    w = 1 - geodesy.E2 * math.sin(math.radians(p)) ** 2
    north = math.radians(d) * geodesy.A * (1 - geodesy.E2) / w**1.5
    east = math.radians(d) * geodesy.A / w**0.5 * math.cos(math.radians(p))
    jac = np.array([[e[1] - e[0], n[1] - n[0]], [e[2] - e[0], n[2] - n[0]]]) / np.array([[north], [east]])
    assert jac[0] @ jac[1] == pytest.approx(0, abs=1e-4) and np.linalg.norm(jac[0]) == pytest.approx(np.linalg.norm(jac[1]), abs=1e-4)


def test_noise(spark):
    x = noise.powerlaw(4096, 1.5, np.random.default_rng(0))
    assert 0.2 < x.std() < 3
    sta = spark.createDataFrame([("A",), ("B",), (None,)], "station string")
    a, b = (noise.noise(sta.repartition(k), 100, 1.0).toPandas().sort_values(["station", "k"]).value.to_numpy() for k in (1, 3))
    assert np.array_equal(a, b) and len(a) == 200


def test_products(spark):
    obs, *_ = network(spark, 2, 30)
    d = products.displacement_paths(obs, "e", "n").toPandas()
    assert d.groupby("station").distance.first().eq(0).all() and d.azimuth.between(0, 360).all()
    spec = SPECS[4]
    sc = products.scalogram(spec, pd.DataFrame({"value": np.ones(spec.num_parameters)}), DAY0 + np.arange(0, 700, 10, dtype=np.int64) * US)
    assert sc.groupby("t").value.sum().round(9).isin([0, 1]).all()
    assert np.isnan(products.parameter_correlation(np.diag([1.0, 0.0]))[0, 1])
