"""Queries of models, fits and fields."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geodesy
from tidemark.operators import cleaning, custom, trends
from tidemark.operators.series import laid
from tidemark.plans import views as V
from tidemark.plans.views import NUDGE, q6, r6, with_views
from tidemark.solve import api, decompose, fields, midas as midas_mod, noise as noise_mod, spatial
from tidemark.session import materialize
from tidemark.solve.models import ModelSpec, columns, register, transient_mask
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPECS = [ModelSpec("Linear", "Polynomial", {"order": 1}, "1998-01-01", "Y"), ModelSpec("Annual", "Sinusoid", {"period": 365.25}, "1998-01-01", "D")]
SPLINES = [*SPECS, ModelSpec("Transient", "SplineSet", {"degree": 2, "t_center_start": "1995-01-01", "t_center_end": "2001-12-31", "list_num_knots": [5, 9, 17]}, "1995-01-01", "D", regularize=True)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_TAU = "(date_diff('second', timestamp '1998-01-01', t) / 86400.0)"
_BSPLINE = " + ".join(f"({c}) * pow(greatest(u + {1.5 - k}, 0), {{e}})" for k, c in enumerate([0.5, -1.5, 1.5, -0.5]))
#: name: (model, SQL of its columns over tau in days and, for splines, u)
_BASIS = {
    "step": (ModelSpec("m", "Step", {"steptimes": ["1997-05-01", "1999-02-03"]}), ["case when t >= timestamp '1997-05-01' then 1.0 else 0 end", "case when t >= timestamp '1999-02-03' then 1.0 else 0 end"]),
    "polynomial": (ModelSpec("m", "Polynomial", {"order": 3, "min_exponent": 1}, "1998-01-01", "Y"), [f"pow({_TAU} / 365.25, {k})" for k in (1, 2, 3)]),
    "sinusoid": (ModelSpec("m", "Sinusoid", {"period": 365.25}, "1998-01-01"), [f"cos({_TAU} * 2 * pi() / 365.25)", f"sin({_TAU} * 2 * pi() / 365.25)"]),
    "bspline": (ModelSpec("m", "BSpline", {"degree": 2, "scale": 200.0, "num_splines": 3}, "1998-01-01"), [f"(with x as (select {_TAU} / 200.0 - {j} as u) select case when abs(u) > 1.5 then 0 else {_BSPLINE.format(e=2)} end from x)" for j in range(3)]),
    "ispline": (ModelSpec("m", "ISpline", {"degree": 2, "scale": 200.0, "num_splines": 3}, "1998-01-01"), [f"(with x as (select {_TAU} / 200.0 - {j} as u) select case when u < -1.5 then 0 when u > 1.5 then 1 else ({_BSPLINE.format(e=3)}) / 3 end from x)" for j in range(3)]),
    "logarithmic": (ModelSpec("m", "Logarithmic", {"tau": [20.0, 300.0]}, "1998-01-01"), [f"case when {_TAU} < 0 then 0 else ln(1 + greatest({_TAU}, 0) / {x}) end" for x in (20.0, 300.0)]),
    "exponential": (ModelSpec("m", "Exponential", {"tau": 100.0}, "1998-01-01"), [f"case when {_TAU} < 0 then 0 else 1 - exp(-greatest({_TAU}, 0) / 100.0) end"]),
    "arctangent": (ModelSpec("m", "Arctangent", {"tau": 100.0}, "1998-01-01"), [f"atan({_TAU} / 100.0) / pi() + 0.5"]),
    "hyperbolic_tangent": (ModelSpec("m", "HyperbolicTangent", {"tau": 100.0}, "1998-01-01"), [f"tanh({_TAU} / 100.0) / 2 + 0.5"]),
    "bounded_sinusoid": (ModelSpec("m", "Sinusoid", {"period": 365.25}, "1998-01-01", t_start="1996-01-01", t_end="2000-01-01"), [f"case when t < timestamp '1996-01-01' or t > timestamp '2000-01-01' then 0 else {f}({_TAU} * 2 * pi() / 365.25) end" for f in ("cos", "sin")]),
}


def _basis(spec: ModelSpec):
    def run(spark, d):
        t = laid(V.ship(spark, d).select("t").distinct())
        g = columns(spec)
        return t.select("t", *[(F.round(c + NUDGE, 6) + 0.0).alias(f"g{i}") for i, c in enumerate(g)])

    return run


for _name, (_spec, _sql) in _BASIS.items():
    QUERIES[f"basis_{_name}"] = _basis(_spec)
    SQL[f"basis_{_name}"] = with_views("ship", "|, d as (select distinct t from ship) select t, " + ", ".join(q6(s, f"g{i}") for i, s in enumerate(_sql)) + " from d")


_G = ["1.0", "(date_diff('second', timestamp '1998-01-01', t) / 31557600.0)", f"cos({_TAU} * 2 * pi() / 365.25)", f"sin({_TAU} * 2 * pi() / 365.25)"]


@query(with_views("ship", "|, g as (select station, north as x, " + ", ".join(f"{s} as g{i}" for i, s in enumerate(_G)) + " from ship where north is not null) select station, " + ", ".join(q6(f"sum(g{i} * g{j})", f"q{i}{j}", 4) for i in range(4) for j in range(i, 4)) + ", " + ", ".join(q6(f"sum(g{i} * x)", f"b{i}", 4) for i in range(4)) + " from g group by station"))
def normal_equations(spark, d):
    s = api.normal_sums(V.ship(spark, d), SPECS, ["north"]).filter("i <= 4")
    wide = s.groupBy("station").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"r{i}") for i in range(5)])
    at = lambda r, k: F.round(F.get(f"r{r}", F.lit(k)) + NUDGE, 4) + 0.0
    return wide.select("station", *[at(i, j).alias(f"q{i}{j}") for i in range(4) for j in range(i, 4)], *[at(4, i).alias(f"b{i}") for i in range(4)])


@query(with_views("ship", f"select station, {q6('regr_intercept(east, x)', 'intercept')}, {q6('regr_slope(east, x)', 'slope')}, count(*) as n from (select station, east, {_G[1]} as x from ship) group by station"))
def fit_linear(spark, d):
    p = api.fit(V.ship(spark, d), SPECS[:1], ["east"])
    return p.groupBy("station").agg(F.max(F.when(F.col("par_ix") == 0, F.col("value"))).alias("intercept"), F.max(F.when(F.col("par_ix") == 1, F.col("value"))).alias("slope"), F.max("n").alias("n")).select("station", r6("intercept"), r6("slope"), "n")


@query(with_views("ship", f"|, f as (select station, regr_intercept(east, {_G[1]}) as a, regr_slope(east, {_G[1]}) as b from ship group by station) select station, t, {q6(f'a + b * {_G[1]}', 'fit')}, {q6(f'east - a - b * {_G[1]}', 'residual')} from ship join f using (station)"))
def fit_predict_residual(spark, d):
    s = V.ship(spark, d)
    f = api.evaluate(s, api.fit(s, SPECS[:1], ["east"]), SPECS[:1], ["east"])
    return api.residuals(s, f, ["east"]).join(f, ["station", "t"]).select("station", "t", r6("fit_east", "fit"), r6("east", "residual"))


def _orthogonal(x: str, var: str) -> str:
    """Residuals of the weighted fit of _G to column x, by taking one regressor after the other out of the rest."""
    over = "over (partition by station)"
    w = f"case when {var} > 0 and {x} is not null then 1 / {var} end"
    return f"""(with a as (select station, t, {x} as x, {w} as w, {_G[1]} as g1, {_G[2]} as g2, {_G[3]} as g3 from ship),
b as (select station, t, w, x - sum(w * x) {over} / sum(w) {over} as x, g1 - sum(w * g1) {over} / sum(w) {over} as u1, g2 - sum(w * g2) {over} / sum(w) {over} as g2, g3 - sum(w * g3) {over} / sum(w) {over} as g3 from a),
c as (select station, t, w, x - u1 * sum(w * x * u1) {over} / sum(w * u1 * u1) {over} as x, g2 - u1 * sum(w * g2 * u1) {over} / sum(w * u1 * u1) {over} as u2, g3 - u1 * sum(w * g3 * u1) {over} / sum(w * u1 * u1) {over} as g3 from b),
e as (select station, t, w, u2, x - u2 * sum(w * x * u2) {over} / sum(w * u2 * u2) {over} as x, g3 - u2 * sum(w * g3 * u2) {over} / sum(w * u2 * u2) {over} as u3 from c)
select station, t, x - u3 * sum(w * x * u3) {over} / sum(w * u3 * u3) {over} as r from e)"""


def _residual_rows() -> str:
    return " union all ".join(f"select station, '{c}' as comp, t, r from {_orthogonal(c, c + '_var')}" for c in ("east", "north", "up"))


@query(with_views("ship", f"""|, r as (select * from ({_residual_rows()})), m as (select station, comp, avg(coalesce(r, 0)) as m, stddev_pop(coalesce(r, 0)) as s from r group by all)
select station, comp, {q6('avg(r)', 'mean')}, {q6('stddev_samp(r)', 'std')}, {q6('sqrt(avg(r * r))', 'rms')}, count(r) as observations, count(*) - count(r) as gaps, count(*) filter (where coalesce(r, 0) - m > 3 * s) as outliers from r join m using (station, comp) group by station, comp"""))
def fit_residual_stats(spark, d):
    """Weighted trend and annual cycle of every station and component, evaluated, and the residuals' statistics."""
    s, data = V.ship(spark, d), ["east", "north", "up"]
    f = api.evaluate(s, api.fit(s, SPECS, data, var=["east_var", "north_var", "up_var"]), SPECS, data)
    x = cleaning.component_stats(api.residuals(s, f, data), data)
    return x.select("station", "comp", r6("mean"), r6("std"), r6("rms"), "observations", "gaps", "outliers")


@query()
def fit_with_covariance(spark, d):
    """All components together, each epoch weighted by the pseudo-inverse of its covariance matrix."""
    return api.fit(V.ship(spark, d), SPECS, ["east", "north", "up"], var=["east_var", "north_var", "up_var"], cov=["east_north_cov", "east_up_cov", "north_up_cov"])


_JOINT = """|, g as (select *, east_var * north_var - east_north_cov * east_north_cov as det from ship where n >= 5),
q as (select station, sum(north_var / det) a, sum(-east_north_cov / det) b, sum(east_var / det) c, sum((north_var * east - east_north_cov * north) / det) p, sum((east_var * north - east_north_cov * east) / det) r from g group by station)"""


@query(with_views("ship", _JOINT + f" select station, {q6('(c * p - b * r) / (a * c - b * b)', 've')}, {q6('(a * r - b * p) / (a * c - b * b)', 'vn')}, {q6('c / (a * c - b * b)', 've_var', 9)}, {q6('a / (a * c - b * b)', 'vn_var', 9)}, {q6('-b / (a * c - b * b)', 've_vn_cov', 9)} from q"))
def joint_means(spark, d):
    """The covariance-weighted means of two components, their variances and covariance."""
    s, data, one = V.ship(spark, d).filter("n >= 5"), ["east", "north"], [ModelSpec("Offset", "Polynomial", {"order": 0})]
    sums = materialize(api.normal_sums(s, one, data, ["east_var", "north_var"], ["east_north_cov"]), "sums")
    params, cov = api.solve(sums, one, data, joint=True), api.solve(sums, one, data, joint=True, covariance=True)
    two = api.two_components(params, api.covariance_block(cov, one, data, "Offset", 0), "Offset", 0, "east", "north")
    return two.select("station", r6("ve"), r6("vn"), r6("ve_var", digits=9), r6("vn_var", digits=9), r6("ve_vn_cov", digits=9))


@query(with_views("ship", f"""|, g as (select station, {_G[1]} as x, 1 / east_var as w from ship where east_var > 0 and east is not null), s as (select station, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2 from g group by station)
select station, t, {q6(f'(s2 - 2 * {_G[1]} * s1 + {_G[1]} * {_G[1]} * s0) / (s0 * s2 - s1 * s1)', 'var_east', 9)} from ship join s using (station)"""))
def fit_variance(spark, d):
    """Formal variance of a weighted line at every epoch."""
    s = V.ship(spark, d)
    cov = api.solve(api.normal_sums(s, SPECS[:1], ["east"], ["east_var"]), SPECS[:1], ["east"], covariance=True)
    return api.evaluate_variance(s, cov, SPECS[:1], ["east"]).select("station", "t", r6("var_east", digits=9))


_LINE = [ModelSpec("Offset", "Polynomial", {"order": 0}), ModelSpec("Slope", "Polynomial", {"order": 1, "min_exponent": 1}, "1998-01-01", "Y", regularize=True)]
_LINE_SUMS = f"|, s as (select station, regr_sxx(total, {_G[1]}) as xx, regr_sxy(total, {_G[1]}) as xy, avg(total) as my, avg({_G[1]}) as mx from nat group by station)"


def _line_query(name: str, slope: str, extra: str = "", solver: str = "lasso", **kw) -> None:
    def run(spark, d):
        p = api.fit(V.nat(spark, d), _LINE, ["total"], solver, **kw)
        w = p.groupBy("station").agg(F.max(F.when(F.col("model") == "Offset", F.col("value"))).alias("intercept"), F.max(F.when(F.col("model") == "Slope", F.col("value"))).alias("slope"))
        return w.select("station", r6("intercept"), r6("slope"))

    QUERIES[name] = run
    SQL[name] = with_views("nat", f"{_LINE_SUMS}{extra}, m as (select *, {slope} as b from {'k' if extra else 's'}) select station, {q6('my - b * mx', 'intercept')}, {q6('b', 'slope')} from m")


_soft = lambda w: f"sign(xy) * greatest(abs(xy) - {w} / 2, 0) / xx"
_steps = "select *, 40.0 as w0 from s"
for _ in range(4):
    _steps = f"select * replace (1 / (abs({_soft('w0')}) + 0.05) as w0) from ({_steps})"
_line_query("ridge_line", "xy / (xx + 40)", solver="ridge", penalty=40.0)
_line_query("lasso_line", _soft("40"), penalty=40.0)
_line_query("lasso_positive_line", f"greatest({_soft('40')}, 0)", penalty=40.0, signs={"Slope": 1})
_line_query("l0_line", _soft("w0"), f", k as ({_steps})", penalty=40.0, iters=5, kind="inv", eps=0.05)


@query(with_views("ship", f"select station, {q6('-sum(x) / sqrt(count(*) * sum(x * x))', 'corr')} from (select station, {_G[1]} as x from ship where east is not null) group by station"))
def parameter_correlation(spark, d):
    """Of the offset and the slope of a line."""
    s = V.ship(spark, d)
    cov = api.solve(api.normal_sums(s, SPECS[:1], ["east"]), SPECS[:1], ["east"], covariance=True)
    return api.parameter_correlation(cov).filter("i = 0 and j = 1").select("station", r6("corr"))


@query(with_views("ship", "select distinct station, m.model, m.ok as observable from ship, (values ('Linear', true), ('Late', false)) as m(model, ok)"))
def observability(spark, d):
    """A step after the last epoch cannot be estimated."""
    late = ModelSpec("Late", "Step", {"steptimes": ["2030-01-01"]})
    return api.fit(V.ship(spark, d), [SPECS[0], late], ["east"]).select("station", "model", "observable").distinct()


def _set_sql(sets: list[tuple[float, int, float]], least: float) -> list[str]:
    """Quadratic integrated splines: scale, how many, centre of the first, in days since 1998-01-01."""
    out = []
    for scale, n, first in sets:
        for j in range(n):
            u = f"(with x as (select ({_TAU} - {first + j * scale}) / {scale} as u) select case when u < -1.5 then 0 when u > 1.5 then 1 else ({_BSPLINE.format(e=3)}) / 3 end from x)"
            out.append(f"{u} * {(scale / least) ** 0.5}")
    return out


_SETS = {
    "spline_set": (ModelSpec("m", "SplineSet", {"degree": 2, "t_center_start": "1996-01-02", "t_center_end": "2000-01-01", "list_num_knots": [3, 5]}, "1998-01-01"), [(730.0, 5, -730.0 - 730.0), (365.0, 7, -365.0 - 730.0)], 365.0),
    "decaying_spline_set": (ModelSpec("m", "DecayingSplineSet", {"degree": 2, "t_center_start": "1998-01-01", "list_scales": [50.0, 200.0], "list_num_splines": [3, 2]}, "1998-01-01"), [(50.0, 3, 0.0), (200.0, 2, 0.0)], 50.0),
}
for _name, (_spec, _sets, _least) in _SETS.items():
    QUERIES[f"basis_{_name}"] = _basis(_spec)
    SQL[f"basis_{_name}"] = with_views("ship", "|, d as (select distinct t from ship) select t, " + ", ".join(q6(x, f"g{i}") for i, x in enumerate(_set_sql(_sets, _least))) + " from d")


@query()
def power_law_noise(spark, d):
    """Seeded noise of each station, alike wherever it runs."""
    return noise_mod.noise(V.sta(spark, d), 200, 1.5)


@query(with_views("ship", f"select station, {q6('regr_intercept(east, x)', 'intercept')}, {q6('regr_slope(east, x)', 'slope')} from (select station, east, {_G[1]} as x from ship) group by station"))
def frozen_fit(spark, d):
    """The annual cycle frozen: what is left is a line."""
    s = V.ship(spark, d)
    sums = materialize(api.normal_sums(s, SPECS, ["east"]), "sums")
    keep = api.frozen(api.solve(sums, SPECS, ["east"]), 0.0).withColumn("active", F.col("model") != "Annual")
    p = api.solve(sums, SPECS, ["east"], active=keep).filter("model = 'Linear'")
    return p.groupBy("station").agg(F.max(F.when(F.col("par_ix") == 0, F.col("value"))).alias("intercept"), F.max(F.when(F.col("par_ix") == 1, F.col("value"))).alias("slope")).select("station", r6("intercept"), r6("slope"))


@query(with_views("ship", f"select station, count(*) as n, {q6('regr_slope(east, x)', 'slope')} from (select station, t, east, {_G[1]} as x from ship) group by station"))
def trend_of_fits(spark, d):
    """The trend through the fitted line and step-like models added up is the line's own."""
    s = V.ship(spark, d)
    parts = api.evaluate(s, api.fit(s, SPECS[:1], ["east"]), SPECS[:1], ["east"], by_model=True)
    return trends.trend(api.sum_fits(parts, ["Linear"]), "fit_east", unit="Y").select("station", "n", r6("slope"))


@query(with_views("ship", f"select station, [regr_intercept(east, x), regr_slope(east, x)] as v, 1 as k from (select station, east, {_G[1]} as x from ship) group by station").replace("select station, [", "select station, round(v[1] + 1.37e-8, 6) + 0.0 as first, round(v[2] + 1.37e-8, 6) + 0.0 as second, true as stackable from (select station, [") + ")")
def stacked_parameters(spark, d):
    p = api.stacked(api.fit(V.ship(spark, d), SPECS[:1], ["east"]), "Linear")
    return p.select("station", F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(1)).alias("second"), "stackable").select("station", r6("first"), r6("second"), "stackable")


_RAMP = "least(greatest(date_diff('second', timestamp '1996-06-01', t) / 86400.0 / 500.0, 0.0), 1.0)"


@query(with_views("ship", f"select station, {q6('regr_intercept(north, x)', 'offset')}, {q6('regr_slope(north, x)', 'ramp')} from (select station, north, {_RAMP} as x from ship) group by station").replace(" as offset", ' as "offset"'))
def custom_model(spark, d):
    """A model of the user's own: a ramp over 500 days."""
    register("Ramp", lambda kw: 1, lambda tau, kw: np.clip(tau / kw["length"], 0, 1)[:, None])
    p = api.fit(V.ship(spark, d), [ModelSpec("o", "Polynomial", {"order": 0}), ModelSpec("r", "Ramp", {"length": 500.0}, "1996-06-01")], ["north"])
    w = p.groupBy("station").agg(F.max(F.when(F.col("model") == "o", F.col("value"))).alias("offset"), F.max(F.when(F.col("model") == "r", F.col("value"))).alias("ramp"))
    return w.select("station", r6("offset"), r6("ramp"))


_SPLINE = ModelSpec("b", "BSpline", {"degree": 2, "scale": 100.0, "num_splines": 3, "spacing": 150.0}, "1998-01-01")


@query(with_views("ship", "select distinct t, " + ", ".join(f"abs({_TAU} - {150 * j}) <= 300 as s{j}" for j in range(3)) + " from ship"))
def transient_periods(spark, d):
    t = laid(V.ship(spark, d).select("t").distinct())
    return t.select("t", *[c.alias(f"s{j}") for j, c in enumerate(transient_mask(_SPLINE))])


_X = "(date_diff('second', timestamp '1996-01-01', t) / 126230400.0)"
_HUMPS = ["case when x < 0.5 then pow(1 - 2 * x, 2) else 0 end", "case when x < 0.5 then 4 * x - 6 * x * x else 2 * pow(1 - x, 2) end", "case when x < 0.5 then 2 * x * x else 4 * (1 - x) - 6 * pow(1 - x, 2) end", "case when x < 0.5 then 0 else pow(2 * x - 1, 2) end"]


@query(with_views("ship", f"|, d as (select distinct t, {_X} as x, {_TAU} * 2 * pi() / 365.25 as w from ship) select t, " + ", ".join(q6(f"case when x < 0 or x > 1 then 0 else ({h}) * {f}(w) end", f"g{4 * i + j}") for i, f in enumerate(("cos", "sin")) for j, h in enumerate(_HUMPS)) + " from d"))
def basis_modulated_sinusoid(spark, d):
    spec = ModelSpec("m", "AmpPhModulatedSinusoid", {"period": 365.25, "degree": 2, "num_bases": 4}, "1998-01-01", t_start="1996-01-01", t_end="2000-01-01")
    t = laid(V.ship(spark, d).select("t").distinct())
    return t.select("t", *[(F.round(c + NUDGE, 6) + 0.0).alias(f"g{i}") for i, c in enumerate(columns(spec))])


@query(with_views("ship", f"select station, t, {q6('east - avg(east) over (partition by station)', 'east')} from ship"))
def user_function_by_series(spark, d):
    f = lambda pdf: pdf.assign(east=pdf["east"] - pdf["east"].mean())[["station", "t", "east"]]
    return custom.on_each_series(V.ship(spark, d).select("station", "t", "east"), f, "station string, t timestamp_ntz, east double").select("station", "t", r6("east"))


@query(with_views("nat", f"select station, t, {q6('total - m', 'off')} from (select station, t, total, median(total) over (partition by t) as m, count(*) over (partition by t) as n from nat) where n >= 3"))
def user_function_by_epoch(spark, d):
    return custom.on_epochs(V.nat(spark, d), "total", lambda x: x - x.median(), "station string, t timestamp_ntz, off double", 3).select("station", "t", r6("off"))


@query()
def ridge_fit(spark, d):
    return api.fit(V.ship(spark, d), SPLINES, ["east", "north"], "ridge", penalty=10.0)


@query()
def lasso_fit(spark, d):
    return api.fit(V.ship(spark, d), SPLINES, ["east", "north"], "lasso", penalty=10.0)


@query()
def irls_l0(spark, d):
    return api.fit(V.ship(spark, d), SPLINES, ["east", "north"], "lasso", penalty=10.0, iters=10, kind="inv", eps=1e-4)


@query()
def spatialfit(spark, d):
    return spatial.spatial_fit(V.nat(spark, d), V.sta(spark, d), SPLINES, ["total"], 10.0, ["Transient"], 3)[0]


@query()
def midas(spark, d):
    steps = table(spark, d, "catalog_maint").select("station", F.col("maint_time").alias("time"))
    return midas_mod.midas(V.nat(spark, d), ["total"], steps)


@query()
def pca_common_mode(spark, d):
    return decompose.common_modes(V.nat(spark, d), "total", 2)[0]


@query()
def ica(spark, d):
    return decompose.common_modes(V.nat(spark, d), "total", 2, "ica")[1]


def _velocities(spark, d):
    s = table(spark, d, "stations").dropna(subset=["lat", "lon"])
    return s.select("station", "lat", "lon", (0.01 * F.cos(F.radians("lon")) + 1e-4 * F.col("lat")).alias("ve"), (0.01 * F.sin(F.radians("lat")) - 1e-4 * F.col("lon")).alias("vn"))


_VEL = "v as (select station, lat, lon, 0.01 * cos(radians(lon)) + 1e-4 * lat as ve, 0.01 * sin(radians(lat)) - 1e-4 * lon as vn from stations where lat is not null and lon is not null)"
_TURN = f"""with {_VEL}, g as (select *, [-sin(radians(lat)) * cos(radians(lon)), -sin(radians(lat)) * sin(radians(lon)), cos(radians(lat))] as e, [sin(radians(lon)), -cos(radians(lon)), 0.0] as n from v),
q as (select {', '.join(f'sum(e[{i}] * e[{j}] + n[{i}] * n[{j}]) as q{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))}, {', '.join(f'sum(e[{i}] * ve + n[{i}] * vn) / {geodesy.A} as b{i}' for i in (1, 2, 3))} from g),
i as (select *, q11 * (q22 * q33 - q23 * q32) - q12 * (q21 * q33 - q23 * q31) + q13 * (q21 * q32 - q22 * q31) as det from q),
c as (select b1, b2, b3, (q22 * q33 - q23 * q32) / det as c11, (q13 * q32 - q12 * q33) / det as c12, (q12 * q23 - q13 * q22) / det as c13, (q11 * q33 - q13 * q31) / det as c22, (q13 * q21 - q11 * q23) / det as c23, (q11 * q22 - q12 * q21) / det as c33 from i),
w as (select c11 * b1 + c12 * b2 + c13 * b3 as x, c12 * b1 + c22 * b2 + c23 * b3 as y, c13 * b1 + c23 * b2 + c33 * b3 as z, * from c),
p as (select *, x * x + y * y as h2, x * x + y * y + z * z as r2 from w)"""


@query(_TURN + f"""select {q6('degrees(atan2(y, x))', 'lon')}, {q6('degrees(atan2(z, sqrt(h2)))', 'lat')}, {q6('sqrt(r2) * 1e9', 'rate')},
{q6(f'sqrt((y * y * c11 - 2 * x * y * c12 + x * x * c22) / (h2 * h2)) / {geodesy.A} * 1e-3', 'lon_sd')},
{q6(f'sqrt((x * x * z * z * c11 + y * y * z * z * c22 + h2 * h2 * c33 + 2 * (x * y * z * z * c12 - x * z * h2 * c13 - y * z * h2 * c23)) / h2) / r2 / {geodesy.A} * 1e-3', 'lat_sd')},
{q6(f'sqrt((x * x * c11 + y * y * c22 + z * z * c33 + 2 * (x * y * c12 + x * z * c13 + y * z * c23)) / r2) / {geodesy.A} * 1e9', 'rate_sd')} from p""")
def euler_pole(spark, d):
    rot, cov = fields.estimate_euler_pole(_velocities(spark, d))
    pole, pc = geodesy.euler_pole(rot, cov)
    lon, lat, rate, *sd = (*map(float, pole), *map(float, np.sqrt(pc.diagonal())))
    row = (float(np.degrees(lon)), float(np.degrees(lat)), rate * 1e9, sd[0] * 1e-3, sd[1] * 1e-3, sd[2] * 1e9)
    return spark.createDataFrame([row], "lon double, lat double, rate double, lon_sd double, lat_sd double, rate_sd double").select(*[r6(c) for c in ("lon", "lat", "rate", "lon_sd", "lat_sd", "rate_sd")])


@query(_TURN + f" select station, {q6(f'{geodesy.A} * (e[1] * x + e[2] * y + e[3] * z)', 've')}, {q6(f'{geodesy.A} * (n[1] * x + n[2] * y)', 'vn')} from g, p")
def euler_velocities(spark, d):
    """The velocities that the rotation gives at the stations; the pole goes through its angles and back."""
    v = _velocities(spark, d)
    pole, _ = geodesy.euler_pole(fields.estimate_euler_pole(v)[0])
    return fields.predict_rotation(v, geodesy.rotation_vector(pole)).select("station", r6("ve"), r6("vn"))


def _regional(spark, d):
    """The stations drawn together to a region some degrees wide, as a plane projection needs."""
    return _velocities(spark, d).withColumn("lon", 10 + F.col("lon") / 60).withColumn("lat", 40 + F.col("lat") / 30)


def _utm_sql(source: str) -> str:
    """east and north of lon and lat in the zone of the mean longitude, by the same series (see geodesy.utm)."""
    f = geodesy.FLAT / (2 - geodesy.FLAT)
    radius = geodesy.A / (1 + f) * (1 + f**2 / 4 + f**4 / 64)
    terms = [f / 2 - 2 * f**2 / 3 + 5 * f**3 / 16 + 41 * f**4 / 180, 13 * f**2 / 48 - 3 * f**3 / 5 + 557 * f**4 / 1440, 61 * f**3 / 240 - 103 * f**4 / 140, 49561 * f**4 / 161280]
    ecc = 2 * f**0.5 / (1 + f)
    east = " + ".join(["eta", *(f"{c} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(terms, 1))])
    north = " + ".join(["xi", *(f"{c} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(terms, 1))])
    return f"""(select * exclude (s, dl, xi, eta), {geodesy.FALSE_EAST} + {geodesy.K0 * radius} * ({east}) as x, {geodesy.K0 * radius} * ({north}) + case when lat < 0 then {geodesy.FALSE_NORTH} else 0 end as y
  from (select *, atan2(s, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + s * s)) as eta
    from (select *, sinh(atanh(sin(radians(lat))) - {ecc} * atanh({ecc} * sin(radians(lat)))) as s, radians(lon - (6 * (floor((mlon + 180) / 6) % 60 + 1) - 183)) as dl from {source})))"""


_HOMO = f"""with {_VEL}, w as (select station, 10 + lon / 60 as lon, 40 + lat / 30 as lat, ve, vn from v),
m as (select degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) as mlon, avg(lat) as mlat from w),
o as (select x as x0, y as y0 from {_utm_sql('(select mlat as lat, mlon as lon, mlon from m)')}),
u as (select station, ve, vn, (x - x0) / 1e6 as e, (y - y0) / 1e6 as n from {_utm_sql('(select w.*, mlon from w, m)')}, o),
s as (select count(*)::double as k, sum(e) as se, sum(n) as sn, sum(e * e) as see, sum(e * n) as sen, sum(n * n) as snn, {', '.join(f'sum({v}) as s{v}, sum({v} * e) as s{v}e, sum({v} * n) as s{v}n' for v in ('ve', 'vn'))} from u),
d as (select *, k * (see * snn - sen * sen) - se * (se * snn - sen * sn) + sn * (se * sen - see * sn) as det from s),
f as (select {', '.join(f'(s{v} * (see * snn - sen * sen) - s{v}e * (se * snn - sen * sn) + s{v}n * (se * sen - see * sn)) / det as {v}0, (-s{v} * (se * snn - sn * sen) + s{v}e * (k * snn - sn * sn) - s{v}n * (k * sen - se * sn)) / det as {v}e, (s{v} * (se * sen - sn * see) - s{v}e * (k * sen - sn * se) + s{v}n * (k * see - se * se)) / det as {v}n' for v in ('ve', 'vn'))} from d)"""


@query(_HOMO + f" select {q6('ve0', 've')}, {q6('vn0', 'vn')}, {q6('vee * 1e3', 'dede')}, {q6('ven * 1e3', 'dedn')}, {q6('vne * 1e3', 'dnde')}, {q6('vnn * 1e3', 'dndn')}, {q6('(vne - ven) / 2 * 1e3', 'rotation')} from f")
def homogeneous_field(spark, d):
    """Velocity, and gradient and rotation in units of 1e-9."""
    f = fields.homogeneous_field(_regional(spark, d))
    row = (*map(float, f["velocity"]), *map(float, f["gradient"].ravel() * 1e9), float(f["rotation"] * 1e9))
    names = ("ve", "vn", "dede", "dedn", "dnde", "dndn", "rotation")
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)).select(*[r6(n) for n in names])


@query(_HOMO + f" select station, {q6('ve0 + vee * e + ven * n', 've')}, {q6('vn0 + vne * e + vnn * n', 'vn')} from u, f")
def homogeneous_velocities(spark, d):
    v = _regional(spark, d)
    return fields.predict_homogeneous(v, fields.homogeneous_field(v)).select("station", r6("ve"), r6("vn"))


@query()
def strain_field(spark, d):
    points = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("point_id"), (8.0 + 0.16 * F.col("n_nationkey")).alias("lon"), (39.0 + 0.08 * F.col("n_nationkey")).alias("lat"))
    return fields.strain_field(_regional(spark, d), points)


_ECEF_N = f"({geodesy.A} / sqrt(1 - {geodesy.E2} * pow(sin(radians(lat)), 2)))"


@query(f"select station, round({_ECEF_N} * cos(radians(lat)) * cos(radians(lon)) + coalesce(alt, 0) * cos(radians(lat)) * cos(radians(lon)), 3) + 0.0 as x, round(({_ECEF_N} + coalesce(alt, 0)) * cos(radians(lat)) * sin(radians(lon)), 3) + 0.0 as y, round(({_ECEF_N} * (1 - {geodesy.E2}) + coalesce(alt, 0)) * sin(radians(lat)), 3) + 0.0 as z, round(lat, 6) + 0.0 as lat_back, round(lon, 6) + 0.0 as lon_back from stations where lat is not null and lon is not null")
def ecef_round_trip(spark, d):
    s = table(spark, d, "stations").dropna(subset=["lat", "lon"])
    x, y, z = geodesy.ecef(F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0)))
    s = s.withColumns({"x": x, "y": y, "z": z})
    lat, lon, _ = geodesy.lla(F.col("x"), F.col("y"), F.col("z"))
    return s.select("station", *[(F.round(c, 3) + 0.0).alias(c) for c in ("x", "y", "z")], (F.round(lat, 6) + 0.0).alias("lat_back"), (F.round(lon, 6) + 0.0).alias("lon_back"))


@query(with_views("ship", f"""|, e as (select station, t, east * 1e-3 as xx, (north - up) * 1e-3 as xy, up * 1e-3 as yy, north * 1e-3 as w from ship)
select station, t, {q6('xx + yy', 'dilatation')}, {q6('sqrt(xx * xx + 2 * xy * xy + yy * yy)', 'strain')}, {q6('sqrt(greatest((xx * xx + 2 * xy * xy + yy * yy) / 2 - pow(xx + yy, 2) / 6, 0))', 'shear')}, {q6('abs(w)', 'rotation')} from e"""))
def strain_invariants(spark, d):
    s = V.ship(spark, d)
    out = geodesy.strain_invariants(F.col("east") * 1e-3, (F.col("north") - F.col("up")) * 1e-3, F.col("up") * 1e-3, F.col("north") * 1e-3)
    return s.select("station", "t", *[(F.round(c + NUDGE, 6) + 0.0).alias(n) for c, n in zip(out, ("dilatation", "strain", "shear", "rotation"))])


@query(with_views("ship", f"""|, g as (select station, north as x, {', '.join(f'{s} as g{i}' for i, s in enumerate(_G[2:]))} from ship),
m as (select station, sum(g0 * g0) a, sum(g0 * g1) b, sum(g1 * g1) c, sum(g0 * x) p, sum(g1 * x) q from g group by station),
s as (select station, (c * p - b * q) / (a * c - b * b) as u, (a * q - b * p) / (a * c - b * b) as v from m)
select station, {q6('sqrt(u * u + v * v)', 'amplitude')}, {q6('atan2(v, u)', 'phase')} from s"""))
def amplitude_phase(spark, d):
    p = api.fit(V.ship(spark, d), SPECS[1:], ["north"])
    w = p.groupBy("station").agg(F.max(F.when(F.col("par_ix") == 0, F.col("value"))).alias("u"), F.max(F.when(F.col("par_ix") == 1, F.col("value"))).alias("v"))
    return w.select("station", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2).alias("amplitude"), F.atan2("v", "u").alias("phase")).select("station", r6("amplitude"), r6("phase"))
