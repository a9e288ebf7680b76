"""Queries of the relational series operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geodesy, timeunits, weights
from tidemark.operators import availability, cleaning, dislocation, events, network, products, quantiles, series, steps, trends
from tidemark.plans import views as V
from tidemark.plans.views import q6, r6, with_views
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHIP = series.SeriesSpec(("east", "north", "up"), "k", "lineitem", ("east_var", "north_var", "up_var"), ("east_north_cov", "east_up_cov", "north_up_cov"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- columns ---


@query(with_views("ship", f"select station, t, {', '.join(q6(c + ' * 10', c) for c in SHIP.data)}, {', '.join(q6(c + ' * 100', c) for c in SHIP.var + SHIP.cov)} from ship"))
def convert_units(spark, d):
    return series.convert_units(V.ship(spark, d), SHIP, 10.0).select("station", "t", *[r6(c) for c in (*SHIP.data, *SHIP.var, *SHIP.cov)])


@query(with_views("ship", f"select station, t, {q6('east', 'east')}, {q6('case when not (n < 3) then north end', 'north')}, {q6('case when not (n < 3) then north_var end', 'north_var')}, {q6('case when not (n < 3) then east_north_cov end', 'east_north_cov')}, {q6('east_up_cov', 'east_up_cov')}, {q6('case when not (n < 3) then north_up_cov end', 'north_up_cov')} from ship"))
def mask_component(spark, d):
    m = series.mask_out(V.ship(spark, d), SHIP, "north", F.col("n") < 3)
    return m.select("station", "t", *[r6(c) for c in ("east", "north", "north_var", "east_north_cov", "east_up_cov", "north_up_cov")])


@query(with_views("ship", f"select station, t, {q6('east', 'east')} from ship where t >= timestamp '1996-03-01' and t <= timestamp '1998-06-30'"))
def cut_inside(spark, d):
    return series.cut(V.ship(spark, d), "1996-03-01", "1998-06-30").select("station", "t", r6("east"))


@query(with_views("ship", f"""|, c as (select *, row_number() over (partition by station order by t) - 1 as i from ship)
select station, t, {q6('east', 'east')} from c where (t < timestamp '1996-03-01' or i < 300) or (t > timestamp '1998-06-30')"""))
def cut_outside(spark, d):
    return series.cut(V.ship(spark, d), "1996-03-01", "1998-06-30", i_min=300, keep_inside=False).select("station", "t", r6("east"))


@query(with_views("ship", f"select station, t, {q6('east - first_value(east) over w', 'east')}, {q6('north - first_value(north) over w', 'north')} from ship window w as (partition by station order by t)"))
def initial_offset(spark, d):
    return series.remove_initial_offset(V.ship(spark, d), ["east", "north"]).select("station", "t", r6("east"), r6("north"))


@query(with_views("ship", "select distinct t, " + ", ".join([q6("2000 + date_diff('day', date '2000-01-01', cast(t as date)) / 365.25", "decyear"), *[q6(f"date_diff('second', timestamp '2000-01-01', t) / {k}", n) for k, n in ((31557600.0, "years"), (604800.0, "weeks"), (3600.0, "hours"))]]) + " from ship"))
def relative_time(spark, d):
    t = V.ship(spark, d).select("t").distinct()
    ref = "'2000-01-01'"
    x = t.withColumns({"decyear": timeunits.decimal_year("t"), "years": timeunits.elapsed("t", ref, "Y"), "weeks": timeunits.elapsed("t", ref, "W"), "hours": timeunits.elapsed("t", ref, "h")})
    return x.select("t", r6("decyear"), r6("years"), r6("weeks"), r6("hours"))


@query(with_views("ship", f"""select station, t, coalesce(east_var > 0 and north_var > 0 and up_var > 0 and east_var * north_var - east_north_cov * east_north_cov > 1e-9 * east_var * north_var
  and east_var * (north_var * up_var - north_up_cov * north_up_cov) - east_north_cov * (east_north_cov * up_var - north_up_cov * east_up_cov)
    + east_up_cov * (east_north_cov * north_up_cov - north_var * east_up_cov) > 1e-9 * east_var * north_var * up_var, false) as posdef,
  {q6("case when east_var > 0 and north_var > 0 then east_north_cov / sqrt(east_var * north_var) end", 'corr_en')} from ship"""))
def covariance_checks(spark, d):
    s = V.ship(spark, d).withColumn("corr_en", series.correlation("east_north_cov", "east_var", "north_var"))
    return s.select("station", "t", F.coalesce(series.posdef(SHIP), F.lit(False)).alias("posdef"), r6("corr_en"))


@query(with_views("ship", f"""|, tot as (select station, sum(abs(east)) as l1, count(*) as n from ship group by station)
select s.station, s.t, {q6('1.5 / (abs(s.east) + 1e-3)', 'w_inv')}, {q6('1.5 / (s.east * s.east + 1e-3 * 1e-3)', 'w_inv_sq')}, {q6('1.5 * ln((l1 + tot.n * 1e-3) / (abs(s.east) + 1e-3)) / ln(tot.n)', 'w_log')} from ship s join tot using (station)"""))
def reweight(spark, d):
    s = V.ship(spark, d)
    tot = s.groupBy("station").agg(F.sum(F.abs("east")).alias("l1"), F.count("*").alias("cnt"))
    j = s.join(tot, "station")
    x = F.col("east")
    j = j.withColumns({"w_inv": weights.inverse(x, 1e-3, 1.5), "w_inv_sq": weights.inverse_squared(x, 1e-3, 1.5), "w_log": weights.logarithmic(x, F.col("l1"), F.col("cnt"), 1e-3, 1.5)})
    return j.select("station", "t", r6("w_inv"), r6("w_inv_sq"), r6("w_log"))


# --- arithmetic and set operations ---


@query(with_views("ship", f"select a.station, a.t, {q6('a.east - b.total', 'difference')}, {q6('a.east * b.total', 'product')} from ship a join (select station, t, total from (select 'RF' as station, o_orderdate as t, sum(o_totalprice) / 1e5 as total from orders where o_orderstatus = 'F' group by all union all select 'NO', o_orderdate, sum(o_totalprice) / 1e5 from orders where o_orderstatus = 'O' group by all)) b on a.station = b.station and a.t = b.t"))
def series_math(spark, d):
    o = table(spark, d, "orders")
    b = o.filter("o_orderstatus in ('F', 'O')").groupBy(F.when(F.col("o_orderstatus") == "F", "RF").otherwise("NO").alias("station"), F.col("o_orderdate").alias("t")).agg((F.sum("o_totalprice") / 1e5).alias("total"))
    s = V.ship(spark, d)
    minus = series.combine(s, b, [("east", "total")], "-")
    times = series.combine(s, b, [("east", "total")], "*")
    return minus.join(times, ["station", "t"]).select("station", "t", r6("east-total", "difference"), r6("east*total", "product"))


@query(with_views("ship", f"select station, t, {q6('a.east', 'east')}, {q6('b.east_var', 'east_var')} from (select station, t, east from ship) a left join (select station, t, east_var from ship where n > 2) b using (station, t)"))
def copy_uncertainties(spark, d):
    s = V.ship(spark, d)
    return series.copy_uncertainties(s.select("station", "t", "east"), s.filter("n > 2"), ["east_var"]).select("station", "t", r6("east"), r6("east_var"))


def _deliveries(spark, d):
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("station"), F.col("l_shipdate").alias("t"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"), "l_orderkey", "l_linenumber", "l_quantity")


_DELIVERIES = "with x as (select l_returnflag || l_linestatus as station, l_shipdate as t, l_orderkey, l_linenumber, l_quantity from lineitem)"


@query(_DELIVERIES + " select station, t, l_orderkey, l_linenumber, l_quantity from x qualify row_number() over (partition by station, t order by l_orderkey, l_linenumber, l_quantity) = 1")
def dedup_first(spark, d):
    return series.dedup(_deliveries(spark, d), "first", "seq").drop("seq")


@query(_DELIVERIES + " select station, t, l_orderkey, l_linenumber, l_quantity from x qualify row_number() over (partition by station, t order by l_orderkey desc, l_linenumber desc, l_quantity desc) = 1")
def dedup_last(spark, d):
    return series.dedup(_deliveries(spark, d), "last", "seq").drop("seq")


@query(_DELIVERIES + " select station, t, l_orderkey, l_linenumber, l_quantity from x qualify count(*) over (partition by station, t) = 1")
def dedup_none(spark, d):
    return series.dedup(_deliveries(spark, d), "none", "seq").drop("seq")


@query("select distinct station from obs intersect select distinct station from catalog_maint where station is not null")
def station_intersection(spark, d):
    return table(spark, d, "obs").select("station").intersect(table(spark, d, "catalog_maint").select("station").filter("station is not null"))


@query("select s.station from (select distinct station from stations) s where not exists (select 1 from series x where x.station = s.station)")
def stations_without_series(spark, d):
    return table(spark, d, "stations").select("station").distinct().join(table(spark, d, "series"), "station", "left_anti")


@query("select station, count(*) as n, min(t) as first_t, max(t) as last_t from obs group by station")
def stations_with_series(spark, d):
    return table(spark, d, "obs").groupBy("station").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


# --- windows and cleaning ---

_MEDIAN = """|, o as (select *, row_number() over (partition by station order by t) as rn, count(*) over (partition by station) as cnt from {v}),
m as (select a.station, a.t, median(b.{c}) as med from o a join o b on a.station = b.station
  and b.rn between a.rn - {h} and a.rn + {h} where {cond} group by a.station, a.t)"""


def _median_cte(view: str, col: str, half: int, shrink: bool) -> str:
    cond = f"abs(a.rn - b.rn) <= least({half}, a.rn - 1, a.cnt - a.rn)" if shrink else "true"
    return _MEDIAN.format(v=view, c=col, h=half, cond=cond)


@query(with_views("ev", _median_cte("ev", "value", 3, True) + f" select station, t, {q6('med', 'value')} from m"))
def rolling_median_shrinking(spark, d):
    return cleaning.rolling_median(V.ev(spark, d), ["value"], 7).select("station", "t", r6("value"))


@query(with_views("nat", _median_cte("nat", "total", 3, False) + f" select station, t, {q6('med', 'total')} from m"))
def rolling_median_fixed(spark, d):
    return cleaning.rolling_median(V.nat(spark, d), ["total"], 7, shrink=False).select("station", "t", r6("total"))


@query(with_views("ev", _median_cte("ev", "value", 3, True) + f" select station, t, {q6('value - med', 'residual')} from ev join m using (station, t)"))
def median_residual(spark, d):
    e = V.ev(spark, d)
    return series.combine(e, cleaning.rolling_median(e, ["value"], 7), [("value", "value")], "-").select("station", "t", r6("value-value", "residual"))


def _clean_sql(std: float | None, iqr: float | None, min_obs: int, min_clean: int, thresh: float | None) -> str:
    tests = []
    if std is not None:
        tests.append(f"abs(r) > {std} * sd")
    if iqr is not None:
        tests.append(f"(r < q1 - {iqr} * (q3 - q1) or r > q3 + {iqr} * (q3 - q1))")
    limit = "true" if thresh is None else f"coalesce(se <= {thresh}, false)"
    return with_views("nat", _median_cte("nat", "total", 5, True) + f""", r as (select nat.station, nat.t, total, total - med as r from nat join m using (station, t)),
s as (select station, stddev_pop(r) as sd, quantile_cont(r, 0.25) as q1, quantile_cont(r, 0.75) as q3, count(total) as n from r group by station),
k as (select r.*, n >= {min_obs} and r is not null and not coalesce({' and '.join(tests)}, false) as keep from r join s using (station)),
e as (select station, count(*) filter (where keep) as m, stddev_pop(case when keep then r end) as se from k group by station)
select station, t, {q6(f'case when keep and m >= {min_clean} and {limit} then total end', 'total')} from k join e using (station)""")


def _clean(**kw):
    def run(spark, d):
        n = V.nat(spark, d)
        return cleaning.clean(n, cleaning.rolling_median(n, ["total"], 11), ["total"], **kw).select("station", "t", r6("total"))

    return run


for _name, _kw in {
    "clean_std": {"std_outlier": 3.0},
    "clean_iqr": {"iqr_outlier": 1.5},
    "clean_and": {"std_outlier": 2.0, "iqr_outlier": 1.5},
    "clean_min_obs": {"std_outlier": 3.0, "min_obs": 500, "min_clean_obs": 520},
    "clean_std_thresh": {"std_outlier": 3.0, "std_thresh": 2.0},
}.items():
    QUERIES[_name] = _clean(**_kw)
    SQL[_name] = _clean_sql(_kw.get("std_outlier"), _kw.get("iqr_outlier"), _kw.get("min_obs", 100), _kw.get("min_clean_obs", 100), _kw.get("std_thresh"))


@query(with_views("ship", f"""|, z as (select station, north, coalesce(north, 0) as z from ship), b as (select station, avg(z) as m, stddev_pop(z) as s from z group by station)
select station, {q6('avg(north)', 'mean')}, {q6('stddev_samp(north)', 'std')}, {q6('sqrt(avg(north * north))', 'rms')}, count(north) as observations, count(*) - count(north) as gaps,
  count(*) filter (where z - m > 2 * s) as outliers, count(*) filter (where abs(z - m) > 2 * s) as outliers_two_sided from z join b using (station) group by station"""))
def residual_stats(spark, d):
    x = cleaning.residual_stats(V.ship(spark, d), "north", 2.0)
    return x.select("station", r6("mean"), r6("std"), r6("rms"), "observations", "gaps", "outliers", "outliers_two_sided")


@query(with_views("ship", f"""|, x as (select station, t, north - avg(north) over (partition by station) as x from ship),
r as (select station, case when count(x) over w >= 10 then avg(x) over w end as roll from x window w as (partition by station order by t rows between 20 preceding and current row))
select station, {q6('arg_max(roll, abs(roll))', 'max_rolling_dev')} from r group by station"""))
def max_rolling_dev(spark, d):
    return cleaning.max_rolling_deviation(V.ship(spark, d), "north", 21).select("station", r6("max_rolling_dev"))


@query(with_views("nat", f"""|, g as (select station, date_diff('second', lag(t) over (partition by station order by t), t) / 86400.0 as gap from nat),
s as (select station, count(*) as n_obs, sum(gap) as length_days, median(gap) as median_step_days from g group by station)
select station, n_obs, {q6('length_days', 'length_days')}, {q6('median_step_days', 'median_step_days')}, {q6('n_obs / (round_even(length_days / median_step_days, 0) + 1)', 'reliability')} from s"""))
def reliability(spark, d):
    return availability.reliability(V.nat(spark, d)).select("station", "n_obs", r6("length_days"), r6("median_step_days"), r6("reliability"))


@query("""select station, count(*) as number, cast(min(t) as date) as age, cast(max(t) as date) as recency, date_diff('day', cast(min(t) as date), cast(max(t) as date)) + 1.0::double as length_days,
""" + q6("count(*) / (date_diff('day', cast(min(t) as date), cast(max(t) as date)) + 1.0::double)", "reliability") + " from obs group by station")
def availability_metrics(spark, d):
    x = availability.availability_metrics(table(spark, d, "obs").select("station", "t"), 1.0)
    return x.select("station", "number", "age", "recency", F.col("length_days").cast("double").alias("length_days"), r6("reliability"))


@query("""with x as (select distinct station, t from obs), y as (select *, case when date_diff('microsecond', lag(t) over w, t) <= 172800000000 then 0 else 1 end as new from x window w as (partition by station order by t)),
z as (select *, sum(new) over (partition by station order by t) as g from y) select station, min(t) as start_t, max(t) as end_t, count(*) as n from z group by station, g""")
def availability_intervals(spark, d):
    return availability.availability_intervals(table(spark, d, "obs").select("station", "t"), 2.0)


# --- trends ---


@query(with_views("ship", f"""select station, count(east) as n, {q6("regr_slope(east, date_diff('second', timestamp '2000-01-01', t) / 31557600.0)", 'slope')}, {q6("regr_intercept(east, date_diff('second', timestamp '2000-01-01', t) / 31557600.0)", 'intercept')} from ship group by station"""))
def trend_unweighted(spark, d):
    return trends.trend(V.ship(spark, d), "east", unit="Y").select("station", "n", r6("slope"), r6("intercept"))


@query(with_views("ship", f"""|, x as (select station, east, 1 / east_var as w, date_diff('second', timestamp '2000-01-01', t) / 31557600.0 as tt from ship where east_var > 0),
s as (select station, count(*) as n, sum(w) sw, sum(w * tt) st, sum(w * tt * tt) stt, sum(w * east) sx, sum(w * tt * east) stx from x group by station)
select station, n, {q6('(sw * stx - st * sx) / (sw * stt - st * st)', 'slope')}, {q6('sqrt(sw / (sw * stt - st * st))', 'slope_sd')} from s"""))
def trend_weighted(spark, d):
    return trends.trend(V.ship(spark, d), "east", "east_var", "Y").filter("n > 0").select("station", "n", r6("slope"), r6("slope_sd"))


@query(with_views("ev err", f"""|, x as (select e.station, e.time, date_diff('microsecond', date_trunc('day', e.time)::timestamp, o.t) / 86400e6 as dt, o.value
  from (select distinct station, time from err) e join ev o on o.station = e.station and o.t >= date_trunc('day', e.time)::timestamp - interval 10 day and o.t <= date_trunc('day', e.time)::timestamp + interval 10 day),
y as (select station, time, regr_slope(value, dt) filter (where dt < 0) as a, regr_slope(value, dt) filter (where dt >= 0) as b, count(*) filter (where dt < 0) as n_before, count(*) filter (where dt >= 0) as n_after from x group by all)
select station, time, n_before, n_after, {q6('c', 'change', 4)}, cast(case when abs(c) >= 0.5 then sign(c) when c is not null then 0 end as integer) as sign from (select *, case when n_before > 1 and n_after > 1 then b - a end as c from y)"""))
def trend_change(spark, d):
    return trends.trend_change(V.ev(spark, d), V.errors(spark, d), "value", 10.0, 0.5).select("station", "time", "n_before", "n_after", r6("change", digits=4), "sign")


# --- events ---


@query("""with e as (select distinct station, maint_time as time from catalog_maint where station is not null and maint_time is not null)
select e.station, e.time, (select min(o.t) from obs o where o.station = e.station and o.t >= e.time) as next_t from e""")
def asof_next_epoch(spark, d):
    m = table(spark, d, "catalog_maint").select("station", F.col("maint_time").alias("time")).dropna()
    return events.next_epoch(m, table(spark, d, "obs").select("station", "t"))


@query(with_views("ev err", f"""|, i as (select station, lag(t) over (partition by station order by t) as a, t as b from ev)
select i.station, i.b as t, max(e.time) as step_time, {q6('sum(e.size)', 'total')}, count(*) as n from i join err e on e.station = i.station and e.time > i.a and e.time <= i.b group by all having sum(e.size) >= 20"""))
def range_event_intervals(spark, d):
    return events.interval_events(V.ev(spark, d), V.errors(spark, d), 20.0).select("station", "t", "step_time", r6("total"), "n")


@query(f"""with e as (select eq_id, any_value(lat) lat, any_value(lon) lon, any_value(coalesce(depth_km, 0)) dep, any_value(mw) mw from catalog_eq where eq_id is not null and lat is not null and lon is not null and mw is not null group by eq_id),
p as (select e.eq_id, s.station, mw, sqrt(pow((s.lat - e.lat) * ({events.KM_LAT} - {events.KM_LAT_COS} * cos(radians(2 * e.lat))), 2) + pow((s.lon - e.lon) * {events.KM_LON} * cos(radians(e.lat)), 2) + pow(coalesce(s.alt, 0) / 1000 + e.dep, 2)) as km from e, stations s)
select eq_id, station, {q6("km", "distance_km", 4)} from p where km < pow(10, mw / 2 - 0.8)""")
def theta_distance_steps(spark, d):
    return events.events_in_reach(table(spark, d, "catalog_eq"), table(spark, d, "stations")).select("eq_id", "station", r6("distance_km", digits=4))


@query("""select distinct m.station, m.maint_time as time from catalog_maint m join (select station, min(t) a, max(t) b from obs group by station) s using (station) where m.maint_time between a and b""")
def maintenance_in_span(spark, d):
    return events.maintenance_in_span(table(spark, d, "catalog_maint").withColumnRenamed("maint_time", "time"), table(spark, d, "obs"))


@query("""with x as (select distinct station, maint_time as time from catalog_maint where station is not null and maint_time is not null and code = 1)
select station, row_number() over (partition by station order by time) as pos, time, count(*) over (partition by station) as n from x""")
def maintenance_dict(spark, d):
    """The times of each station in order; the array of a station (a catalog's entries) comes out row by row."""
    m = table(spark, d, "catalog_maint").filter("code = 1 and station is not null and maint_time is not null")
    times = m.groupBy("station").agg(F.array_sort(F.collect_set("maint_time")).alias("times"))
    return times.select("station", F.posexplode("times").alias("pos", "time"), F.size("times").cast("bigint").alias("n")).select("station", (F.col("pos") + 1).cast("bigint").alias("pos"), "time", "n")


@query("""with m as (select distinct station, maint_time as time from catalog_maint where code = 1 and station is not null and maint_time is not null), q as (select distinct station, maint_time as time from catalog_maint where code = 2 and station is not null and maint_time is not null)
select station, time, m.time is not null and q.time is not null as both_kinds from (select * from m) m full outer join q using (station, time)""")
def merge_catalogs(spark, d):
    c = table(spark, d, "catalog_maint").select("station", F.col("maint_time").alias("time"), "code").dropna().distinct()
    a, b = (c.filter(f"code = {k}").select("station", "time").withColumn(f"_{k}", F.lit(True)) for k in (1, 2))
    return a.join(b, ["station", "time"], "full_outer").select("station", "time", (F.col("_1").isNotNull() & F.col("_2").isNotNull()).alias("both_kinds"))


@query("""with t as (select distinct maint_time as time from catalog_maint where maint_time is not null), x as (select time, case when date_diff('microsecond', lag(time) over (order by time), time) <= 5 * 86400000000 then 0 else 1 end as new from t),
g as (select *, sum(new) over (order by time) as g from x) select min(time) as start_t, max(time) as end_t, count(*) as n from g group by g""")
def step_ranges(spark, d):
    return events.sessions(table(spark, d, "catalog_maint").select(F.col("maint_time").alias("time")), 5.0)


# --- steps ---

def _step_sql(view: str, column: str, half: int, least: int) -> str:
    """Scores of every row, the window shrinking at the ends down to `least` rows."""
    return f"""|, v as (select station, t, {column} - avg({column}) over (partition by station) as x, row_number() over w as rn, count(*) over (partition by station) as cnt,
   date_diff('second', timestamp '1998-01-01', t) / 86400.0 as tt from {view} window w as (partition by station order by t)),
vh as (select *, least({half}, rn - 1, cnt - rn) as h from v),
p as (select a.station, a.t, b.rn >= a.rn as post, count(b.x)::double as n, avg(b.tt - a.tt) as tm, avg(b.x) as xm, var_pop(b.tt - a.tt) * count(b.x) as stt, covar_pop(b.tt - a.tt, b.x) * count(b.x) as stx, var_pop(b.x) * count(b.x) as sxx
  from vh a join vh b on a.station = b.station and b.rn between a.rn - a.h and a.rn + a.h where b.x is not null and 2 * a.h + 1 >= {least} group by 1, 2, 3),
q as (select a.station, a.t, a.n + b.n as n, a.stt + b.stt as wtt, a.stx + b.stx as wtx, a.sxx + b.sxx as wxx, a.n * b.n / (a.n + b.n) as h, b.tm - a.tm as dt, b.xm - a.xm as dx from p a join p b on a.station = b.station and a.t = b.t and not a.post and b.post where a.n >= 2 and b.n >= 2),
r as (select station, t, n, (wxx + h * dx * dx) - pow(wtx + h * dt * dx, 2) / (wtt + h * dt * dt) as rss0, wxx - wtx * wtx / wtt as rss1 from q),
s as (select station, t, case when n > 5 and rss0 > 0 and rss1 > 0 then (n * ln(rss0 / n) + 6 + 24.0 / (n - 4)) - (n * ln(rss1 / n) + 8 + 40.0 / (n - 5)) end as delta, rss0 / n as var0, rss1 / n as var1 from r)"""


_STEP = _step_sql("nat", "total", 15, 31)


@query(with_views("nat", _step_sql("nat", "total", 15, 11) + f" select nat.station, nat.t, {q6('case when delta > 0 then delta end', 'probability', 4)}, {q6('var0', 'var0')}, {q6('var1', 'var1')} from nat left join s using (station, t)"))
def step_detect_shrinking(spark, d):
    return steps.step_scores(V.nat(spark, d), "total", 31, kernel_min=11).select("station", "t", r6("probability", digits=4), r6("var0"), r6("var1"))


def _components_sql() -> str:
    parts = {c: _step_sql("ship", c, 10, 21).lstrip().removeprefix("|").lstrip(", ") for c in ("east", "up")}
    both = " union all ".join(f"(with {p} select station, t, coalesce(delta, -1) as pr from s)" for p in parts.values())
    return f"select ship.station, ship.t, {q6('case when max(pr) > 0 then max(pr) end', 'probability', 4)} from ship left join ({both}) x using (station, t) group by all"


@query(with_views("ship", _components_sql()))
def step_components(spark, d):
    """The highest score over two components."""
    s = V.ship(spark, d)
    return steps.over_components([steps.step_scores(s, c, 21) for c in ("east", "up")]).select("station", "t", r6("probability", digits=4))


@query(with_views("nat", _STEP + f" select nat.station, nat.t, {q6('case when delta > 0 then delta end', 'probability', 4)}, {q6('var0', 'var0')}, {q6('var1', 'var1')} from nat left join s using (station, t)"))
def step_detect_moments(spark, d):
    return steps.step_scores(V.nat(spark, d), "total", 31).select("station", "t", r6("probability", digits=4), r6("var0"), r6("var1"))


@query(with_views("nat", _STEP + f""", f as (select nat.station, nat.t, coalesce(case when delta > 0 then delta end, -1) as pr, var0, var1 from nat left join s using (station, t)),
g as (select *, lag(pr) over w as a, lead(pr) over w as b from f window w as (partition by station order by t)),
k as (select *, row_number() over (partition by station order by pr desc, t) as r from g where pr > a and pr > b and pr >= 2)
select station, t, {q6('pr', 'probability', 4)}, {q6('(var0 - var1) / var0', 'varred')} from k where r <= 3"""))
def step_peaks_topk(spark, d):
    return steps.step_peaks(steps.step_scores(V.nat(spark, d), "total", 31), 2.0, 3).select("station", "t", r6("probability", digits=4), r6("varred"))


# --- network ---

_KM = f"2 * {network.EARTH_KM} * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_PAIRS = f"|, pr as (select a.station, b.station as other, {_KM} as km from sta a, sta b)"


@query(with_views("sta", _PAIRS + f", k as (select *, row_number() over (partition by station order by km, other) as r from pr where station <> other) select station, {q6('avg(km)', 'mean_km', 4)} from k where r <= 4 group by station"))
def nearest_k_mean_distance(spark, d):
    return network.nearest_mean_distance(network.neighbours(V.sta(spark, d), 21_000.0), 4).select("station", r6("mean_km", digits=4))


@query(with_views("sta", _PAIRS + f""", k as (select *, row_number() over (partition by station order by km, other) as r from pr where station <> other),
m as (select station, greatest(least(avg(km), 3000.0), 10.0) as s from k where r <= 4 group by station)
select pr.station, other, {q6('exp(-km / s)', 'weight')} from pr join m using (station)"""))
def distance_weights(spark, d):
    w = network.distance_weights(network.neighbours(V.sta(spark, d), 21_000.0), 4, 10.0, 3000.0)
    return w.select("station", "other", r6("weight"))


@query(f"with x as (select a.station, b.station as other, {_KM} as km from stations a, stations b) select station, other, {q6("km", "km", 4)} from x where km <= 500")
def neighbour_pairs(spark, d):
    return network.neighbours(table(spark, d, "stations"), 500.0).select("station", "other", r6("km", digits=4))


@query(with_views("nat sta", _PAIRS + f", v as (select station as other, avg(total) as value from nat group by station) select pr.station, {q6('sum(exp(-km / 2000.0) * value) / sum(exp(-km / 2000.0))', 'spatial_mean')} from pr join v using (other) group by pr.station"))
def spatial_weighted_mean(spark, d):
    v = V.nat(spark, d).groupBy("station").agg(F.avg("total").alias("value"))
    return network.spatial_mean(network.neighbours(V.sta(spark, d), 21_000.0), v, "value", 2000.0).select("station", r6("spatial_mean"))


_WM = """with x as (select p_type as kind, p_retailprice as v, p_size::double as w from part), y as (select kind, v, sum(w) as w from x group by all),
z as (select *, sum(w) over (partition by kind order by v rows unbounded preceding) as run, sum(w) over (partition by kind) as tot from y)
select kind, min(v) filter (where run >= tot * {p} - 1e-12 * tot) as weighted_median from z group by kind"""


@query(_WM.format(p=0.5))
def weighted_median(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("w"))
    return network.weighted_median(p, ["kind"], "v", "w")


@query(_WM.format(p=0.9))
def weighted_percentile(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("w"))
    return network.weighted_median(p, ["kind"], "v", "w", 0.9)


_SHIPS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query(with_views("ship", "select t, " + ", ".join(f"round(max(case when station = '{s}' then east end) + {V.NUDGE}, 6) + 0.0 as {s}" for s in _SHIPS) + " from ship group by t"))
def pivot_network(spark, d):
    return network.wide(V.ship(spark, d), "east", _SHIPS).select("t", *[r6(s) for s in _SHIPS])


@query(with_views("ship", f"select station, t, {q6('east', 'east')} from ship where east is not null"))
def unpivot_dropna(spark, d):
    return network.tall(network.wide(V.ship(spark, d), "east", _SHIPS), _SHIPS, "east").select("station", "t", r6("east"))


@query(with_views("nat", f"select a.station, b.station as other, count(*) as n, {q6('abs(corr(a.total, b.total))', 'corr')} from nat a join nat b on a.t = b.t and a.station < b.station group by all having count(*) >= 30"))
def network_corr(spark, d):
    pairs = network.neighbours(V.sta(spark, d), 21_000.0)
    return network.pair_correlation(V.nat(spark, d), "total", pairs, floor_n=30).select("station", "other", "n", r6("corr"))


@query("select file_name, count(*) as lines, count(*) filter (where trim(replace(raw_line, chr(13), '')) = '') as blank from location_lines group by file_name")
def location_inventory(spark, d):
    return table(spark, d, "location_lines").groupBy("file_name").agg(F.count("*").alias("lines"), F.count_if(F.trim(F.replace("raw_line", F.lit("\r"), F.lit(""))) == "").alias("blank"))


@query("select round(degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))), 5) + 0.0 as mean_lon, count(*) as n from stations where lon is not null")
def mean_longitude(spark, d):
    return table(spark, d, "stations").filter("lon is not null").agg(F.round(network.mean_longitude("lon"), 5).alias("mean_lon"), F.count("*").alias("n")).select((F.col("mean_lon") + 0.0).alias("mean_lon"), "n")


@query("select station, lat, lon from stations where lat between -30 and 40 and lon between -20 and 60 and lat < lon + 10")
def stations_in_polygon(spark, d):
    # the bounded half plane lat < lon + 10 of the box, as a polygon
    poly = [(-20.0, -30.0), (60.0, -30.0), (60.0, 40.0), (30.0, 40.0), (-20.0, -10.0)]
    return table(spark, d, "stations").filter(network.point_in_polygon(F.col("lon"), F.col("lat"), poly)).select("station", "lat", "lon")


# --- trends, events and networks, further ---

_EVENT_DAYS = "(select unnest([timestamp '1996-01-15 07:00:00', timestamp '1997-06-01', timestamp '1998-11-11 12:30:00']) as time)"


@query(with_views("ship", f"""|, x as (select station, time, date_diff('second', date_trunc('day', time)::timestamp, t) / 86400.0 as dt, east as y, 1 / east_var as w from ship, {_EVENT_DAYS} e where east_var > 0 and abs(date_diff('second', date_trunc('day', time)::timestamp, t)) <= 90 * 86400),
y as (select station, time, dt >= 0 as post, count(*) as n, (sum(w) * sum(w * dt * y) - sum(w * dt) * sum(w * y)) / nullif(sum(w) * sum(w * dt * dt) - sum(w * dt) * sum(w * dt), 0) as b from x group by all)
select station, time, {q6("max(b) filter (where post) - max(b) filter (where not post)", 'change', 5)} from y group by station, time"""))
def trend_change_weighted(spark, d):
    s = V.ship(spark, d)
    days = F.array(*[F.lit(x).cast("timestamp_ntz") for x in ("1996-01-15 07:00:00", "1997-06-01 00:00:00", "1998-11-11 12:30:00")])
    ev = s.select("station").distinct().withColumn("time", F.explode(days))
    return trends.trend_change(s, ev, "east", 90.0, 0.0, "east_var").select("station", "time", r6("change", digits=5))


@query(with_views("ship", f"select station, count(east) as n, {q6('regr_slope(east, x)', 'slope')} from (select station, east, date_diff('second', timestamp '2000-01-01', t) / 31557600.0 as x from ship where t >= timestamp '1996-01-01' and t <= timestamp '1997-12-31') group by station"))
def trend_in_span(spark, d):
    return trends.trend(V.ship(spark, d), "east", unit="Y", start="1996-01-01", end="1997-12-31").select("station", "n", r6("slope"))


_NEAR_KM = f"2 * {network.EARTH_KM} * asin(sqrt(least(1.0, pow(sin((radians(e.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - s.lon) / 2), 2))))"


@query(f"""with e as (select distinct on (eq_id) eq_id, lat, lon, origin_time, mw from catalog_eq where eq_id is not null and lat is not null and lon is not null and origin_time is not null),
o as (select station, min(t) as a, max(t) as b from obs group by station), s as (select distinct on (station) station, lat, lon from stations where lat is not null and lon is not null)
select eq_id, station, {q6("km", "km", 4)} from (select eq_id, s.station, mw, {_NEAR_KM} as km from e, s join o using (station) where e.origin_time between o.a - interval 10 day and o.b + interval 10 day) where km <= 800 or mw > 6.5""")
def events_for_stations(spark, d):
    """Events within 800 km, or above magnitude 6.5, in the time of a station's series."""
    span = table(spark, d, "obs").groupBy("station").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    targets = table(spark, d, "stations").join(span, "station")
    return events.events_for_stations(table(spark, d, "catalog_eq"), targets, 800.0, 6.5, 10.0).select("eq_id", "station", r6("km", digits=4))


def _planes(spark, d):
    e = table(spark, d, "catalog_eq").select("eq_id", "origin_time", "lat", "lon", "depth_km", (F.col("mw") + 2.5).alias("mw"))
    angle = lambda k, n, low=0: (F.pmod(F.col("eq_id") * k, F.lit(n)) + low).cast("double")
    return e.withColumns({"strike": angle(37, 360), "dip": angle(13, 79, 5), "rake": angle(29, 360, -180), "mo_nm": F.lit(None).cast("double")})


def _okada_sql() -> str:
    k = events
    return f"""e as (select distinct on (eq_id) eq_id, lat, lon, depth_km as d, mw + 2.5 as mw, (eq_id * 37) % 360 as strike, (eq_id * 13) % 79 + 5 as dip, (eq_id * 29) % 360 - 180 as rake from catalog_eq
  where eq_id is not null and lat is not null and lon is not null and mw is not null and origin_time is not null and depth_km > 0),
p as (select e.*, s.station, (s.lat - e.lat) * ({k.KM_LAT} - {k.KM_LAT_COS} * cos(radians(2 * e.lat))) as n, (s.lon - e.lon) * {k.KM_LON} * cos(radians(e.lat)) as ea, coalesce(s.alt, 0) / 1000 + d as dz from e, stations s where s.lat is not null and s.lon is not null),
g as (select *, sin(radians(strike)) as ss, cos(radians(strike)) as cs, sin(radians(dip)) as sd, cos(radians(dip)) as cd, cos(radians(rake)) as a, sin(radians(rake)) as b, pow(10, 1.5 * mw + 9.1) / 48e9 / 1e9 as m from p where sqrt(n * n + ea * ea + dz * dz) < pow(10, mw / 2 - 0.8)),
x as (select *, ea * ss + n * cs as x, n * ss - ea * cs as y from g),
r as (select *, y * cd + d * sd as p, y * sd - d * cd as q, sqrt(x * x + y * y + d * d) as r from x),
i as (select *, 0.5 * y * (1 / (r * pow(r + d, 2)) - x * x * (3 * r + d) / (pow(r, 3) * pow(r + d, 3))) as i1, 0.5 * x * (1 / (r * pow(r + d, 2)) - y * y * (3 * r + d) / (pow(r, 3) * pow(r + d, 3))) as i2,
  -0.5 * x * y * (2 * r + d) / (pow(r, 3) * pow(r + d, 2)) as i4, 0.5 * (1 / (r * (r + d)) - x * x * (2 * r + d) / (pow(r, 3) * pow(r + d, 2))) as i5 from r),
u as (select *, -m / (2 * pi()) * (a * (3 * x * x * q / pow(r, 5) + i1 * sd) + b * (3 * x * p * q / pow(r, 5) - (0.5 * x / pow(r, 3) - i2) * sd * cd)) as ux,
  -m / (2 * pi()) * (a * (3 * x * y * q / pow(r, 5) + i2 * sd) + b * (3 * y * p * q / pow(r, 5) - i1 * sd * cd)) as uy, -m / (2 * pi()) * (a * (3 * x * d * q / pow(r, 5) + i4 * sd) + b * (3 * d * p * q / pow(r, 5) - i5 * sd * cd)) as uz from i)"""


@query(f"with {_okada_sql()} select eq_id, station, {q6('(ux * ss - uy * cs) * 1e6', 'east_mm', 4)}, {q6('(ux * cs + uy * ss) * 1e6', 'north_mm', 4)}, {q6('uz * 1e6', 'up_mm', 4)} from u")
def dislocations(spark, d):
    """Displacements by point sources with planes made up from the event's number."""
    return dislocation.displacements(_planes(spark, d), table(spark, d, "stations")).select("eq_id", "station", *[r6(c, digits=4) for c in ("east_mm", "north_mm", "up_mm")])


@query(with_views("ship", f"select station, {q6('sqrt(a * a + b * b)', 'total')} from (select station, sqrt(avg(east * east)) as a, sqrt(avg(north * north)) as b from ship group by station) order by total desc, station limit 3"))
def worst_stations(spark, d):
    """A top-k report: the three stations with the largest root mean squares."""
    x = cleaning.component_stats(V.ship(spark, d), ["east", "north"]).groupBy("station").pivot("comp", ["east", "north"]).agg(F.first("rms"))
    return network.worst_stations(x, ["east", "north"], 3).select("station", r6("total"))


@query(with_views("sta", f"|, p as (select station as point, lat, lon from sta), x as (select point, s.station, {_NEAR_KM.replace('e.', 'p.')} as km from p, stations s where s.lat is not null and s.lon is not null) select point as point_id, station, {q6('km', 'km', 4)} from x qualify row_number() over (partition by point order by km, station) = 1"))
def nearest_station(spark, d):
    return network.nearest_station(V.sta(spark, d).select(F.col("station").alias("point_id"), "lat", "lon"), table(spark, d, "stations")).select("point_id", "station", r6("km", digits=4))


@query("with i as (select station, count(*) as n from obs group by station) select i.station, n, lat from i join (select distinct on (station) station, lat from stations) s using (station)")
def availability_by_latitude(spark, d):
    return network.by_latitude(table(spark, d, "obs").groupBy("station").agg(F.count("*").alias("n")), table(spark, d, "stations"))


@query(f"with x as (select {_KM} as km from stations a, stations b where a.station <> b.station) select " + ", ".join(q6(f"quantile_cont(km, {p})", f"p{int(p * 100)}", 4) for p in (0.05, 0.5, 0.95)) + " from x where km <= 3000")
def distance_percentiles(spark, d):
    pairs = network.neighbours(table(spark, d, "stations"), 3000.0).filter("station <> other").withColumn("k", F.lit(0))
    q = quantiles.exact_quantiles(pairs, "k", "km", [0.05, 0.5, 0.95])
    return q.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p50", "p95"))]).select(*[r6(n, digits=4) for n in ("p5", "p50", "p95")])


@query("select l_returnflag as flag, " + ", ".join(q6(f"quantile_cont(l_extendedprice, {p})", f"p{int(p * 100)}", 4) for p in (0.05, 0.5, 0.95)) + " from lineitem group by 1")
def group_quantiles(spark, d):
    """Exact quantiles of groups that are taken for hot ones."""
    q = quantiles.exact_quantiles(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), "flag", "l_extendedprice", [0.05, 0.5, 0.95], hot=5000)
    return q.select("flag", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p50", "p95"))]).select("flag", *[r6(n, digits=4) for n in ("p5", "p50", "p95")])


@query(with_views("sta", _PAIRS + f""", k as (select *, row_number() over (partition by station order by km, other) as r from pr where station <> other),
m as (select station, greatest(least(avg(km), 900.0), 10.0) as s from k where r <= 4 group by station)
select pr.station, other, {q6('exp(-km / s)', 'weight')} from pr join m using (station) where exp(-km / s) >= {network.LEAST_WEIGHT}"""))
def coupling_weights(spark, d):
    return network.coupling(V.sta(spark, d), 4, 10.0, 900.0).select("station", "other", r6("weight"))


@query(with_views("nat", f"""|, g as (select station, date_diff('second', lag(t) over (partition by station order by t), t) / 86400.0 as gap from nat),
s as (select station, count(*) as n_obs, sum(gap) as length_days, median(gap) as step from g group by station)
select station, n_obs from s where n_obs / (round_even(length_days / step, 0) + 1) > 0.7 and length_days > 365"""))
def quality_gate(spark, d):
    return availability.quality_gate(V.nat(spark, d), 0.7).select("station", "n_obs")


@query(with_views("nat", f"|, p as (select a.station, b.station as other, count(*) as n, abs(corr(a.total, b.total)) as c from nat a join nat b on a.t = b.t and a.station < b.station group by all having count(*) >= 30) select {q6('avg(c)', 'mean_corr')}, count(*) as n from p"))
def mean_correlation(spark, d):
    pairs = network.neighbours(V.sta(spark, d), 21_000.0)
    return network.mean_correlation(network.pair_correlation(V.nat(spark, d), "total", pairs, floor_n=30)).select(r6("mean_corr"), "n")


_DAY = "date_diff('second', timestamp '2000-01-01', a.t) / 86400.0"


@query(with_views("nat", f"""|, p as (select a.station, b.station as other, count(*) as n, corr(a.total, b.total) as xy, corr(a.total, {_DAY}) as xt, corr(b.total, {_DAY}) as yt from nat a join nat b on a.t = b.t and a.station < b.station group by all having count(*) >= 30)
select station, other, n, {q6('abs((xy - xt * yt) / sqrt((1 - xt * xt) * (1 - yt * yt)))', 'corr')} from p"""))
def network_corr_detrended(spark, d):
    pairs = network.neighbours(V.sta(spark, d), 21_000.0)
    return network.pair_correlation(V.nat(spark, d), "total", pairs, True, 30).select("station", "other", "n", r6("corr"))


@query("select station, t, row_number() over (partition by station order by t, obs_id) - 1 as i from (select distinct station, t, min(obs_id) as obs_id from obs where station is not null and t is not null group by station, t)")
def numbered_rows(spark, d):
    o = table(spark, d, "obs").filter("station is not null and t is not null").select("station", "t").distinct()
    return series.numbered(o).select("station", "t", F.col("_row").cast("bigint").alias("i"))


@query(f"select station, round(-sin(radians(lon)) * 1000 + cos(radians(lon)) * 2000, 6) + 0.0 as e, round(-sin(radians(lat)) * cos(radians(lon)) * 1000 - sin(radians(lat)) * sin(radians(lon)) * 2000 + cos(radians(lat)) * 3000, 6) + 0.0 as n, round(cos(radians(lat)) * cos(radians(lon)) * 1000 + cos(radians(lat)) * sin(radians(lon)) * 2000 + sin(radians(lat)) * 3000, 6) + 0.0 as u from stations where lat is not null and lon is not null")
def enu_offsets(spark, d):
    s = table(spark, d, "stations").dropna(subset=["lat", "lon"])
    e, n, u = geodesy.enu(F.lit(1000.0), F.lit(2000.0), F.lit(3000.0), F.col("lat"), F.col("lon"))
    return s.select("station", *[(F.round(c, 6) + 0.0).alias(k) for c, k in zip((e, n, u), "enu")])


@query(with_views("ev err", f"|, f as (select station, t as time, value from ev) select err.station, err.time, {q6('err.size', 'size')}, {q6('f.value', 'value')} from err left join f using (station, time)"))
def augment_catalog(spark, d):
    found = V.ev(spark, d).select("station", F.col("t").alias("time"), "value")
    return events.augment(V.errors(spark, d), found, ["value"]).select("station", "time", r6("size"), r6("value"))


@query(with_views("ev err", "select station, t from ev where exists (select 1 from err where err.station = ev.station and err.time = ev.t)"))
def timestamp_semi_join(spark, d):
    return V.ev(spark, d).join(V.errors(spark, d).select("station", F.col("time").alias("t")), ["station", "t"], "left_semi").select("station", "t")


@query(with_views("ship nat", f"select station, t, {q6('east', 'value')} from ship union all select station, t, {q6('total', 'value')} from nat"))
def concat_networks(spark, d):
    a = V.ship(spark, d).select("station", "t", F.col("east").alias("value"))
    return a.unionByName(V.nat(spark, d).select("station", "t", F.col("total").alias("value"))).select("station", "t", r6("value"))


@query(with_views("ship", f"""|, x as (select station, t, east - first_value(east) over w as de, north - first_value(north) over w as dn from ship where east is not null and north is not null window w as (partition by station order by t))
select station, t, {q6('sqrt(de * de + dn * dn)', 'distance')}, {q6('case when de = 0 and dn = 0 then 90.0 else degrees(atan2(de, dn)) + case when atan2(de, dn) < 0 then 360 else 0 end end', 'azimuth', 4)} from x"""))
def displacement_paths(spark, d):
    return products.displacement_paths(V.ship(spark, d)).select("station", "t", r6("distance"), r6("azimuth", digits=4))


@query(with_views("ship", f"""|, x as (select station, t, east as x, row_number() over (partition by station order by t) as r, count(*) over (partition by station) as c from ship)
select station, {q6('(max(x) filter (where r = c)) - (max(x) filter (where r = 1))', 'change')}, count(*) as n from x group by station"""))
def first_to_last(spark, d):
    rows = series.numbered(V.ship(spark, d).select("station", "t", "east"))
    ends = rows.groupBy("station").agg((F.max_by("east", "_row") - F.min_by("east", "_row")).alias("change"), F.count("*").alias("n"))
    return ends.select("station", r6("change"), "n")
