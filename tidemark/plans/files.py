"""Queries of readers and sinks: tables are written to the shared folder in each format and read back, with the SQL of
what must come out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geodesy import ecef
from tidemark.plans import views as V
from tidemark.plans.views import q6, r6, with_views
from tidemark.session import scratch_path, shared_text
from tidemark.solve.models import ModelSpec
from tidemark.sources import formats, netjson, sinks
from tidemark.sources.tables import table
from tidemark.streaming import quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DATA, VARS, COVS = formats.DATA, formats.VARS, formats.COVS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _text(lines: DataFrame, name: str, by: str | None = None, **options: str) -> str:
    """Write the column `value` as text, in its order, or a folder for each value of `by`."""
    at = scratch_path(lines.sparkSession, name)
    w = (lines.repartition(by).sortWithinPartitions(by, "_k").drop("_k") if by else lines.coalesce(1)).write.options(**options)
    (w.partitionBy(by) if by else w).text(at)
    return at


def _words(*cols: Column) -> Column:
    return F.concat_ws("  ", *[c.cast("string") for c in cols])


def _sure(spark, d) -> DataFrame:
    """`ship` where all variances are known, in metres, with deviations and correlations."""
    s = V.ship(spark, d).filter("east_var > 0 and north_var > 0 and up_var > 0")
    sd = {c: F.sqrt(f"{c}_var") for c in DATA}
    pairs = (("east", "north"), ("east", "up"), ("north", "up"))
    return s.select("station", "t", *[(F.col(c) / 1000).alias(c) for c in DATA], *[(sd[c] / 1000).alias(f"s_{c}") for c in DATA], *[(F.col(f"{a}_{b}_cov") / sd[a] / sd[b]).alias(f"r_{a}_{b}") for a, b in pairs])


_SURE = " from ship where east_var > 0 and north_var > 0 and up_var > 0"
_ALL = ", ".join(q6(c, c) for c in (*DATA, *VARS, *COVS))


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("station", "t", *[r6(c) for c in (*DATA, *VARS, *more)])


@query(with_views("ship", f"select station, t, {_ALL}" + _SURE))
def reader_tseries(spark, d):
    s = _sure(spark, d)
    date = [F.date_format("t", f) for f in ("yyyy", "MM", "dd", "HH", "mm", "ss")]
    value = _words(F.lit(2000.0), *map(F.col, DATA), *[F.col(f"s_{c}") for c in DATA], F.col("r_east_north"), F.col("r_east_up"), F.col("r_north_up"), F.lit(0), *date)
    at = _text(s.select(F.col("station").alias("name"), value.alias("value"), F.col("t").alias("_k")), "tseries", "name")
    # a file a station, named after it
    names = [r[0] for r in s.select("station").distinct().collect()]
    _rename(spark, at, names, "tseries")
    return _rounded(formats.read_tseries(spark, at), *COVS)


def _rename(spark: SparkSession, folder: str, names: list[str], ending: str) -> None:
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n in names:
        for k, f in enumerate(fs.globStatus(path(f"{folder}/name={n}/part-*"))):
            fs.rename(f.getPath(), path(f"{folder}/{n}.{k}.{ending}"))
        fs.delete(path(f"{folder}/name={n}"), True)


def _tenv3(spark, d) -> tuple[DataFrame, DataFrame]:
    s = _sure(spark, d)
    big = {c: F.col(c) * 1000 for c in DATA}  # whole metres, so that the integer part counts
    whole = [F.floor(v) for v in big.values()]
    frac = [v - w for v, w in zip(big.values(), whole)]
    e, n, u = zip(whole, frac)
    reflon = F.when(F.year("t") % 2 == 0, 10.5).otherwise(-20.25)
    day = F.datediff(F.col("t").cast("date"), F.lit("1858-11-17").cast("date"))
    row = _words(F.col("station"), day, reflon, *e, *n, *u, *[F.col(f"s_{c}") for c in DATA], F.col("r_east_north"), F.col("r_east_up"), F.col("r_north_up"))
    head = "site __MJD reflon _e0(m) __east(m) ____n0(m) _north(m) u0(m) ____up(m) sig_e(m) sig_n(m) sig_u(m) __corr_en __corr_eu __corr_nu"
    lines = s.select(row.alias("value"), "station", "t").unionByName(spark.createDataFrame([(head, "", None)], "value string, station string, t timestamp_ntz"))
    return formats.read_tenv3(spark, _text(lines.coalesce(1).sortWithinPartitions("station", F.col("t").asc_nulls_first()).select("value"), "tenv3"))


@query(with_views("ship", f"|, s as (select * {_SURE}), b as (select station, arg_min(east, t) as be, arg_min(north, t) as bn, arg_min(up, t) as bu from s group by station) select station, t, {q6('(east - floor(be)) * 1000', 'east', 4)}, {q6('(north - floor(bn)) * 1000', 'north', 4)}, {q6('(up - floor(bu)) * 1000', 'up', 4)}, {', '.join(q6(c, c) for c in VARS)} from s join b using (station)"))
def reader_tenv3(spark, d):
    return _tenv3(spark, d)[0].select("station", "t", *[r6(c, digits=4) for c in DATA], *[r6(c) for c in VARS])


@query(with_views("ship", f"|, s as (select station, t, year(t) % 2 as odd {_SURE}) select station, t as time from s qualify odd <> lag(odd) over (partition by station order by t)"))
def tenv3_reference_changes(spark, d):
    return _tenv3(spark, d)[1]


@query(with_views("ship", f"select station, t, {', '.join(q6(c, c) for c in (*DATA, *VARS))}" + _SURE))
def reader_kenv(spark, d):
    s = _sure(spark, d)
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'2000-01-01 12:00:00', t)")
    head = "site sec-J2000 __east(m) _north(m) ____up(m) sig_e(m) sig_n(m) sig_v(m)"
    rows = s.select(_words(F.col("station"), sec, *map(F.col, DATA), *[F.col(f"s_{c}") for c in DATA]).alias("value"), F.lit(1).alias("k"))
    lines = rows.unionByName(spark.createDataFrame([(head, 0)], "value string, k int")).coalesce(1).sortWithinPartitions("k").select("value")
    return _rounded(formats.read_kenv(spark, _text(lines, "kenv", compression="gzip")))


@query("select station, timestamp '2000-01-02' as t, 0.0 as east, 0.0 as north, 500.0 as up from stations where lat is not null and lon is not null union all select station, timestamp '2000-01-01', 0.0, 0.0, 0.0 from stations where lat is not null and lon is not null")
def reader_pos(spark, d):
    st = table(spark, d, "stations").dropna(subset=["lat", "lon"]).select("station", "lat", "lon", F.coalesce("alt", F.lit(0.0)).alias("alt"))
    x = lambda up: F.concat_ws(" ", *[F.round(c, 4).cast("decimal(20,4)").cast("string") for c in ecef(F.col("lat"), F.col("lon"), F.col("alt") + up)])
    texts = ["+SITE/INF", F.concat(F.lit(" RINEX "), F.col("station")), "-SITE/INF", "+DATA", "* year month day", F.concat(F.lit(" 2000 01 01 00:00:00 "), x(0.0)), F.concat(F.lit(" 2000 01 02 00:00:00 "), x(0.5)), "-DATA"]
    lines = st.select(F.col("station").alias("name"), F.posexplode(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])).alias("_k", "value"))
    got = formats.read_pos(spark, _text(lines, "pos", "name"))
    return got.select("station", "t", *[(F.round(c, 0) + 0.0).alias(c) for c in DATA])


_MAINT = "from catalog_maint where station is not null and maint_time is not null and maint_type is not null and maint_type <> ''"


def _maint(spark, d):
    return table(spark, d, "catalog_maint").filter("station is not null and maint_time is not null and maint_type is not null and maint_type <> ''")


@query(f"select station, date_trunc('day', maint_time)::timestamp as time, replace(maint_type, ' ', '_') as type {_MAINT} and code = 1")
def reader_step_file(spark, d):
    lines = _maint(spark, d).select(_words(F.col("station"), F.date_format("maint_time", "yyMMMdd"), F.col("code"), F.replace("maint_type", F.lit(" "), F.lit("_"))).alias("value"))
    return formats.read_step_file(spark, _text(lines, "steps"))[0]


@query(f"select station, maint_time as time, maint_type as code {_MAINT} and (contains(maint_type, 'ant') or contains(maint_type, 'firm')) and maint_type <> 'firmware'")
def reader_maintenance(spark, d):
    at = scratch_path(spark, "maintenance")
    _maint(spark, d).select(F.col("maint_type").alias("what"), "station", F.date_format("maint_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("when")).write.option("header", "true").csv(at)
    return formats.read_maintenance(spark, at, 1, [2], 0, include=["ant", "firm"], exclude=["firmware"])


@query("select origin_time as time, cast(eq_id as varchar) as eq_id from catalog_eq where origin_time is not null and eq_id is not null")
def reader_catalog(spark, d):
    at = scratch_path(spark, "catalog")
    e = table(spark, d, "catalog_eq").filter("origin_time is not null and eq_id is not null")
    e.select(F.date_format("origin_time", "yyyy-MM-dd").alias("Date"), F.date_format("origin_time", "HH:mm:ss.SSSSSS").alias("Origin_Time"), "eq_id").write.option("header", "true").csv(at)
    return formats.read_catalog_csv(spark, at)


_HOLD = "select station, lat, lon, alt, cast(min(t) as date) as t_begin, cast(max(t) as date) as t_end, cast(count(*) as integer) as n_solutions from stations join obs using (station) where lat is not null and lon is not null and alt is not null group by all"


def _holdings(spark, d) -> DataFrame:
    o = table(spark, d, "obs").groupBy("station").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    s = table(spark, d, "stations").dropna(subset=["lat", "lon", "alt"]).join(o, "station")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = s.select(_words(F.col("station"), F.col("lat"), F.pmod("lon", F.lit(360.0)), F.col("alt"), F.lit(0), F.lit(0), F.lit(0), day("a"), day("b"), day("b"), F.col("n")).alias("value"), F.lit(1).alias("k"))
    head = "Sta Lat(deg) Long(deg) Hgt(m) X(m) Y(m) Z(m) Dtbeg Dtend Dtmod NumSol"
    lines = rows.unionByName(spark.createDataFrame([(head, 0)], "value string, k int")).coalesce(1).sortWithinPartitions("k").select("value")
    return formats.read_holdings(spark, _text(lines, "holdings"))


@query(f"select station, {q6('lat', 'lat')}, {q6('lon', 'lon')}, {q6('alt', 'alt')}, t_begin, t_end, n_solutions from ({_HOLD})")
def reader_holdings(spark, d):
    return _holdings(spark, d).select("station", r6("lat"), r6("lon"), r6("alt"), "t_begin", "t_end", "n_solutions")


@query(f"select station, n_solutions from ({_HOLD}) where (lon >= 100 or lon <= 20) and lat between -60 and 60 and n_solutions >= 250 and t_end >= date '2010-01-01'")
def holdings_selection(spark, d):
    return formats.select_holdings(_holdings(spark, d), box=(100, 20, -60, 60), min_solutions=250, t_min="2010-01-01").select("station", "n_solutions")


# --- raw files ---

_RAW = """select 'N' || lpad(cast(n_nationkey as varchar), 3, '0') as station, n_nationkey as k, cast(2000 + n_nationkey % 3 as integer) as year, cast(10 + n_nationkey * 13 as integer) as day,
 -60.0 + 5.0 * n_nationkey as lat, -170.0 + 14.0 * n_nationkey as lon from nation"""


def _raw_files(spark, d) -> tuple[str, DataFrame]:
    """Small raw files under year and day, every other one compressed."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("s"), F.col("n_nationkey").alias("k"), (2000 + F.col("n_nationkey") % 3).alias("year"), (10 + F.col("n_nationkey") * 13).alias("day"))
    x = ecef(-60.0 + 5.0 * F.col("k"), -170.0 + 14.0 * F.col("k"), F.lit(100.0))
    at = scratch_path(spark, "raw")
    for r in n.select("s", "k", "year", "day", *[F.round(c, 4).alias(a) for c, a in zip(x, "xyz")]).collect():  # the nations
        head = f"{r['x']:14.4f}{r['y']:14.4f}{r['z']:14.4f}"
        text = f"{'OBSERVATION DATA':<60}RINEX VERSION / TYPE\n{head:<60}APPROX POSITION XYZ\n{'':<60}END OF HEADER\n"
        name = f"{at}/{r['year']}/{r['day']:03}/{r['s']}{r['day']:03}0.{r['year'] % 100:02}o"
        shared_text(spark, name + (".gz" if r["k"] % 2 else ""), text)
    shared_text(spark, f"{at}/2000/notes.txt", "no raw file")
    return at, formats.raw_inventory(formats.list_files(spark, at), "net")


@query(f"select station, year, day, cast(make_date(year, 1, 1) + (day - 1) * interval 1 day as date) as date, case when k % 2 = 1 then 'gz' else '' end as compression, 'o' as type, 'net' as network from ({_RAW})")
def raw_inventory(spark, d):
    return _raw_files(spark, d)[1].select("station", "year", "day", "date", "compression", "type", "network")


@query(f"select station, day from ({_RAW}) where year = 2001 and cast(make_date(year, 1, 1) + (day - 1) * interval 1 day as date) between date '2001-02-01' and date '2001-08-31'")
def raw_selection(spark, d):
    return formats.select_files(_raw_files(spark, d)[1], years=[2001], networks=["net"], between=("2001-02-01", "2001-08-31")).select("station", "day")


@query(f"select count(*) as num_files, count(distinct station) as num_stations, min(date) as first_date, max(date) as last_date from (select station, cast(make_date(year, 1, 1) + (day - 1) * interval 1 day as date) as date from ({_RAW}))")
def raw_summary(spark, d):
    return formats.holding_summary(_raw_files(spark, d)[1]).select("num_files", "num_stations", "first_date", "last_date")


@query(f"select station, {q6('lat', 'lat', 4)}, {q6('lon', 'lon', 4)}, 100.0 as alt from ({_RAW})")
def raw_header_locations(spark, d):
    at, inv = _raw_files(spark, d)
    got = formats.header_locations(formats.read_headers(spark, at), inv)
    return got.select("station", r6("lat", digits=4), r6("lon", digits=4), (F.round("alt", 2) + 0.0).alias("alt"))


# --- network file and sinks ---


@query("select station, lat, lon, coalesce(alt, 0.0) as alt, cast(3 as bigint) as models from stations where lat is not null and lon is not null")
def network_json(spark, d):
    """The network's own description, which its program holds whole: every station, its series and its models."""
    rows = table(spark, d, "stations").dropna(subset=["lat", "lon"]).select("station", "lat", "lon", F.coalesce("alt", F.lit(0.0)).alias("alt")).collect()
    default = [ModelSpec("Linear", "Polynomial", {"order": 1}), ModelSpec("Annual", "Sinusoid", {"period": 365.25})]
    own = {"d": [ModelSpec("Jump", "Step", {"steptimes": ["2001-05-01"]})]}
    text = netjson.dump("net", {r["station"]: [r["lat"], r["lon"], r["alt"]] for r in rows}, {"d": default}, {r["station"]: own for r in rows}, {r["station"]: {"d": {"type": "tenv3", "kw_args": {}}} for r in rows})
    at = scratch_path(spark, "network")
    shared_text(spark, f"{at}/net.json", text)
    net = netjson.load(spark.read.text(at, wholetext=True).first()[0])
    out = [(s, *map(float, v["location"]), len(v["models"]["d"])) for s, v in net["stations"].items()]
    assert json.loads(text)["name"] == net["name"]
    return spark.createDataFrame(out, "station string, lat double, lon double, alt double, models bigint")


@query(with_views("ship", f"select station, t, {q6('east', 'east')} from ship"))
def sink_series(spark, d):
    at = scratch_path(spark, "series")
    sinks.write_series(V.ship(spark, d), at, 8)
    return spark.read.parquet(at).select("station", "t", r6("east"))


@query(with_views("ship", f"select station, t, {q6('east', 'east')} from ship"))
def sink_csv(spark, d):
    at = scratch_path(spark, "csv")
    sinks.write_csv(V.ship(spark, d).select("station", "t", "east"), at)
    return spark.read.csv(at, header=True, schema="station string, t timestamp_ntz, east double").select("station", "t", r6("east"))


# --- streams ---


def _stream(spark, d, rows: DataFrame, build) -> DataFrame:
    """Write `rows`, read them back as a stream until they are used up, and give what the stream's query ends with."""
    at, name = scratch_path(spark, "stream"), f"stream_{uuid.uuid4().hex}"
    rows.repartition(4).write.parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(at)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query(with_views("nat", f"select station, date_trunc('day', t)::timestamp as start_t, count(total) as n, {q6('avg(total)', 'mean')} from nat group by 1, 2"))
def stream_windows(spark, d):
    rows = V.nat(spark, d).select("station", F.col("t").cast("timestamp").alias("t"), "total")
    return _stream(spark, d, rows, lambda s: quality.windowed_stats(s, "total")).select("station", F.col("start_t").cast("timestamp_ntz").alias("start_t"), "n", r6("mean"))


@query(with_views("nat", f"|, x as (select station, total, date_diff('second', timestamp '2000-01-01', t) / 86400.0 as d from nat) select station, count(total) as n, {q6('regr_slope(total, d)', 'slope')}, {q6('regr_intercept(total, d)', 'intercept', 4)} from x group by station"))
def stream_lines(spark, d):
    rows = V.nat(spark, d).select("station", F.col("t").cast("timestamp").alias("t"), "total")
    return quality.line_of(_stream(spark, d, rows, lambda s: quality.line_sums(s, "total"))).select("station", "n", r6("slope"), r6("intercept", digits=4))


