"""Readers of station time-series files. Text is split into lines by Spark, so files are read in parallel; the station
is a field of the file or its name up to the first point."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geodesy import enu, lla
from tidemark.operators.series import dedup

DATA, VARS = ["east", "north", "up"], ["east_var", "north_var", "up_var"]
COVS = ["east_north_cov", "east_up_cov", "north_up_cov"]
#: What a table of station files calls its columns, and months in step files.
TENV3 = ["site", "__MJD", "reflon", "_e0(m)", "__east(m)", "____n0(m)", "_north(m)", "u0(m)", "____up(m)", "sig_e(m)", "sig_n(m)", "sig_u(m)", "__corr_en", "__corr_eu", "__corr_nu"]
KENV = ["site", "sec-J2000", "__east(m)", "_north(m)", "____up(m)", "sig_e(m)", "sig_n(m)", "sig_v(m)"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def _factor(unit: str) -> float:
    if unit not in ("mm", "m"):
        raise ValueError(f"unit must be 'mm' or 'm', not {unit!r}")
    return 1000.0 if unit == "mm" else 1.0


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, line number order (_n, increasing within a file) and the blank-separated fields of every non-empty line."""
    t = spark.read.text(path if isinstance(path, str) else list(path))
    t = t.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_n"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    return t.filter("line <> ''").withColumn("f", F.split("line", " "))


def _stem() -> Column:
    return F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)


def _num(i: int) -> Column:
    return F.try_element_at("f", F.lit(i + 1)).try_cast("double")


def read_tseries(spark: SparkSession, path: str | Sequence[str], unit: str = "mm", keep: str = "none") -> DataFrame:
    """Headerless files of decimal year, three components, three deviations, three correlations (metres), seconds and
    the date in six columns. `keep` is 'none' (of repeated epochs), 'first' or 'last'."""
    k = _factor(unit)
    d = _lines(spark, path)
    sig = {c: _num(4 + i) for i, c in enumerate(DATA)}
    pair = [("east", "north"), ("east", "up"), ("north", "up")]
    date = [_num(11 + i).cast("int") for i in range(5)]
    out = d.select(
        _stem().alias("station"),
        F.make_timestamp_ntz(*date, _num(16)).alias("t"),
        *[(_num(1 + i) * k).alias(c) for i, c in enumerate(DATA)],
        *[(sig[c] * sig[c] * k * k).alias(f"{c}_var") for c in DATA],
        *[(_num(7 + i) * sig[a] * sig[b] * k * k).alias(f"{a}_{b}_cov") for i, (a, b) in enumerate(pair)],
        "_n",
    )
    return dedup(out.filter("t is not null"), keep, "_n").drop("_n")


def _named(d: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fields by the names in each file's header line, which is the line that begins with the first name."""
    head = d.filter(F.col("f")[0] == names[0]).groupBy("file").agg(F.min_by("f", "_n").alias("h"))  # a row for each file
    at = lambda n: F.try_element_at("f", F.nullif(F.array_position("h", n), F.lit(0)).cast("int"))
    return d.join(head, "file").filter(F.col("f")[0] != names[0]).select("file", "_n", *[at(n).alias(n) for n in names])


def _value(name: str) -> Column:
    return F.col(f"`{name}`").try_cast("double")


def read_tenv3(spark: SparkSession, path: str | Sequence[str], unit: str = "mm") -> tuple[DataFrame, DataFrame]:
    """(observations, steps). Values are the fraction plus the integer metres relative to those of the station's first
    line; of repeated days the first counts. steps: station, time where the reference longitude changes."""
    k = _factor(unit)
    d = _named(_lines(spark, path), TENV3)
    ints = dict(zip(DATA, ("_e0(m)", "____n0(m)", "u0(m)")))
    fracs = dict(zip(DATA, ("__east(m)", "_north(m)", "____up(m)")))
    sig = dict(zip(DATA, ("sig_e(m)", "sig_n(m)", "sig_u(m)")))
    d = d.withColumn("station", F.col("site")).withColumn("t", F.expr("timestamp_ntz'1858-11-17 00:00:00' + make_dt_interval(0, 0, 0, cast(try_cast(`__MJD` as double) * 86400 as decimal(18, 6)))"))
    base = d.groupBy("station").agg(*[F.min_by(_value(n), "_n").alias(f"_b_{c}") for c, n in ints.items()])
    d = d.join(base, "station")
    cols = [((_value(fracs[c]) + _value(ints[c]) - F.col(f"_b_{c}")) * k).alias(c) for c in DATA]
    cols += [(_value(sig[c]) * _value(sig[c]) * k * k).alias(f"{c}_var") for c in DATA]
    for (a, b), n in zip((("east", "north"), ("east", "up"), ("north", "up")), ("__corr_en", "__corr_eu", "__corr_nu")):
        cols.append((_value(n) * _value(sig[a]) * _value(sig[b]) * k * k).alias(f"{a}_{b}_cov"))
    obs = dedup(d.filter("t is not null").select("station", "t", *cols, _value("reflon").alias("reflon"), "_n"), "first", "_n")
    # a change of reference longitude begins where a longitude's run does; there are few distinct ones
    from tidemark.operators.series import in_blocks, only_core

    blocks, w = in_blocks(obs.select("station", "t", "reflon"))
    steps = only_core(blocks.withColumn("_c", F.abs(F.col("reflon") - F.lag("reflon").over(w)) > 0)).filter("_c").select("station", F.col("t").alias("time"))
    return obs.drop("reflon", "_n"), steps


def read_kenv(spark: SparkSession, path: str | Sequence[str], unit: str = "mm") -> DataFrame:
    """High-rate files, plain or gzip: seconds since 2000-01-01 12:00, components and deviations; no covariances. Of
    repeated epochs the first counts. For zip archives see read_kenv_zip."""
    return _kenv(_named(_lines(spark, path), KENV), unit)


def _kenv(d: DataFrame, unit: str) -> DataFrame:
    k = _factor(unit)
    t = F.expr("timestamp_ntz'2000-01-01 12:00:00' + make_dt_interval(0, 0, 0, cast(try_cast(`sec-J2000` as double) as decimal(18, 6)))")
    sig = dict(zip(DATA, KENV[5:]))
    cols = [(_value(n) * k).alias(c) for c, n in zip(DATA, KENV[2:5])] + [(_value(sig[c]) * _value(sig[c]) * k * k).alias(f"{c}_var") for c in DATA]
    return dedup(d.select(F.col("site").alias("station"), t.alias("t"), *cols, "_n").filter("t is not null"), "first", "_n").drop("_n")


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip
    import io
    import zipfile

    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    data = z.read(name)
                    text = (gzip.decompress(data) if name.endswith(".gz") else data).decode("ascii", "replace")
                    rows = [" ".join(x.split()) for x in text.splitlines()]
                    rows = [x for x in rows if x]
                    if rows:
                        yield pd.DataFrame({"file": f"{path}#{name}", "_n": range(len(rows)), "line": rows})


def read_kenv_zip(spark: SparkSession, path: str | Sequence[str], unit: str = "mm") -> DataFrame:
    """Zip archives (a file, a list or a folder of them) of plain or gzip members in the layout of read_kenv."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path if isinstance(path, str) else list(path))
    d = raw.select("path", "content").mapInPandas(_members, "file string, _n bigint, line string").withColumn("f", F.split("line", " "))
    return _kenv(_named(d, KENV), unit)


def read_pos(spark: SparkSession, path: str | Sequence[str], unit: str = "mm") -> DataFrame:
    """Sectioned coordinate files: the RINEX name in +SITE/INF, and in +DATA date, time and XYZ. Coordinates become
    east, north, up relative to the station's first epoch; no uncertainties."""
    k = _factor(unit)
    d = _lines(spark, path)
    site = d.filter(F.upper(F.col("f")[0]).isin("RINEX", "*RINEX")).groupBy("file").agg(F.min_by(F.element_at("f", -1), "_n").alias("station"))
    row = F.col("line").rlike(r"^[0-9]{4} [0-9]{1,2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} ")
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", F.col("f")[0], F.lpad(F.col("f")[1], 2, "0"), F.lpad(F.col("f")[2], 2, "0")), F.col("f")[3])).cast("timestamp_ntz")
    xyz = d.filter(row).join(site, "file").select("station", stamp.alias("t"), _num(4).alias("x"), _num(5).alias("y"), _num(6).alias("z"), "_n").filter("t is not null")
    xyz = dedup(xyz, "first", "_n")
    first = xyz.groupBy("station").agg(F.min_by(F.struct("x", "y", "z"), "t").alias("o"))
    lat, lon, _ = lla(F.col("o.x"), F.col("o.y"), F.col("o.z"))
    j = xyz.join(first, "station").withColumn("lat", lat).withColumn("lon", lon)
    e = enu(F.col("x") - F.col("o.x"), F.col("y") - F.col("o.y"), F.col("z") - F.col("o.z"), F.col("lat"), F.col("lon"))
    return j.select("station", "t", *[(c * k).alias(n) for c, n in zip(e, DATA)])


def read_step_file(spark: SparkSession, path: str, only_stations: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(maintenance: station, time, type; earthquakes: station, time, threshold, distance, magnitude, usgsid) from lines
    of station, yyMMMdd, code and what the code asks for. Years from 69 on are of the last century."""
    d = _lines(spark, path)
    day = F.col("f")[1]
    yy = F.substring(day, 1, 2).try_cast("int")
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.substring(day, 3, 3))), F.lit(0))
    d = d.withColumn("time", F.make_timestamp_ntz(F.when(yy >= 69, yy + 1900).otherwise(yy + 2000), month.cast("int"), F.substring(day, 6, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    d = d.select(F.col("f")[0].alias("station"), "time", F.col("f")[2].alias("code"), "f")
    if only_stations is not None:
        d = d.filter(F.col("station").isin(list(only_stations)))
    at = lambda i: F.try_element_at("f", F.lit(i))
    maint = d.filter("code = '1'").select("station", "time", at(4).alias("type"))
    eq = d.filter("code = '2'").select("station", "time", at(4).try_cast("double").alias("threshold"), at(5).try_cast("double").alias("distance"), at(6).try_cast("double").alias("magnitude"), at(7).alias("usgsid"))
    return maint, eq


def read_maintenance(spark: SparkSession, path: str, site: int, date: Sequence[int], code: int | None = None, delimiter: str = ",", exclude: Sequence[str] = (), include: Sequence[str] = (), formatter=None) -> DataFrame:
    """station, time, code from a delimited table by column positions. Rows whose code equals an `exclude` or holds none
    of the `include` texts are left out. `formatter` maps the site column; it must keep sites apart."""
    d = spark.read.csv(path, sep=delimiter, header=True)
    c = [F.col(f"`{n}`") for n in d.columns]
    name = formatter(c[site]) if formatter else c[site]
    stamp = F.try_to_timestamp(F.concat_ws(" ", *[c[i] for i in date])).cast("timestamp_ntz")
    out = d.select(c[site].alias("_raw"), name.alias("station"), stamp.alias("time"), (c[code] if code is not None else F.lit(None).cast("string")).alias("code"))
    if code is not None:
        if exclude:
            out = out.filter(F.col("code").isNull() | ~F.col("code").isin(list(exclude)))
        if include:
            hit = F.lit(False)
            for x in include:
                hit |= F.col("code").contains(x)
            out = out.filter(hit)
    if formatter:
        n = out.agg(F.countDistinct("_raw").alias("a"), F.countDistinct("station").alias("b")).first()
        if n["a"] != n["b"]:
            raise ValueError(f"formatter maps {n['a']} sites to {n['b']}")
    return out.drop("_raw")


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Earthquake catalog with the date and the time in its first two columns, which become `time`; other columns stay
    as text under their names."""
    d = spark.read.csv(path, header=True)
    a, b, *rest = d.columns
    stamp = F.try_to_timestamp(F.regexp_replace(F.concat_ws(" ", f"`{a}`", f"`{b}`"), ",", " ")).cast("timestamp_ntz")
    return d.select(stamp.alias("time"), *[F.col(f"`{c}`") for c in rest])


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Table of what a provider holds: station, lat, lon (to [-180, 180]), alt, t_begin, t_end, n_solutions."""
    names = ["Sta", "Lat(deg)", "Long(deg)", "Hgt(m)", "Dtbeg", "Dtend", "NumSol"]
    d = _named(_lines(spark, path), names)
    lon = F.pmod(_value("Long(deg)") + 180, F.lit(360.0)) - 180
    return d.select(F.col("Sta").alias("station"), _value("Lat(deg)").alias("lat"), lon.alias("lon"), _value("Hgt(m)").alias("alt"), F.to_date("Dtbeg").alias("t_begin"), F.to_date("Dtend").alias("t_end"), F.col("NumSol").try_cast("int").alias("n_solutions"))


def select_holdings(holdings: DataFrame, names: Sequence[str] | None = None, box: tuple[float, float, float, float] | None = None, circle: tuple[float, float, float] | None = None, min_solutions: int | None = None, t_min: str | None = None, t_max: str | None = None) -> DataFrame:
    """Stations by name, by box (lon from, lon to, lat from, lat to; wraps at 180), by circle (lon, lat, km), by number
    of solutions and by overlap in time."""
    from tidemark.operators.network import haversine_km

    d = holdings
    if names is not None:
        d = d.filter(F.col("station").isin(list(names)))
    if box:
        west, east, south, north = box
        inside = F.pmod(F.col("lon") - west, F.lit(360.0)) <= (east - west) % 360 if east - west < 360 else F.lit(True)
        d = d.filter(inside & F.col("lat").between(south, north))
    if circle:
        d = d.filter(haversine_km(F.col("lat"), F.col("lon"), F.lit(circle[1]), F.lit(circle[0])) <= circle[2])
    if min_solutions is not None:
        d = d.filter(F.col("n_solutions") >= min_solutions)
    if t_min:
        d = d.filter(F.col("t_end") >= F.lit(t_min).cast("date"))
    if t_max:
        d = d.filter(F.col("t_begin") <= F.lit(t_max).cast("date"))
    return d


#: Raw-file names SSSSDDDn.YYt, with a suffix for compression, under YYYY/DDD.
RAW_NAME = r"/([0-9]{4})/([0-9]{3})/([A-Za-z0-9]{4})([0-9]{3})([0-9A-Xa-x])\.([0-9]{2})([a-z])(?:\.([A-Za-z0-9]+))?$"


def raw_inventory(files: DataFrame, network: str = "") -> DataFrame:
    """Inventory of raw files from a listing (path, length, modificationTime; see list_files): station (upper case),
    station_raw, year, day, date, sequence, type, compression, filesize, modified, network, basefolder. Paths of
    another form, or whose name and folders contradict each other, are left out."""
    g = lambda i: F.regexp_extract("path", RAW_NAME, i)
    d = files.filter(F.col("path").rlike(RAW_NAME)).filter((g(2) == g(4)) & (F.substring(g(1), 3, 2) == g(6)))
    year, day = g(1).cast("int"), g(2).cast("int")
    return d.select(
        F.upper(g(3)).alias("station"), g(3).alias("station_raw"), year.alias("year"), day.alias("day"), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1).alias("date"),
        g(5).alias("sequence"), g(7).alias("type"), g(8).alias("compression"), F.col("length").alias("filesize"), F.col("modificationTime").alias("modified"),
        F.lit(network).alias("network"), F.regexp_extract("path", r"^(.*)/[0-9]{4}/[0-9]{3}/[^/]+$", 1).alias("basefolder"),
    ).filter("day between 1 and 366")


def select_files(inventory: DataFrame, stations: Sequence[str] | None = None, networks: Sequence[str] | None = None, years: Sequence[int] | None = None, between: tuple[str, str] | None = None) -> DataFrame:
    """The rows of an inventory (see raw_inventory) of the given stations, networks and years, with dates in between
    (inclusive); what is not given does not restrict."""
    d = inventory
    for column, wanted in (("station", stations), ("network", networks), ("year", years)):
        if wanted is not None:
            d = d.filter(F.col(column).isin(list(wanted)))
    return d if between is None else d.filter(F.col("date").between(F.lit(between[0]).cast("date"), F.lit(between[1]).cast("date")))


def holding_summary(inventory: DataFrame) -> DataFrame:
    """One row: num_files, num_stations, first and last date, bytes."""
    return inventory.agg(F.count("*").alias("num_files"), F.countDistinct("station").alias("num_stations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("filesize").alias("bytes"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def raw_file_name(d: DataFrame) -> Column:
    """The path of an inventory row."""
    tail = F.concat("station_raw", F.lpad(F.col("day").cast("string"), 3, "0"), "sequence", F.lit("."), F.substring(F.col("year").cast("string"), 3, 2), "type")
    tail = F.when(F.col("compression") != "", F.concat_ws(".", tail, "compression")).otherwise(tail)
    return F.concat_ws("/", "basefolder", F.col("year").cast("string"), F.lpad(F.col("day").cast("string"), 3, "0"), tail)


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip

    for pdf in frames:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            data = gzip.decompress(content) if path.endswith(".gz") else content
            for k, line in enumerate(data.decode("ascii", "replace").splitlines()):
                label = line[60:].strip()
                out.append((path, k, label, line[:60].rstrip()))
                if label == "END OF HEADER":
                    break
        yield pd.DataFrame(out, columns=["path", "k", "label", "value"])


def read_headers(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, k, label, value of the header lines (60 columns of value, then the label) of raw files, plain or gzip."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path if isinstance(path, str) else list(path))
    return raw.select("path", "content").mapInPandas(_headers, "path string, k int, label string, value string")


def header_locations(headers: DataFrame, inventory: DataFrame, keep: str = "first") -> DataFrame:
    """station, x, y, z, lat, lon, alt from 'APPROX POSITION XYZ', of the first or last file of a station by date, or
    the mean of all."""
    p = headers.filter("label = 'APPROX POSITION XYZ'").withColumn("v", F.split(F.trim("value"), r"\s+"))
    p = p.select("path", *[F.try_element_at("v", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")]).dropna()
    j = inventory.withColumn("path", raw_file_name(inventory)).join(p, "path")
    if keep == "mean":
        out = j.groupBy("station").agg(*[F.avg(c).alias(c) for c in "xyz"])
    else:
        pick = F.min_by if keep == "first" else F.max_by
        out = j.groupBy("station").agg(pick(F.struct("x", "y", "z"), F.struct("date", "path")).alias("p")).select("station", "p.*")
    lat, lon, alt = lla(F.col("x"), F.col("y"), F.col("z"))
    return out.select("station", "x", "y", "z", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
