import datetime as dt
import gzip
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.geodesy import ecef
from tidemark.operators import availability, cleaning, events, network, series, steps, trends
from tidemark.sources import formats, sinks
from tidemark.streaming import quality


def test_tseries(spark, tmp_path):
    line = "2000.0 0.001 0.002 -0.003 0.001 0.002 0.003 0.5 0.1 -0.2 0 2000 1 {} 12 0 0"
    (tmp_path / "ABCD.tseries").write_text("\n".join(line.format(d) for d in (1, 3, 2, 3)) + "\n\n")
    got = formats.read_tseries(spark, str(tmp_path / "ABCD.tseries")).orderBy("t").collect()
    assert [(r["station"], r["t"].day, r["east"]) for r in got] == [("ABCD", 1, 1.0), ("ABCD", 2, 1.0)]
    assert got[0]["up_var"] == pytest.approx(9.0) and got[0]["east_north_cov"] == pytest.approx(1.0)
    assert formats.read_tseries(spark, str(tmp_path / "ABCD.tseries"), "m", "first").count() == 3
    with pytest.raises(ValueError):
        formats.read_tseries(spark, "x", "km")


def test_tenv3(spark, tmp_path):
    head = "site YYMMMDD yyyy.yyyy __MJD week d reflon _e0(m) __east(m) ____n0(m) _north(m) u0(m) ____up(m) _ant(m) sig_e(m) sig_n(m) sig_u(m) __corr_en __corr_eu __corr_nu"
    row = "ABCD 00JAN01 2000.0 {mjd} 1 1 {lon} {e0} 0.25 7 0.5 100 0.75 0 0.001 0.002 0.003 0.5 0 0"
    (tmp_path / "a.tenv3").write_text("\n".join([head, row.format(mjd=51544, lon=10, e0=3), row.format(mjd=51545, lon=10, e0=4), row.format(mjd=51545, lon=10, e0=9), row.format(mjd=51546, lon=11, e0=3)]))
    obs, st = formats.read_tenv3(spark, str(tmp_path / "a.tenv3"))
    got = obs.orderBy("t").collect()
    assert [(r["t"], r["east"]) for r in got] == [(dt.datetime(2000, 1, 1), 250.0), (dt.datetime(2000, 1, 2), 1250.0), (dt.datetime(2000, 1, 3), 250.0)]
    assert got[0]["north_var"] == pytest.approx(4.0)
    assert [tuple(r) for r in st.collect()] == [("ABCD", dt.datetime(2000, 1, 3))]


def test_kenv(spark, tmp_path):
    text = "site sec-J2000 yyyy mm __east(m) _north(m) ____up(m) sig_e(m) sig_n(m) sig_v(m)\n" + "\n".join(f"ABCD {s} 2000 1 0.001 0.002 0.003 0.001 0.001 0.002" for s in (0, 300, 300, 600))
    (tmp_path / "k.kenv").write_text(text)
    with gzip.open(tmp_path / "k.kenv.gz", "wt") as f:
        f.write(text)
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "2000.zip", "w") as z:
        z.writestr("d1.kenv.gz", gzip.compress(text.encode()))
        z.writestr("empty.kenv", "")
    for df in (formats.read_kenv(spark, str(tmp_path / "k.kenv")), formats.read_kenv(spark, str(tmp_path / "k.kenv.gz")), formats.read_kenv_zip(spark, str(tmp_path / "z"))):
        got = df.orderBy("t").collect()
        assert [r["t"] for r in got] == [dt.datetime(2000, 1, 1, 12) + dt.timedelta(minutes=5 * k) for k in range(3)] and got[0]["up_var"] == pytest.approx(4.0)


def test_pos(spark, tmp_path):
    x = spark.range(1).select(*[c.alias(n) for n, c in zip("xyz", ecef(F.lit(35.0), F.lit(139.0), F.lit(10.0)))]).first()
    rows = "\n".join(f" 2000 01 0{d} 12:00:00 {x['x']:.4f} {x['y']:.4f} {x['z'] + 0.01 * (d - 1):.4f} 0 0 0" for d in (1, 2))
    (tmp_path / "a.pos").write_text(f"+SITE/INF\n ID 950001\n RINEX AB12\n-SITE/INF\n+SOLVER/INF\n X\n-SOLVER/INF\n+DATA\n* comment\n{rows}\n-DATA\n")
    got = formats.read_pos(spark, str(tmp_path / "a.pos")).orderBy("t").collect()
    assert got[0]["station"] == "AB12" and got[0]["east"] == 0 and got[1]["north"] == pytest.approx(10 * 0.8192, abs=0.1) and got[1]["up"] == pytest.approx(10 * 0.5736, abs=0.1)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "steps.txt").write_text("ABCD 05MAR02 1 Antenna_Change\nABCD 99DEC31 2 100.5 80 6.1 us123\nEFGH 05XXX02 1 Bad\n")
    maint, eq = formats.read_step_file(spark, str(tmp_path / "steps.txt"), ["ABCD"])
    assert [tuple(r) for r in maint.collect()] == [("ABCD", dt.datetime(2005, 3, 2), "Antenna_Change")]
    assert [tuple(r) for r in eq.collect()] == [("ABCD", dt.datetime(1999, 12, 31), 100.5, 80.0, 6.1, "us123")]
    (tmp_path / "m.csv").write_text("site,year,code\nA 1,2005-03-02,antenna new\nB 2,2006-01-01,visit\nC 3,2006-01-01,antenna\n")
    got = formats.read_maintenance(spark, str(tmp_path / "m.csv"), 0, [1], 2, include=["antenna"], exclude=["antenna"], formatter=lambda c: F.replace(c, F.lit(" "), F.lit("")))
    assert [(r["station"], r["time"]) for r in got.collect()] == [("A1", dt.datetime(2005, 3, 2))]
    with pytest.raises(ValueError):
        formats.read_maintenance(spark, str(tmp_path / "m.csv"), 0, [1], formatter=lambda c: F.lit("same"))
    (tmp_path / "eq.csv").write_text("Date,Origin_Time(JST),Latitude(°)\n2001-02-03,04:05:06.5,35.1\n")
    assert formats.read_catalog_csv(spark, str(tmp_path / "eq.csv")).first()["time"] == dt.datetime(2001, 2, 3, 4, 5, 6, 500000)
    (tmp_path / "h.txt").write_text("Sta Lat(deg) Long(deg) Hgt(m) X(m) Y(m) Z(m) Dtbeg Dtend Dtmod NumSol\nABCD 10 350 5 0 0 0 2000-01-01 2005-01-01 2006-01-01 900\nEFGH 50 20 5 0 0 0 2000-01-01 2001-01-01 2006-01-01 90\n")
    h = formats.read_holdings(spark, str(tmp_path / "h.txt"))
    pick = lambda **kw: {r["station"] for r in formats.select_holdings(h, **kw).collect()}
    assert pick(box=(-20, 10, 0, 20)) == {"ABCD"} and pick(box=(340, 30, 0, 60)) == {"ABCD", "EFGH"} and pick(circle=(20, 50, 10)) == {"EFGH"}
    assert pick(min_solutions=100) == {"ABCD"} and pick(t_min="2003-01-01") == {"ABCD"} and pick(names=["EFGH"], t_max="1999-01-01") == set()


def test_raw_files(spark, tmp_path):
    at = tmp_path / "2001" / "032"
    at.mkdir(parents=True)
    head = f"{'  -3957199.2400  3310205.3900  3737911.7000':<60}APPROX POSITION XYZ\n{'':<60}END OF HEADER\nrest"
    (at / "abcd0320.01o").write_text(head)
    with gzip.open(at / "efgh0320.01d.gz", "wt") as f:
        f.write(head)
    (at / "abcd0330.01o").write_text("wrong day")
    (at / "notes.txt").write_text("x")
    inv = formats.raw_inventory(formats.list_files(spark, str(tmp_path)), "net")
    got = {r["station"]: r for r in inv.collect()}
    assert set(got) == {"ABCD", "EFGH"} and got["ABCD"]["date"] == dt.date(2001, 2, 1) and got["EFGH"]["compression"] == "gz"
    for keep in ("first", "last", "mean"):
        loc = formats.header_locations(formats.read_headers(spark, str(at)), inv, keep)
        assert loc.count() == 2 and loc.first()["lat"] == pytest.approx(36.1, abs=0.1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.datetime(2000, 1, 1), 1.0)], "station string, t timestamp_ntz, x double")
    sinks.write_series(df, str(tmp_path / "p"), 4)
    assert spark.read.parquet(str(tmp_path / "p")).select("x").first()[0] == 1.0
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_streams(spark, tmp_path):
    rows = [("A", dt.datetime(2000, 1, 1) + dt.timedelta(hours=6 * k), float(k) if k != 5 else float("nan")) for k in range(40)]
    df = spark.createDataFrame(rows, "station string, t timestamp, x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("stats", quality.windowed_stats(s, "x")), ("sums", quality.line_sums(s, "x"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("stats").agg(F.sum("n")).first()[0] == 39
    assert quality.line_of(spark.table("sums")).first()["slope"] == pytest.approx(4.0)


def test_blocks_give_the_same_results(spark, monkeypatch):
    """Window operators over many small blocks and over whole series agree."""
    import numpy as np

    from tidemark.operators import blocks
    from tidemark.operators import series as series_mod

    rng = np.random.default_rng(0)
    n = 3000
    t = pd.date_range("2000-01-01", periods=n, freq="h") + pd.to_timedelta(rng.integers(0, 600, n), "s")
    keep = np.r_[np.arange(0, 900), np.arange(960, n)]
    x = np.where(rng.random(n) < 0.05, np.nan, rng.normal(size=n) + 5 * (np.arange(n) > 1700))
    df = spark.createDataFrame(pd.DataFrame({"station": "A", "t": t, "x": x}).iloc[keep]).withColumn("t", F.col("t").cast("timestamp_ntz")).withColumn("x", F.nanvl("x", F.lit(None)))
    ev = spark.createDataFrame([("A", t[k].to_pydatetime() + dt.timedelta(seconds=1)) for k in range(0, n, 50)], "station string, time timestamp_ntz")

    def everything():
        out = {
            "median": cleaning.rolling_median(df, ["x"], 7), "fixed": cleaning.rolling_median(df, ["x"], 7, shrink=False), "roll": cleaning.max_rolling_deviation(df, "x", 11),
            "gaps": availability.availability_intervals(df, 0.2), "next": events.next_epoch(ev, df), "steps": steps.step_peaks(steps.step_scores(df, "x", 21), 5.0),
        }
        return {k: sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in d.select(*sorted(d.columns)).collect()) if k != "median" and k != "fixed" else sorted((r["t"], None if r["x"] is None else round(r["x"], 9)) for r in d.collect()) for k, d in out.items()}

    whole = everything()
    small = lambda *a, **k: blocks.ordered_blocks(*a, **(k | {"block_rows": 700}))
    monkeypatch.setattr(series_mod, "ordered_blocks", small)
    cut = everything()
    for k in whole:
        assert whole[k] == cut[k], k
    assert len(whole["gaps"]) == 2


def test_missing_and_empty(spark):
    df = spark.createDataFrame([("A", dt.datetime(2000, 1, 1), None), (None, dt.datetime(2000, 1, 1), 1.0), ("B", None, 1.0)], "station string, t timestamp_ntz, x double")
    for d in (df, df.limit(0)):
        cleaning.rolling_median(d, ["x"], 3).collect()
        cleaning.residual_stats(d, "x").collect()
        cleaning.clean(d, d, ["x"], std_outlier=3.0).collect()
        availability.reliability(d).collect()
        trends.trend(d, "x").collect()
        steps.step_scores(d, "x", 5).collect()
        network.weighted_median(d, ["station"], "x", "x").collect()
        series.remove_initial_offset(d, ["x"]).collect()
