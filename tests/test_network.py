import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import availability, custom, dislocation, events, network, quantiles, series, steps, trends
from tidemark.solve import api, models
from tidemark.sources import formats

T0 = dt.datetime(2000, 1, 1)


def frame(spark, x: dict[str, np.ndarray], name="x"):
    rows = [(s, T0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for s, a in x.items() for i, v in enumerate(a)]
    return spark.createDataFrame(rows, f"station string, t timestamp_ntz, {name} double")


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(f"S{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60)))] + [("none", None, 1.0), ("S1", 0.0, 0.0)], "station string, lat double, lon double").dropDuplicates(["station"])


def distances(pdf):
    a, o = np.radians(pdf.lat.to_numpy()), np.radians(pdf.lon.to_numpy())
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
    return 2 * network.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))


def test_nearest_and_coupling(spark, places):
    p = places.dropna().toPandas()
    d = distances(p)
    mean = {s: np.sort(d[i])[1:5].mean() for i, s in enumerate(p.station)}
    got = {r["station"]: r["mean_km"] for r in network.nearest_k(places, 4).collect()}
    assert got == pytest.approx(mean)
    scale = {s: min(max(v, 100), 800) for s, v in mean.items()}
    want = {(p.station[i], p.station[j]): np.exp(-d[i, j] / scale[p.station[i]]) for i in range(len(p)) for j in range(len(p)) if np.exp(-d[i, j] / scale[p.station[i]]) >= 1e-6}
    assert {(r["station"], r["other"]): r["weight"] for r in network.coupling(places, 4, 100.0, 800.0).collect()} == pytest.approx(want)
    few = places.filter("station in ('S2', 'S3')")
    assert network.nearest_k(few, 4).count() == 2 and network.nearest_k(places.limit(0), 4).count() == 0


def test_nearest_station(spark, places):
    pts = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 1.0)], "point_id int, lat double, lon double")
    p = pd.concat([places.dropna().toPandas(), pd.DataFrame([("?", 10.0, 20.0)], columns=["station", "lat", "lon"])], ignore_index=True)
    assert network.nearest_station(pts, places).collect()[0]["station"] == p.station[distances(p)[-1][:-1].argmin()]
    assert [r[0] for r in network.by_latitude(places.select("station"), places).limit(2).collect()] == list(places.dropna().toPandas().sort_values("lat", ascending=False).station[:2])


@pytest.mark.parametrize("detrend", [False, True])
def test_correlation_in_tiles(spark, detrend, monkeypatch):
    rng = np.random.default_rng(3)
    x = {f"S{k}": rng.normal(size=90).cumsum() + 1000 for k in range(9)}
    for v in x.values():
        v[rng.random(90) < 0.2] = np.nan
    df = frame(spark, x)
    pairs = spark.createDataFrame([(a, b) for a in x for b in x if (a, b) != ("S0", "S1")], "station string, other string")
    want = {}
    for a in x:
        for b in x:
            ok = ~np.isnan(x[a] + x[b])
            if a < b and (a, b) != ("S0", "S1"):
                u, v, t = x[a][ok], x[b][ok], np.arange(90)[ok]
                if detrend:
                    u, v = (y - np.polyval(np.polyfit(t, y, 1), t) for y in (u, v))
                want[a, b] = (int(ok.sum()), abs(np.corrcoef(u, v)[0, 1]))
    for tile, span in ((64, 2000), (2, 20)):
        monkeypatch.setattr(network, "TILE", tile)
        monkeypatch.setattr(network, "TILE_EPOCHS", span)
        got = {(r["station"], r["other"]): (r["n"], r["corr"]) for r in network.pair_correlation(df, "x", pairs, detrend).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


@pytest.mark.parametrize("hot, least", [(1_000_000, 0), (50, 0), (50, 10)])
def test_exact_quantiles(spark, hot, least, monkeypatch):
    if least:
        monkeypatch.setattr(quantiles, "BRACKET", 1e-4)  # brackets that miss are widened
        monkeypatch.setattr(quantiles, "SKETCH_K", 8)
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=3000), "b": np.round(rng.normal(size=500), 1), "c": np.full(200, 7.0), "d": rng.normal(size=9), "e": np.array([np.nan])}
    df = spark.createDataFrame([(k, float(v)) for k, a in x.items() for v in a], "k string, v double").repartition(5)
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, "k", "v", [0.25, 0.5, 0.9, 1.0], hot).collect()}
    for k, a in x.items():
        if k == "e":
            assert not got[k] or got[k][0] is None
        else:
            assert got[k] == pytest.approx(np.quantile(a, [0.25, 0.5, 0.9, 1.0]).tolist())


def test_numbered_rows_and_cut(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 40)
    df = frame(spark, {"A": np.arange(300.0), "B": np.arange(10.0)}).repartition(4)
    got = series.numbered(df).toPandas()
    assert (got._row == got.x).all() and len(got) == 310
    assert sorted(r["x"] for r in series.cut(df, i_min=5, i_max=8).filter("station = 'A'").collect()) == [5, 6, 7, 8]


def brute_scores(x, kernel, least):
    out = {}
    for i in range(len(x)):
        h = min(kernel // 2, i, len(x) - 1 - i)
        if 2 * h + 1 < least:
            continue
        k = np.arange(i - h, i + h + 1)
        ok = ~np.isnan(x[k])
        pre, post = (ok & (k < i)).sum(), (ok & (k >= i)).sum()
        if pre < 2 or post < 2:
            continue
        g = np.stack([np.ones(len(k)), k - i, k >= i], 1).astype(float)[ok]
        y, n = x[k][ok], ok.sum()
        rss = [((y - g[:, :c] @ np.linalg.lstsq(g[:, :c], y, rcond=None)[0]) ** 2).sum() for c in (2, 3)]
        aic = [n * np.log(r / n) + 2 * q + 2 * q * (q + 1) / (n - q - 1) if n - q - 1 > 0 else np.nan for r, q in zip(rss, (3, 4))]
        out[i] = (aic[0] - aic[1] if aic[0] > aic[1] else None, rss[0] / n, rss[1] / n)
    return out


def test_step_scores_shrink_at_the_ends(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = {"A": rng.normal(size=80), "B": rng.normal(size=9), "C": rng.normal(size=2)}
    x["A"][6:] += 8
    x["A"][40:44] = np.nan
    df = frame(spark, x)
    for kernel, least in ((15, 7), (15, 15), (7, 3)):
        got = steps.step_scores(df, "x", kernel, kernel_min=least).toPandas().sort_values(["station", "t"])
        for s, v in x.items():
            want = brute_scores(v, kernel, least)
            mine = got[got.station == s].reset_index(drop=True)
            assert len(mine) == len(v)
            for i, r in mine.iterrows():
                if i in want:
                    assert r.var0 == pytest.approx(want[i][1], rel=1e-6) and r.var1 == pytest.approx(want[i][2], rel=1e-6, abs=1e-9)
                    assert (r.probability if r.probability == r.probability else None) == (want[i][0] if want[i][0] is None else pytest.approx(want[i][0], rel=1e-5))
                else:
                    assert np.isnan(r.var0)
    two = steps.over_components([steps.step_scores(df, "x", 7), steps.step_scores(df.withColumn("x", -2 * F.col("x")), "x", 7)])
    assert two.count() == 91
    only = spark.createDataFrame([("A", T0 + dt.timedelta(days=6))], "station string, t timestamp_ntz")
    assert steps.step_scores(df, "x", 15, kernel_min=7, only=only).collect()[0]["probability"] > 5


def test_weighted_trend_change(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.arange(50) * 0.5, 25 + np.arange(50) * -0.2]) + rng.normal(size=100) * 0.01
    df = frame(spark, {"A": x}).withColumn("v", F.when(F.col("x") > 24.9, 0.0).otherwise(1.0 + F.abs(F.col("x"))))
    ev = spark.createDataFrame([("A", T0 + dt.timedelta(days=50, hours=3))], "station string, time timestamp_ntz")
    r = trends.trend_change(df, ev, "x", 30.0, 0.1, "v").collect()[0]
    p, w = df.toPandas(), None
    ok = p.v > 0
    i = np.arange(100) - 50
    w = 1 / (1 + np.abs(p.x))
    a, b = (np.polyfit(i[m], p.x[m], 1, w=np.sqrt(w[m]))[0] for m in ((i < 0) & (i >= -30) & ok, (i >= 0) & (i <= 30) & ok))
    assert r["change"] == pytest.approx(b - a, abs=1e-9) and r["sign"] == -1


def test_events_for_stations(spark):
    t = lambda k: T0 + dt.timedelta(days=k)
    ev = spark.createDataFrame([(1, 0.0, 179.9, t(10), 5.0), (2, 50.0, 0.0, t(20), 8.0), (3, 50.0, 0.0, t(20), 5.0), (4, 0.0, 179.9, t(900), 9.0), (5, None, 0.0, t(10), 9.0), (1, 0.0, 179.9, t(10), 5.0), (6, 89.9, 0.0, t(10), 5.0)], "eq_id int, lat double, lon double, origin_time timestamp_ntz, mw double")
    tg = spark.createDataFrame([("A", 0.2, -179.9, t(5), t(30)), ("B", 89.8, 180.0, t(0), t(300)), ("C", 0.2, -179.9, t(12), t(15)), ("D", 1.0, None, t(0), t(1))], "station string, lat double, lon double, t_start timestamp_ntz, t_end timestamp_ntz")
    got = sorted((r["eq_id"], r["station"]) for r in events.events_for_stations(ev, tg, 60.0, pad_days=1.5).collect())
    assert got == [(1, "A"), (2, "A"), (2, "B"), (6, "B")]
    assert (1, "C") in {(r["eq_id"], r["station"]) for r in events.events_for_stations(ev, tg, 60.0, pad_days=2.0).collect()}


def test_events_for_stations_without_broadcast(spark, tmp_path):
    """Rows repeated for cells and months are not broadcast, however small Spark takes them for; each pair comes once."""
    rng = np.random.default_rng(0)
    n, m = 1500, 60
    ev = pd.DataFrame({"eq_id": np.arange(n), "lat": rng.uniform(-90, 90, n), "lon": rng.uniform(-180, 180, n), "origin_time": np.datetime64(T0, "us") + rng.integers(0, 3000, n) * np.timedelta64(1, "D"), "mw": rng.uniform(3, 8, n)})
    ev.loc[::7, "mw"] = np.nan
    tg = pd.DataFrame({"station": [f"S{k}" for k in range(m)], "lat": rng.uniform(-90, 90, m), "lon": rng.uniform(-180, 360, m), "t_start": np.datetime64(T0, "us") + rng.integers(0, 2000, m) * np.timedelta64(1, "D")})
    tg["t_end"] = tg.t_start + rng.integers(0, 900, m) * np.timedelta64(1, "D")
    for name, pdf in (("ev", ev), ("tg", tg)):
        pd.concat([pdf, pdf.head(20)]).to_parquet(f"{tmp_path}/{name}.parquet", coerce_timestamps="us")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    df = events.events_for_stations(read("ev").withColumn("mw", F.nanvl("mw", F.lit(None))), read("tg"), 1500.0, 7.0, 5.0)
    got = df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    a, b = np.radians(ev.lat.to_numpy())[:, None], np.radians(tg.lat.to_numpy())
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(ev.lon.to_numpy()[:, None] - tg.lon.to_numpy()) / 2) ** 2
    km = 2 * network.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))
    t, pad = ev.origin_time.to_numpy()[:, None], np.timedelta64(5, "D")
    want = (t >= tg.t_start.to_numpy() - pad) & (t <= tg.t_end.to_numpy() + pad) & ((km <= 1500) | (ev.mw.to_numpy() > 7)[:, None])
    assert len(got) == want.sum() > 1000
    assert {(r["eq_id"], r["station"]): r["km"] for r in got} == pytest.approx({(i, f"S{j}"): km[i, j] for i, j in np.argwhere(want)})


def test_sessions(spark):
    times = spark.createDataFrame([(T0 + dt.timedelta(days=k),) for k in (0, 1, 1, 9, 10, 30)] + [(None,)], "time timestamp_ntz")
    assert [(r["start_t"].day, r["n"]) for r in events.sessions(times, 5.0).orderBy("start_t").collect()] == [(1, 2), (10, 2), (31, 1)]


def test_published_dislocation(spark):
    """Point sources added up over a fault of 3 x 2 give the published displacements of the rectangular source."""
    n = 60
    xi, eta = np.meshgrid((np.arange(n) + 0.5) * 3 / n, (np.arange(n) + 0.5) * 2 / n)
    dip = np.radians(70.0)
    src = pd.DataFrame({"x": 2 - xi.ravel(), "y": 3 - eta.ravel() * np.cos(dip), "d": 4 - eta.ravel() * np.sin(dip)})
    df = spark.createDataFrame(src)
    for rake, want in ((0.0, (-8.689e-3, -4.298e-3, -2.747e-3)), (90.0, (-4.682e-3, -3.527e-2, -3.564e-2))):
        u = dislocation.point_source(F.col("x"), F.col("y"), F.col("d"), F.lit(70.0), F.lit(rake), F.lit(6.0 / n**2))
        got = df.select(*[c.alias(k) for c, k in zip(u, "xyz")]).groupBy().sum().collect()[0]
        assert np.allclose(got, want, rtol=2e-3)


def test_dislocation_steps(spark):
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(days=3, hours=5), 0.0, 0.0, 10.0, 7.0, None, 0.0, 90.0, 0.0), (2, T0, 0.0, 0.0, 0.0, 7.0, None, 0.0, 90.0, 0.0)], "eq_id int, origin_time timestamp_ntz, lat double, lon double, depth_km double, mw double, mo_nm double, strike double, dip double, rake double")
    st = spark.createDataFrame([("A", 0.1, 0.1, 0.0), ("B", 40.0, 0.0, 0.0), ("E", 0.1, -0.1, None)], "station string, lat double, lon double, alt double")
    d = {r["station"]: r for r in dislocation.displacements(ev, st).collect()}
    assert d.keys() == {"A", "E"} and d["A"]["north_mm"] == pytest.approx(-d["E"]["north_mm"]) and d["A"]["north_mm"] > 0  # left-lateral slip along north
    obs = frame(spark, {"A": np.arange(8.0), "B": np.arange(8.0)})
    s = dislocation.dislocation_steps(obs, ev, st, 1.0).collect()
    assert [(r["station"], r["t"].day, r["n"]) for r in s] == [("A", 5, 1)]


def test_user_functions(spark, monkeypatch):
    df = frame(spark, {"A": np.arange(500.0), "B": np.arange(5.0)})
    f = lambda pdf: pdf.assign(x=pdf.x.rolling(3, center=True, min_periods=1).mean())[["station", "t", "x"]]
    whole = custom.on_each_series(df, f, "station string, t timestamp_ntz, x double")
    monkeypatch.setattr(series, "BLOCK_ROWS", 60)
    parts = custom.on_each_series(df, f, "station string, t timestamp_ntz, x double", reach=1)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(whole) == key(parts) and whole.count() == 505
    common = custom.on_epochs(df, "x", lambda x: x - x.mean(), "station string, t timestamp_ntz, off double", minimum=2)
    assert common.count() == 10 and common.filter("off <> 0").count() == 0
    assert custom.on_network(df, lambda d: d.groupBy("t").count()).count() == 500


@pytest.mark.parametrize("native", [False, True])
def test_custom_models(spark, native):
    models.register("Ramp", lambda kw: 1, lambda tau, kw: np.clip(tau / kw["length"], 0, 1)[:, None], (lambda tau, kw: [F.greatest(F.least(tau / kw["length"], F.lit(1.0)), F.lit(0.0))]) if native else None)
    specs = [models.ModelSpec("p", "Polynomial", {"order": 0}), models.ModelSpec("r", "Ramp", {"length": 20.0}, "2000-01-11")]
    x = 3 + 7 * np.clip((np.arange(60) - 10) / 20, 0, 1)
    df = frame(spark, {"A": x})
    p = api.fit(df, specs, ["x"])
    assert p.filter("model = 'r'").first()["value"] == pytest.approx(7)
    assert np.allclose(api.evaluate(df, p, specs, ["x"]).orderBy("t").toPandas().fit_x, x)


def test_inventory_selection(spark):
    inv = spark.createDataFrame([("A", "n", 2000, dt.date(2000, 1, 2), 5), ("A", "m", 2001, dt.date(2001, 1, 2), 6), ("B", "n", 2000, dt.date(2000, 5, 2), 7)], "station string, network string, year int, date date, filesize long")
    assert formats.select_files(inv, ["A"], years=[2000]).count() == 1 and formats.select_files(inv, networks=["n"], between=("2000-01-01", "2000-02-01")).count() == 1
    s = formats.holding_summary(inv).first()
    assert (s["num_files"], s["num_stations"], s["bytes"]) == (3, 2, 18)


def test_quality_gate(spark):
    df = frame(spark, {"A": np.arange(400.0), "B": np.arange(50.0)})
    assert [r["station"] for r in availability.quality_gate(df).collect()] == ["A"]


def test_shared_folder(spark, monkeypatch):
    class Other:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Other())
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
