import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import packed, regrid, rejects, spikes, units
from tidemark.operators.blocks import ordered_blocks, whole_groups

T0 = dt.datetime(2020, 1, 1)
OBS = "obs_id bigint, series_id bigint, station string, t timestamp_ntz, east double, north double, up double, east_var double, north_var double, up_var double, east_north_cov double, east_up_cov double, north_up_cov double, block string, core int, um_per_unit string, hour int"
SERIES = "series_id bigint, data_unit string, data_cols string, var_cols string, step_s int, notes string, sec string, scatter_east string"


def frame(spark, schema, rows):
    names = [x.strip().split()[0] for x in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def make_obs(spark, series: dict[int, np.ndarray], step_s=86400, extra=()):
    rows, k = [], 0
    for sid, x in series.items():
        for i, v in enumerate(x):
            k += 1
            rows.append({"obs_id": k, "series_id": sid, "station": "A", "t": T0 + dt.timedelta(seconds=i * step_s + 60), "east": None if np.isnan(v) else float(v), "block": "clash", "core": 7})
    return frame(spark, OBS, rows + list(extra))


def make_series(spark, rows):
    return frame(spark, SERIES, [{"data_cols": "east", "step_s": 86400, "sec": "clash"} | r for r in rows])


# --- blocks ---


def test_blocks_cover_each_row_once_and_hold_halos(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [1] * 5000 + [2] * 300, "o": np.r_[np.random.default_rng(0).permutation(5000), np.arange(300)]}))
    b = ordered_blocks(df, "k", "o", block_rows=1000).toPandas()
    assert len(b[b.core]) == 5300
    assert (b[b.k == 2].block == 0).all()
    hot = b[b.k == 1]
    assert hot.block.nunique() == 8
    for n, g in hot.groupby("block"):
        core = np.sort(g[g.core].o)
        assert (np.diff(core) == 1).all() and len(core) < 1000
        every = np.sort(g.o)
        assert (np.diff(every) == 1).all()
        assert n == 0 or core[0] - every[0] >= 30
        assert n == 7 or every[-1] - core[-1] >= 30


def test_blocks_of_nothing(spark):
    assert ordered_blocks(spark.createDataFrame([], "k int, o bigint"), "k", "o").count() == 0


@given(st.lists(st.integers(0, 3), max_size=40).map(sorted), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_whole_groups(keys, size):
    df = pd.DataFrame({"a": keys, "v": range(len(keys))})
    parts = list(whole_groups((df.iloc[i : i + size] for i in range(0, len(df), size)), ["a"]))
    assert [v for p in parts for v in p.v] == list(range(len(keys)))
    seen = [set(p.a) for p in parts]
    assert all(not (x & y) for i, x in enumerate(seen) for y in seen[:i])


# --- units ---


@pytest.mark.parametrize(
    "text, um",
    [("mm", 1e3), (" MM. ", 1e3), ("[mm]", 1e3), ("mètre", 1e6), ("1000 mm", 1e6), ("m*10^-3", 1e3), ("10^-4 m", 100), ("1e-3 m", 1e3), ("mm/10", 100), ("1/10 mm", 100), ("tenths of mm", 100), ("0.1mm", 100), ("µm", 1), ("μm", 1), ("Ft.", 304800), ("in.", 25400), ("see notes", None), ("", None), (None, None), ("m per year", None), ("-", None)],
)
def test_unit_texts(spark, text, um):
    aliases = spark.createDataFrame(list(units.ALIASES.items()), "_alias string, _um double")
    df = spark.createDataFrame([(text,)], "u string")
    got = units.size_um(df["u"], aliases, df, "um").first()["um"]
    assert got is None if um is None else got == pytest.approx(um)


def test_units_from_notes_field_and_numbers(spark):
    rng = np.random.default_rng(1)
    mm = lambda: rng.normal(0, 2.0, 200).cumsum() * 0 + rng.normal(0, 2.0, 200)
    obs = make_obs(spark, {1: mm(), 2: mm() / 1000, 3: mm() / 1000, 4: mm() / 25.4, 5: mm() * 1000, 6: np.full(50, np.nan), 8: np.ones(30)})
    series = make_series(spark, [
        {"series_id": 1, "data_unit": "mm"},
        {"series_id": 2, "data_unit": "mm", "notes": "bedrock at 3 mm; correction: treat as metres, not as tagged"},
        {"series_id": 3, "data_unit": "mm"},  # the field is wrong
        {"series_id": 4, "data_unit": None, "notes": "E N U ((in)); reference frame local"},
        {"series_id": 5, "data_unit": "?", "notes": "antenna mast 5 m above ground"},
        {"series_id": 6, "data_unit": "cm"},
        {"series_id": 7, "data_unit": None},
        {"series_id": 8, "data_unit": "cm"},
        {"series_id": 8, "data_unit": "cm"},
    ])
    got = {r["series_id"]: (round(r["um_per_unit"]), r["basis"]) for r in units.series_units(obs, series).collect()}
    assert got == {1: (1000, "field"), 2: (1000000, "notes"), 3: (1000000, "numbers"), 4: (25400, "notes"), 5: (1, "numbers"), 6: (10000, "field"), 7: (1000, "default"), 8: (10000, "field")}
    back = units.to_millimetres(obs, units.series_units(obs, series)).filter("series_id = 4").toPandas()
    assert back.east.std() == pytest.approx(2.0, rel=0.2)


def test_source_default_and_offset(spark):
    rng = np.random.default_rng(1)
    obs = make_obs(spark, {1: rng.normal(0, 0.2, 100), 2: rng.normal(0, 0.2, 100), 3: rng.normal(0, 2.0, 100)})
    rows = [{"series_id": k, "data_unit": "cm" if k < 3 else "mm"} for k in (1, 2, 3)] + [{"series_id": 4}, {"series_id": 5}, {"series_id": 6, "data_unit": "m"}]
    src = F.when(F.col("series_id") <= 4, "tenv3").when(F.col("series_id") == 6, "kenv")
    series = make_series(spark, rows).withColumn("src", src)
    u = units.series_units(obs, series)
    assert {r["series_id"]: (r["um_per_unit"], r["basis"]) for r in u.filter("series_id > 3").collect()} == {4: (1e4, "source"), 5: (1e3, "default"), 6: (1e6, "field")}
    moved = units.to_millimetres(obs, u.withColumn("offset_um", F.lit(5000.0)))
    pairs = moved.join(obs.select("obs_id", F.col("east").alias("raw")), "obs_id").filter("series_id = 1").collect()
    assert all(r["east"] == pytest.approx(r["raw"] * 10 + 5) for r in pairs)


def test_scatter_is_the_same_in_blocks(spark):
    obs = make_obs(spark, {1: np.random.default_rng(3).normal(0, 1, 4000)})
    one, cut = units.epoch_scatter(obs).first()["delta"], units.epoch_scatter(obs, block_rows=1000).first()["delta"]
    assert one == pytest.approx(cut, rel=0.02) and one == pytest.approx(np.sqrt(2), rel=0.05)


def test_units_of_nothing(spark):
    assert units.series_units(make_obs(spark, {}), make_series(spark, [])).count() == 0


# --- rejects ---

LINES = [
    ("# head", None), ("name lat lon alt", None), ("A1 1 2 3", "row"), ("", None), ("  # x", None), (None, None),
    ('"A ""q"" b"\t1.5\t-2e0  +3.\r', "row"), ('"A 1 2 3', "quote"), ('"A"B 1 2 3', "quote"), ('A"B 1 2 3', "quote"), ('A 1 2 3"', "quote"),
    ("A 1 2", "columns"), ("A 1 2 3 4", "columns"), ("A,1,2,3", "columns"), ("A 91 2 3", "value"), ("A 1 361 3", "value"), ("A 1 2 9001", "value"), ("A nan 2 3", "value"),
    ("A 1_0 2 3", "value"), ("A 0x1 2 3", "value"), ("A １ 2 3", "value"), ('A "" 2 3', "value"), ("A . 2 3", "value"), ("A 1e999 2 3", "value"), ("A .5 -180 -500", "row"),
    ('"" 1 2 3', "row"), ("A 1\r2 2 3", "value"), ('A "1" "2" "3"', "row"), ("B" * 100_000 + " 1 2 3", "row"), ('"a" "b', "quote"), ("name lat lon alt", "value"),
]


def test_lines(spark):
    rows = [(i, "f", i + 1, x) for i, (x, _) in enumerate(LINES)] + [(900 + i, "g", i, "no good line") for i in range(3)]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, raw_line string").selectExpr("*", "'clash' as reason", "1 as _first", "'x' as kind")
    good, bad = rejects.load_lines(df)
    assert {r["line_id"] for r in good.collect()} == {i for i, (_, k) in enumerate(LINES) if k == "row"}
    assert {r["line_id"]: r["reason"] for r in bad.collect()} == {i: k for i, (_, k) in enumerate(LINES) if k not in (None, "row")}
    first = good.filter("line_no = 7").first()
    assert (first["name"], first["lat"], first["lon"], first["alt"]) == ('A "q" b', 1.5, -2.0, 3.0)


def verdicts(lines):
    out = next(rejects._parse(iter([pd.DataFrame({"line_id": range(len(lines)), "file_name": "f", "line_no": range(len(lines)), "raw_line": lines})])))
    return out.kind.where(out.kind != "bad", out.reason).tolist(), out.by.tolist()


@given(st.lists(st.lists(st.sampled_from(['"', '""', " ", "\t", "A", "1", "2.5", "-3", "nan", "\r", "\n", "_", "é", '"A"', '"a b"', ",", "91", "\ue000", "\x02"]), max_size=12).map("".join), max_size=30))
@settings(max_examples=60, deadline=None)
def test_reader_and_check_together_follow_the_grammar(lines):
    def want(line):
        t = line.strip(" \t\r\n")
        return "skip" if not rejects._UNSEEN.sub("", t) else rejects.judge(rejects.split_line(t)) or "row"

    assert verdicts(lines)[0] == [want(x) for x in lines]


def test_reader_decides_the_lines(monkeypatch):
    lines = ['"A 1 2 3', '"A"B 1 2 3', "A 1 2", "A 1 2 3 4", "A x 2 3", "A 1 2 3"]
    assert verdicts(lines) == (["quote", "quote", "columns", "columns", "value", "row"], ["reader"] * 6)
    assert verdicts(['A"B 1 2 3', "A 91 2 3", "A nan 2 3", "A 1_0 2 3"]) == (["quote", "value", "value", "value"], ["check"] * 4)
    monkeypatch.setattr(rejects, "_read", lambda con, part, n: (pd.DataFrame({c: pd.Series(dtype=float) for c in ("line_id", "name", "lat", "lon", "alt")}), np.full(n, -1)))
    assert set(verdicts(lines)[0]) == {"unread"}


def test_no_lines(spark):
    good, bad = rejects.load_lines(spark.createDataFrame([], "line_id bigint, file_name string, line_no int, raw_line string"))
    assert good.count() == bad.count() == 0


# --- regular grid ---


def test_grid_marks_and_fills(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(0, 5, 120).cumsum()
    series, truth = {}, {}
    for s in range(1, 9):
        x = common * (0.5 + 0.2 * s) + rng.normal(0, 0.05, 120)
        truth[s] = x.copy()
        x[rng.choice(np.arange(5, 115), 12, replace=False)] = np.nan
        series[s] = x
    series[99] = np.r_[np.full(400, np.nan), np.arange(7.0), np.full(4, np.nan), np.arange(29.0)]  # no other series then
    obs = make_obs(spark, series)
    obs = obs.unionByName(obs.filter("series_id = 1"))  # repeated rows
    spec = make_series(spark, [{"series_id": s} for s in (*range(1, 9), 99, 100)] + [{"series_id": 101, "step_s": None}])
    g = regrid.regular_grid(obs, spec).toPandas().sort_values(["series_id", "slot"])
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 86400
    for s, x in series.items():
        mine = g[g.series_id == s]
        if s == 99:
            x, base = x[400:], base + 400
        assert list(mine.slot) == list(range(base, base + len(x)))
        assert list(mine["empty"]) == list(np.isnan(x))
        ok = ~np.isnan(x)
        assert np.allclose(mine.east[ok], x[ok])  # observed cells are exact
        assert set(mine.east_state[~ok]) == ({regrid.FILLED} if s < 99 else {regrid.MARKED})
        assert (mine.up_state == regrid.ABSENT).all()
    filled = np.concatenate([(g[g.series_id == s].east - truth[s])[np.isnan(series[s])] for s in range(1, 9)])
    assert np.sqrt((filled**2).mean()) < 0.15 * common.std()
    long = regrid.long_grid(regrid.regular_grid(obs, spec), spec)
    assert {r[0] for r in long.filter("series_id = 99").select("state").distinct().collect()} == {"observed", "marked"}


@pytest.mark.parametrize("bound", [None, 0])
def test_fill_does_not_depend_on_the_tiles(spark, bound, monkeypatch):
    if bound is not None:
        monkeypatch.setattr(session, "BROADCAST_BYTES", bound)
    rng = np.random.default_rng(9)
    common = rng.normal(0, 5, 150).cumsum()
    x = {s: np.where(rng.random(150) < 0.15, np.nan, common * (0.5 + 0.1 * s) + rng.normal(0, 0.2, 150)) for s in range(1, 13)}
    obs, spec = make_obs(spark, x), make_series(spark, [{"series_id": s} for s in x])
    whole, cut = (regrid.regular_grid(obs, spec, window=64, tile_cells=n).toPandas().sort_values(["series_id", "slot"]).reset_index(drop=True) for n in (250_000, 200))
    assert (whole.east_state == regrid.FILLED).sum() > 100
    assert whole[["series_id", "slot", "empty", "east_state"]].equals(cut[["series_id", "slot", "empty", "east_state"]])
    assert np.allclose(whole.east, cut.east, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_held_out_cells(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(0, 5, 400).cumsum()
    x = {s: common * (0.5 + 0.2 * s) + rng.normal(0, 0.05, 400) for s in range(1, 9)}
    got = regrid.held_out(make_obs(spark, x), make_series(spark, [{"series_id": s} for s in x])).collect()
    assert [r["col_name"] for r in got] == ["east"] and 100 < got[0]["filled"] == got[0]["hidden"] < 230 and got[0]["error"] < 0.05


def test_grid_of_nothing(spark):
    assert regrid.regular_grid(make_obs(spark, {}), make_series(spark, [])).count() == 0


# --- packed fields ---

CODES = packed.Codes(
    360,
    {"semicolon": 230, "none": 90, "blank": 70, "comma": 70, "bar": 50, "slash": 50, "hyphen": 25, "semicolon+slash": 1, "semicolon quoted": 40, "label": 9, "and": 9, "or": 9, "dash": 9, "tab": 9, "line": 9, "ampersand": 9},
    {v: 3 for v in range(361)} | {None: 40, "NP1:": 20, "NP2:": 20},
)


@pytest.mark.parametrize(
    "text, values",
    [
        ("248;294.0", [248, 294]), ("013", [13]), ('"138";"101"', [138, 101]), ("NP1=58, NP2=1", [58, 1]), ("NP1: 39 NP2: 2", [39, 2]), ('"22" "131"', [22, 131]), ("(31|68)", [31, 68]),
        ("105-253", [105, 253]), ("23 and 15", [23, 15]), ("44\n33", [44, 33]), ("10°", [10]), ("-/229.0", [None, 229]), ('"nan";"70"', [None, 70]), (";168", [None, 168]), ("5;;7", [5, None, 7]),
        ("12;", [12, None]), ("1|80.0/2", [1, 80, 2]), (" 345;249°/250;127 ", [345, 249, 250, 127]), ("141   7", [141, 7]), ("361", [None]), ("-5;6", [None, 6]), ("10.5;6", [None, 6]), ("", [None]),
        ("7 or 59", [7, 59]), ("89–31", [89, 31]), ("[60;NA]", [60, None]), ('"14|nan|260"', [14, None, 260]), ("88\t57°", [88, 57]), ("A & B", [None]),
    ],
)
def test_unpack_texts(text, values):
    assert packed.parse(text, 360, CODES)[1] == values


@given(st.lists(st.one_of(st.integers(0, 360), st.none()), min_size=2, max_size=5).filter(lambda v: any(x is not None for x in v)), st.sampled_from([";", "|", "/", ", ", "; ", " | "]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_unpack_round_trip(values, sep, quoted):
    write = lambda v: "" if v is None else f'"{v}"' if quoted else str(v)
    assert packed.parse(sep.join(map(write, values)), 360, CODES)[1] == values


def test_code_lengths_decide(spark, monkeypatch):
    """`a - b` is two values with a hyphen or three with blanks and a missing one: what else the table holds decides."""
    table = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(["7 - 9", *texts])], "id int, strike string")
    got = lambda texts: [r["degrees"] for r in packed.unpack(table(texts), "id", {"strike": 360}).filter("id = 0").orderBy("pos").collect()]
    hyphens = [f"{k % 361}-{k * 7 % 361}" for k in range(400)]
    blanks = [f"7 {'nan' if k % 2 else 9} 9" for k in range(400)]
    assert got(hyphens) == [7, 9]
    assert got(blanks) == [7, None, 9]
    monkeypatch.setattr(packed, "_lengths", lambda counts: (None, 0.0))  # codes of the form alone
    assert got(blanks) == [7, 9]


def test_unpack_table(spark):
    df = spark.createDataFrame([(1, "10;20", None, "c"), (1, "10;20", None, "c"), (2, None, "x" * 50_000, "c"), (3, "", "5", "c")], "id bigint, strike string, dip string, pos string")
    got = sorted((r["id"], r["field_name"], r["pos"], r["degrees"]) for r in packed.unpack(df, "id", {"strike": 360, "dip": 90}).distinct().filter("degrees is not null").collect())
    assert got == [(1, "strike", 1, 10), (1, "strike", 2, 20), (3, "dip", 1, 5)]
    assert packed.unpack(df.limit(0), "id", {"strike": 360}).count() == 0


# --- spikes ---


def faulty(values, hours=None):
    """Straight from the definition, one value at a time."""
    x = np.asarray(values, float)
    idx = np.flatnonzero(~np.isnan(x))
    hours = np.zeros(len(x), int) if hours is None else hours
    off, dev = {}, dict.fromkeys(idx, 0.0)
    for a in range(len(idx)):
        for n in (1, 2, 3):
            before, after = x[idx[max(0, a - 8) : a]], x[idx[a + n : a + n + 8]]
            if len(before) < 2 or len(after) < 2 or a + n > len(idx):
                continue
            b, c, v = np.median(before), np.median(after), x[idx[a : a + n]]
            if n == 1:
                off[idx[a]] = x[idx[a]] - (b + c) / 2
            far = max((v - max(b, c)).min(), 0) or -max((min(b, c) - v).min(), 0)
            for i in idx[a : a + n]:
                dev[i] = far if abs(far) > abs(dev[i]) else dev[i]
    out = set()
    whole = np.quantile(list(off.values()), [0.25, 0.75])
    for h in set(hours[list(off)]):
        mine = [v for i, v in off.items() if hours[i] == h]
        w = len(mine) / (len(mine) + 200)
        q1, q3 = w * np.quantile(mine, [0.25, 0.75]) + (1 - w) * whole
        k = (6 - 0.67448975) / 1.3489795
        out |= {i for i, d in dev.items() if hours[i] == h and (d > q3 + k * (q3 - q1) or d < q1 - k * (q3 - q1))}
    run = 0
    for a in range(len(idx)):
        run = run + 1 if a and x[idx[a]] == x[idx[a - 1]] else 1
        if run >= 6:
            out |= set(idx[a - run + 1 : a + 1])
    return out


def spike_series():
    rng = np.random.default_rng(8)
    series = {}
    for s, n in ((1, 300), (2, 400), (3, 4500)):
        x = rng.normal(0, 2.0, n) + 0.02 * np.arange(n)
        x[n // 2 :] += 90  # a lasting offset
        for k in range(20, n - 20, 37):
            x[k : k + 1 + k % 3] += rng.choice([-1, 1]) * rng.uniform(40, 400)
        x[5] += 6.0  # within six times the scatter
        x[100:109] = x[99]
        x[150:155] = x[149] if s != 2 else x[150]  # five or six equal
        x[60:63] = np.nan
        series[s] = x
    return series


def flagged(spark, obs, spec, **kw):
    got = spikes.implausible(obs, spec, **kw).toPandas()
    at = obs.toPandas().assign(i=lambda d: d.groupby("series_id").cumcount()).set_index("obs_id")
    return {s: {at.i[o] for o in got.obs_id if at.series_id[o] == s} for s in at.series_id.unique()}


@pytest.mark.parametrize("block_rows", [1_000_000, 1000])
def test_spikes_against_the_definition(spark, block_rows, monkeypatch):
    if block_rows == 1000:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)  # the way beyond the bound
    series = spike_series()
    spec = make_series(spark, [{"series_id": s, "data_unit": "mm"} for s in series])
    got = flagged(spark, make_obs(spark, series), spec, block_rows=block_rows)
    assert got == {s: faulty(x) for s, x in series.items()}


def test_fences_decide_by_hour_context(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 2400  # hourly; calm from midnight to six, rough for the rest of the day
    hours = np.arange(n) % 24 // 6
    x = rng.normal(0, np.where(hours == 0, 0.3, 2.4))
    x[[603, 1203]] += 8.0  # at three o'clock: far outside the calm hours' fences, inside the rough ones'
    x[[615, 1215]] += 8.0
    obs, spec = make_obs(spark, {1: x}, 3600), make_series(spark, [{"series_id": 1, "data_unit": "mm", "step_s": 3600}])
    got = flagged(spark, obs, spec)[1]
    assert got == faulty(x, hours) and {603, 1203} <= got and not {615, 1215} & got
    monkeypatch.setattr(spikes, "LEAN", 1e12)  # without contexts the night spikes pass
    assert not {603, 1203} & flagged(spark, obs, spec)[1]
    monkeypatch.setattr(spikes, "FENCE_IQR", 0.0)  # without the expansion good readings fall
    assert len(flagged(spark, obs, spec)[1]) > 50


def test_limits_variances_and_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.002, 100)
    x[50] += 0.5
    when = T0 + dt.timedelta(seconds=50 * 86400 + 60)
    rows = [{"obs_id": 1000, "series_id": 1, "t": when, "east": float(x[50])}, {"obs_id": 1001, "series_id": 1, "t": when, "east": 0.0}, {"obs_id": 1002, "series_id": 1, "t": T0 + dt.timedelta(days=300), "east": -150.0},
            {"obs_id": 1003, "series_id": 1, "t": T0 + dt.timedelta(days=301), "east": float("nan"), "east_var": 0.0}, {"obs_id": None, "series_id": 1, "t": when, "east": 1e9}, {"obs_id": 1005, "series_id": None, "t": when, "east": 1e9},
            {"obs_id": 1006, "series_id": 1, "t": None, "east": 1e9}, {"obs_id": 1007, "series_id": 1, "t": T0, "north": 1e9}] + [{"obs_id": 2000 + k, "series_id": 1, "t": T0 + dt.timedelta(days=400 + k), "east_var": 1.0 if k else 26.0} for k in range(30)]
    obs = make_obs(spark, {1: x}, extra=rows)
    spec = make_series(spark, [{"series_id": 1, "data_unit": "m", "var_cols": "east_var"}])
    got = {(r["obs_id"], r["col_name"], r["reason"]) for r in spikes.implausible(obs, spec).collect()}
    assert got == {(51, "east", "spike"), (1000, "east", "spike"), (1002, "east", "limit"), (1003, "east_var", "variance"), (2000, "east_var", "variance"), (1006, "east", "limit")}


def test_no_readings(spark):
    assert spikes.implausible(make_obs(spark, {}), make_series(spark, [])).count() == 0
    assert spikes.implausible(make_obs(spark, {1: np.full(5, np.nan)}), make_series(spark, [{"series_id": 1}])).count() == 0
