import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leakage, mixing, queries, textstats

DOC = "doc_id bigint, text string, source string, item_id int, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "clash") for i, t, s in rows], DOC)


# --- leakage ---


@pytest.mark.parametrize("text, want", [("Ça **va**, C'est l’été!", ["ca", "va", "c", "est", "l", "ete"]), ("co­op​ x_y", ["coop", "x", "y"]), ("<b>Bo</b>ld", ["bo", "ld"]), ("STRASSE Straße", ["strasse", "strasse"]), ("été", ["ete"]), ("", []), (None, [])])
def test_words(text, want):
    assert leakage.words(text) == want


def brute(corpus, tests, least):
    """Every maximal match by comparing all pairs of positions."""
    out = set()
    for a in range(len(corpus)):
        for b in range(len(tests)):
            n = 0
            while a + n < len(corpus) and b + n < len(tests) and corpus[a + n] == tests[b + n] != 0:
                n += 1
            before = a and b and corpus[a - 1] == tests[b - 1] != 0
            if n >= least and not before:
                out.add((a, b, n))
    return out


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=40), st.integers(1, 11))
@settings(max_examples=200, deadline=None)
def test_matches_against_brute_force(corpus, tests, least):
    got = leakage.shard_matches(np.array(corpus, np.int64), np.array(tests, np.int64), least)
    assert set(zip(*(x.tolist() for x in got))) == brute(corpus, tests, least)


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    rows = [
        (1, "x " + item.upper().replace(" ", ", ") + " y", "s"), (2, " ".join(w[:10]), "s"), (3, " ".join(w[:9]) + " x " + " ".join(w[9:]), "s"), (4, None, "s"), (5, "", "s"),
        (6, ("pad " * 60_000) + " ".join(w[2:]), "s"), (7, item + " " + item, "s"), (7, item + " " + item, "s"), (None, item, "s"), (8, " ".join(w[:6]) + " x " + " ".join(w[:9]), "s"),
    ]
    items = spark.createDataFrame([(1, item, "c"), (2, "too short", "c"), (3, None, "c"), (None, item, "c"), (4, "one two three four five six seven eight nine ten", "c")], "item_id bigint, passage string, doc_id string")
    for shard in (2_000_000, 50):
        got = {(r["doc_id"], r["item_id"]): r["words"] for r in leakage.leaked_passages(docs(spark, rows), items, shard_words=shard).collect()}
        assert got == {(1, 1): 12, (2, 1): 10, (6, 1): 10, (7, 1): 12}
    leaks = leakage.leaked_passages(docs(spark, rows), items)
    assert sorted(r[0] for r in leakage.without_leaks(docs(spark, rows), leaks).filter("doc_id is not null").select("doc_id").collect()) == [3, 4, 5, 8]
    assert leakage.leaked_passages(docs(spark, []), items).count() == leakage.leaked_passages(docs(spark, rows), items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "TEST_WORDS", 20)
    texts = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, passage string")
    got = leakage.leaked_passages(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["words"]) for r in got) == [(k, k, 12) for k in range(5)]


# --- mixing ---


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for s, n in (("a", 400), ("b", 300), ("c", 20), (None, 30), ("other", 30)):
        for _ in range(n):
            k += 1
            rows.append((k, " ".join(["word"] * int(rng.integers(1, 60))), s))
    rows += [(9001, None, "a"), (9002, "", "b")]
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.55, 3), ("c", 0.15, 2), ("none", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeat int")
    copies, report = mixing.mix(docs(spark, rows), targets)
    r = report.toPandas().set_index("source")
    total = r.tokens.sum()
    assert list(r.index.sort_values()) == ["a", "b", "c", "none"]
    assert {s: bool(v) for s, v in r.falls_short.items()} == {"a": False, "b": False, "c": True, "none": True}
    for s in ("a", "b"):
        assert abs(r.used_tokens[s] - r.target_share[s] * total) <= 60
    assert r.used_tokens["c"] == 2 * r.tokens["c"] and r.used_tokens["none"] == 0
    assert r.actual_share.sum() == pytest.approx(1)
    c = copies.toPandas()
    assert (c.copies <= c.source.map({"a": 1, "b": 3, "c": 2})).all() and len(c) == 722
    size = lambda s: c[c.source == s].sort_values("tokens")
    assert size("a").rate.is_monotonic_decreasing and size("b").rate.is_monotonic_increasing  # an exponential tilt
    again = mixing.mix(docs(spark, rows), targets)[0].toPandas()
    assert c.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeat int")
    copies, report = mixing.mix(docs(spark, []), targets)
    assert copies.count() == 0 and report.first()["actual_share"] is None
    assert mixing.mix(docs(spark, [(1, "x", "a")]), targets.limit(0))[1].count() == 0


# --- statistics ---

COMMON = ["the", "of", "and", "is", "was", "in", "because", "after", "each", "with", "it", "so", "not"]


def corpus(n=60):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("bdfgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3))
    rows = []
    for k in range(n):
        prose = " ".join(f"The {word()} of the {word()} is {word()} because it was in the {word()}." for _ in range(4))
        if k % 3 == 1:  # wrapped after some words
            ws, width = prose.split(), int(rng.integers(1, 9))
            prose = "\n".join(" ".join(ws[a : a + width]) for a in range(0, len(ws), width))
        rows.append((4 * k, prose if k % 3 else prose.upper().replace(". ", ".\n"), "prose"))
        rows.append((4 * k + 1, "\n".join(f"- {word()} / {word()}" for _ in range(10)), "list"))
        rows.append((4 * k + 2, "\n".join(" | ".join([word(), *(f"{rng.uniform(-9, 99):.2f}" for _ in range(4))]) for _ in range(6)), "table"))
        rows.append((4 * k + 3, "".join(rng.choice(list("{}[]<>!@#$%^&*~=+|ab01 "), 120)), "junk"))
    return rows


def test_labels(spark, data):
    rows = corpus()
    mixed = [(9001, rows[0][1] + "\n- a b\n- c d", "prose"), (9002, "The end of it was in the road.\n" + "\n".join(f"{k}) nozi tabe / gule" for k in range(20)), "list"), (9003, "word\n" * 5, "x"), (9004, "The\nend\nof\nthe\nroad\nis\nin\nthe\nvalley\nand\nit\nwas\nold.", "prose")]
    df = docs(spark, rows + mixed + [(9010, None, "-"), (9011, "", "-"), (9012, " \n ", "-"), (None, "x", "-"), (9013, "The road is in the valley. " * 20_000, "prose")])
    words = spark.read.parquet(f"{data}/common_words.parquet").unionByName(spark.createDataFrame([("en", None, 999)], "lang string, word string, word_rank int"))
    got = {r["doc_id"]: r["label"] for r in textstats.classify_documents(df, words).collect()}
    want = {i: s for i, _, s in rows + mixed}
    assert {9010, 9011, 9012, None}.isdisjoint(got)
    wrong = [i for i, s in want.items() if (got[i] == "prose") != (s == "prose")]
    assert not wrong
    assert got[9013] == "prose"
    same = np.mean([got[i] == s for i, s in want.items() if s in ("list", "table", "junk")])
    assert same > 0.9
    assert textstats.classify_documents(docs(spark, []), words).count() == 0


def test_mixture_decides_alone(spark, data, monkeypatch):
    """Without the fit, prose is not told from the rest."""
    rows = corpus(20)
    words = spark.read.parquet(f"{data}/common_words.parquet")
    label = lambda: {r["doc_id"]: r["label"] for r in textstats.classify_documents(docs(spark, rows), words).collect()}
    fitted = label()
    assert [i for i, _, s in rows if (fitted[i] == "prose") != (s == "prose")] == []
    assert set(fitted.values()) == {"prose", "list", "table", "junk"}
    fit = textstats.fit_mixture

    def unfitted(stats, common):
        centre, scale, (w, m, c), names = fit(stats, common)
        return centre, scale, (w, np.zeros_like(m), c * 0 + np.eye(m.shape[1])), names

    monkeypatch.setattr(textstats, "fit_mixture", unfitted)
    assert len(set(label().values())) == 1


def test_long_word_lists_are_joined(spark, monkeypatch):
    rows = corpus(6) + [(9001, "", "x"), (9002, "é", "x"), (1, "The the", "x"), (9003, "zzz", "x")]
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON + [None, "THE"])], "lang string, word string, word_rank int")
    got = lambda: sorted(map(tuple, textstats.document_stats(docs(spark, rows), words).collect()))
    held = got()
    monkeypatch.setattr(textstats, "COMMON_BYTES", 0)
    assert got() == held and len(held) == 27


def test_stats_of_a_text():
    s = dict(zip(textstats.STATS, textstats.stats_of("The end.\nx1 % y", {"the", "end"})))
    assert s["n_words"] == 4 and s["n_lines"] == 2 and s["punctuated_lines"] == 0.5 and s["common_share"] == 0.5 and s["digit_word_share"] == 0.25
    assert s["symbol_ratio"] == pytest.approx(2 / 11)
    assert textstats.stats_of(" \n", set()) is None
    assert textstats.stats_of("e\u0301te\u0301", set()) == textstats.stats_of("\xe9t\xe9", set())
    assert dict(zip(textstats.STATS, textstats.stats_of("8QGjGr2Yp9Uwm2zTJRjHrVsk7sXEutGXs6ijzC8L/lA0s9", set())))["odd_ratio"] > 0.1


def test_mixture_recovers_its_parameters(spark):
    """The fit rises to the likelihood of a direct expectation-maximisation step: a further step moves it no more."""
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON)], "lang string, word string, word_rank int")
    stats = textstats.document_stats(docs(spark, corpus(30)), words)
    centre, scale, (w, m, c), names = textstats.fit_mixture(stats, set(COMMON))
    z = (textstats._shape(stats.toPandas()[textstats.FEATURES].to_numpy(float)) - centre) / scale
    p = textstats._posterior(z, (w, m, c))
    assert np.allclose(p.sum(axis=0) / len(z), w, atol=0.02)
    big = p.sum(axis=0) > 10
    assert np.allclose(((p.T @ z) / p.sum(axis=0)[:, None])[big], m[big], atol=0.1)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-6) and "prose" in names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    import duckdb

    df = queries.QUERIES[name](spark, data)
    rows = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        return
    con = duckdb.connect()
    for table in ("documents", "eval_items", "common_words", "mix_targets"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=repr)
