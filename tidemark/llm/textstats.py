"""Text statistics of each document, and prose told from lists, tables and junk.

The statistics are standardised over all documents and a Gaussian mixture is fitted to them by expectation-maximisation:
each round every partition sums its responsibilities, and only those sums come to the driver. The components start at
the inspected examples below and take their names from them after the fit: prose, list, table or junk. The likelier name
is a document's label.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

STATS = ["n_words", "n_lines", "mean_word_length", "symbol_ratio", "odd_ratio", "digit_word_share", "punctuated_lines", "words_per_line", "common_share", "running_share"]
SCHEMA = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS)
FEATURES = ["mean_word_length", "symbol_ratio", "odd_ratio", "digit_word_share", "punctuated_lines", "words_per_line", "common_share", "running_share"]
#: Words on either side over which a word's share of common words is taken; from RUNNING up it stands in running text.
REACH, RUNNING = 6, 0.2
ROUNDS, FLOOR = 25, 0.02
#: Bytes of common words up to which every task holds the list; a longer one is joined to the words of the documents.
COMMON_BYTES = 16 << 20

#: Inspected examples: what each component starts from and is named by (the name before the colon).
EXAMPLES = [
    ("prose", "She put the kettle on because her guests were cold. After an hour all of them had gone to sleep, and nobody saw that it was snowing."),
    ("prose", "Ich habe den Kuchen gebacken, und die Kinder haben ihn schon gegessen; das war nicht anders zu erwarten.\nMorgen gibt es noch einen, wenn wir Mehl haben."),
    ("prose", "Nous avons mangé les cerises que ma tante nous avait données, mais il en reste encore dans le panier. Elle en apportera d'autres avec du pain."),
    ("prose", "Mi abuela hace el pan por la noche y lo vende cuando sale el sol.\nNo se sabe si la harina que compra es de aquí o de fuera."),
    ("prose", "He did not think that the soup would be ready\nbefore they were all at the table, but it was, and\nthere was even more of it than they could eat."),
    ("list", "- apples\n- flour\n- sugar\n- butter\n- raisins\n- yeast"),
    ("list", "1) spoon / fork (85)\n2) knife / bowl (263)\n3) saucer / jug (711)\n4) ladle / sieve (12)"),
    ("list", "zum Backen (Teil 2):\n• Mehl\n• Hefe.\n• Salz\n• Milch;\n• Zimt"),
    ("list", "Account\nShop\nBasket\nCheckout\nSizes\nReturns\nAbout\nImprint\nNewsletter\nUp"),
    ("table", "| fruit | kilos | price |\n| --- | --- | --- |\n| plums | 54.9 | 639.140 |\n| pears | n/a | 281.54 |\n| limes | -89 | 12.3 |"),
    ("table", "fruit,kilos,price\nplums,0.118,350.0\npears,744.06,n/a\nlimes,703.4,770.2"),
    ("table", "Cake\tEggs\tMilk\nsponge\t392\t577\nfruit\tn/a\t25.8\nlemon\t596.05\t459.3"),
    ("junk: symbols", "]~#k{8;&^v}w==@!<?o0/+%$>q_|\\[*z7&&(x^]:{0~#}!=b"),
    ("junk: symbols", "$/4@@u{*}<+=_|q>9~&!^%[x.#]?;o\\k=$8 {_!+/h#}=@w"),
    ("junk: broken", "Elle ÃÂ a maÂngé leÃs cerÂ�iseŸs © avant ¼d'alÐleÑr auÃ mŸarchÃ©; ™il enÂ r€estÃ©ait"),
    ("junk: broken", "Der KÂuchÐen wÃar noc¼h waÂrm, als Ã¤lÑle gi™ngen ©und dÃ€ie TÂürÃ Ÿoffen bl¼ieb �"),
]

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s[^<>]{0,200})?/?>")
_END = re.compile(r"[.!?;:…][\"'»”’)\]]*\s*$")
_FLIP = re.compile("(?<=[a-z\u00e0-\u00ff])[A-Z\u00c0-\u00de\u0178-\u017f\u0400-\u04ff]")
#: Characters of ordinary writing and markup beside letters, digits and white space.
PLAIN = set(".,;:!?'\"()[]-–—«»„“”‘’…¿¡/&%*_#•·|°`")


def words_of(text: str) -> tuple[list[str], str, str]:
    """The words of a text in lower case, the text without invisible characters, and that without markup tags."""
    text = text.replace("\xad", "").replace("\u200b", "")
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)  # an accent apart from its letter is no odd character
    plain = _TAG.sub(" ", text) if "<" in text else text
    return _WORD.findall(plain.lower()), text, plain


def stats_of(text: str, common: set[str]) -> tuple[float, ...] | None:
    """The STATS of one text, or None if it holds nothing but blanks."""
    ws, text, plain = words_of(text)
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    n = len(ws)
    solid = sum(len(x) for x in text.split())
    symbols = [c for c in plain if not (c.isalnum() or c.isspace())]
    # symbols outside ordinary writing, and capitals right after small letters
    odd = sum(c not in PLAIN for c in symbols) + len(_FLIP.findall(plain))
    hit = np.array([len(w) > 1 and w in common for w in ws], float)
    if n:
        cum = np.concatenate([[0], np.cumsum(hit)])
        i = np.arange(n)
        a, b = np.maximum(0, i - REACH), np.minimum(n, i + REACH + 1)
        running = float(((cum[b] - cum[a]) / (b - a) >= RUNNING).mean())
    return (
        float(n),
        float(len(lines)),
        sum(map(len, ws)) / n if n else 0.0,
        len(symbols) / solid,
        odd / solid,
        sum(any(c.isdigit() for c in w) for w in ws) / n if n else 0.0,
        sum(bool(_END.search(x)) for x in lines) / len(lines),
        n / len(lines),
        float(hit.mean()) if n else 0.0,
        running if n else 0.0,
    )


def _word_list(common_words: DataFrame) -> DataFrame:
    return common_words.select(F.lower("word").alias("word")).filter("word is not null").distinct()


def document_stats(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and STATS of every document; a text that is NULL or blank gives no row, a repeated row one for each. Common
    words of all languages count, since language tags err. A word list beyond COMMON_BYTES is joined to the words of the
    documents instead of being held by every task; the statistics are the same."""
    texts = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    words = _word_list(common_words)
    size = words.agg(F.sum(F.octet_length("word") + 60).alias("n")).first()["n"] or 0
    if size <= COMMON_BYTES:
        common = {r[0] for r in words.collect()}
        held = texts
    else:
        common = None

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                pairs = [(d, w) for d, t in zip(pdf["doc_id"], pdf["text"]) for w in set(words_of(t)[0])]
                yield pd.DataFrame(pairs, columns=["doc_id", "word"]).astype({"doc_id": "int64"})

        own = texts.mapInPandas(split, "doc_id bigint, word string").join(words, "word").groupBy("doc_id").agg(F.collect_set("word").alias("common"))
        held = texts.join(own, "doc_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            known = [common] * len(pdf) if common is not None else [set() if w is None else set(w) for w in pdf["common"]]
            rows = [(d, *s) for d, t, c in zip(pdf["doc_id"], pdf["text"], known) if t and (s := stats_of(t, c))]
            yield pd.DataFrame(rows, columns=["doc_id", *STATS]).astype({"doc_id": "int64"} | {s: float for s in STATS})

    return held.mapInPandas(run, SCHEMA)


def _shape(f: np.ndarray) -> np.ndarray:
    """FEATURES on scales on which they are nearer to normal."""
    f = f.copy()
    for name in ("symbol_ratio", "odd_ratio"):
        k = FEATURES.index(name)
        f[:, k] = np.sqrt(f[:, k])
    for name in ("mean_word_length", "words_per_line"):
        k = FEATURES.index(name)
        f[:, k] = np.log1p(np.minimum(f[:, k], 1e6))
    return f


def _log_density(z: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(z), len(weight)))
    for k in range(len(weight)):
        chol = np.linalg.cholesky(cov[k])
        y = np.linalg.solve(chol, (z - mean[k]).T)
        out[:, k] = np.log(weight[k]) - np.log(np.diag(chol)).sum() - 0.5 * (y * y).sum(axis=0)
    return out


def _posterior(z: np.ndarray, model: tuple) -> np.ndarray:
    p = _log_density(z, *model)
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_mixture(stats: DataFrame, common: set[str]) -> tuple[np.ndarray, np.ndarray, tuple, list[str]]:
    """(centre, scale, (weights, means, covariances), names) of the mixture fitted to all rows of `stats`."""
    d = len(FEATURES)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, d))
        for pdf in frames:
            f = _shape(pdf[FEATURES].to_numpy(float))
            total += [np.full(d, len(f)), f.sum(0), (f * f).sum(0)]
        yield pd.DataFrame({"k": np.arange(3 * d), "v": total.ravel()})

    def gathered(df: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in df.groupBy("k").agg(F.sum("v").alias("v")).collect():  # `size` numbers
            out[r["k"]] = r["v"]
        return out

    n, s, q = gathered(stats.mapInPandas(moments, "k int, v double"), 3 * d).reshape(3, d)
    centre = s / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(q / np.maximum(n, 1) - centre**2, 1e-6))
    names = list(dict.fromkeys(label for label, _ in EXAMPLES))
    shown = np.array([[dict(zip(STATS, stats_of(t, common)))[f] for f in FEATURES] for _, t in EXAMPLES])
    seen = (_shape(shown) - centre) / scale
    of = np.array([names.index(label) for label, _ in EXAMPLES])
    k = len(names)
    model = (np.full(k, 1 / k), np.array([seen[of == j].mean(axis=0) for j in range(k)]), np.array([np.eye(d) * 0.5] * k))

    def expect(model: tuple):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, m, c, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
            for pdf in frames:
                if not len(pdf):
                    continue
                z = (_shape(pdf[FEATURES].to_numpy(float)) - centre) / scale
                dens = _log_density(z, *model)
                top = dens.max(axis=1, keepdims=True)
                ll += float((top[:, 0] + np.log(np.exp(dens - top).sum(axis=1))).sum())
                p = _posterior(z, model)
                w += p.sum(axis=0)
                m += p.T @ z
                for j in range(k):
                    c[j] += (z * p[:, j : j + 1]).T @ z
            v = np.concatenate([w, m.ravel(), c.ravel(), [ll]])
            yield pd.DataFrame({"k": np.arange(len(v)), "v": v})

        return run

    last = -np.inf
    for _ in range(ROUNDS if n[0] else 0):
        size = k + k * d + k * d * d + 1
        v = gathered(stats.mapInPandas(expect(model), "k int, v double"), size)
        w, m, c, ll = v[:k], v[k : k + k * d].reshape(k, d), v[k + k * d : -1].reshape(k, d, d), v[-1]
        # each component keeps the pull of two rows at its start, so that none dies out
        w2 = w + 2.0
        mean = (m + 2.0 * model[1]) / w2[:, None]
        cov = (c + 2.0 * (model[2] + model[1][:, :, None] * model[1][:, None, :])) / w2[:, None, None] - mean[:, :, None] * mean[:, None, :]
        model = (w2 / w2.sum(), mean, cov + FLOOR * np.eye(d))
        if abs(ll - last) <= 1e-5 * abs(ll):
            break
        last = ll
    post = _posterior(seen, model)
    vote = np.array([[post[of == j, comp].sum() for j in range(k)] for comp in range(k)])
    named = [names[int(vote[comp].argmax())] if vote[comp].sum() > 0.5 else names[comp] for comp in range(k)]
    return centre, scale, model, [x.split(":")[0] for x in named]


def classify_documents(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, STATS, label ('prose', 'list', 'table' or 'junk') and sure (the mixture's probability of prose or of not
    prose, whichever is larger). The label is the name of the components that together are likeliest, prose against the
    rest first. A NULL or blank text gives no row; an empty table gives an empty one."""
    stats = materialize(document_stats(documents, common_words), "textstats")
    shown = sorted({w for _, t in EXAMPLES for w in words_of(t)[0]})
    common = {r[0] for r in _word_list(common_words).filter(F.col("word").isin(shown)).collect()}  # words of the examples
    centre, scale, model, named = fit_mixture(stats, common)
    names = ["prose", *dict.fromkeys(x for x in named if x != "prose")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            p = _posterior((_shape(pdf[FEATURES].to_numpy(float)) - centre) / scale, model)
            by_name = np.column_stack([p[:, [x == n for x in named]].sum(axis=1) for n in names])
            good = by_name[:, 0]
            other = by_name[:, 1:].argmax(axis=1) + 1 if len(names) > 1 else np.zeros(len(p), int)
            out = pdf.copy()
            out["label"] = np.array(names, object)[np.where(good > 0.5, 0, other)]
            out["sure"] = np.maximum(good, 1 - good)
            yield out

    return stats.mapInPandas(run, SCHEMA + ", label string, sure double")
