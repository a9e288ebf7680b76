"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leakage, mixing, textstats


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they leak."""
    return leakage.leaked_passages(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each document and item, and where it is."""
    return leakage.leaked_passages(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that leak nothing."""
    docs = _table(spark, d, "documents")
    return leakage.without_leaks(docs, leakage.leaked_passages(docs, _table(spark, d, "eval_items"))).select("doc_id", "source", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Target sources that fall short."""
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1].filter("falls_short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p7_on_target(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mix holds each source's target tokens to within a document of middling size."""
    report = mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]
    return report.select("source", F.coalesce(F.abs(F.col("used_tokens") - F.col("target_tokens")) <= F.try_divide(F.col("tokens"), F.col("documents")), F.lit(False)).alias("met"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not prose."""
    return textstats.classify_documents(_table(spark, d, "documents"), _table(spark, d, "common_words")).filter("label <> 'prose'").select("doc_id").distinct()


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and lines of each document."""
    stats = textstats.document_stats(_table(spark, d, "documents"), _table(spark, d, "common_words"))
    return stats.select("doc_id", "n_words", "n_lines", F.round("digit_word_share", 6).alias("digit_word_share"), F.round("common_share", 6).alias("common_share"))


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Text statistics and label of each document."""
    return textstats.classify_documents(_table(spark, d, "documents"), _table(spark, d, "common_words"))


QUERIES = {f.__name__: f for f in (p6_found, p6_matches, p6_clean, p7_found, p7_report, p7_on_target, p7_copies, p8_found, p8_counts, p8_stats)}

_TAGS = r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s[^<>]{0,200})?/?>"
_HIDDEN = r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"


def _grams(key: str, text: str, table: str, place: str = "") -> str:
    words = f"regexp_extract_all(regexp_replace(regexp_replace(replace(lower(strip_accents({text})), 'ß', 'ss'), '{_HIDDEN}', '', 'g'), '{_TAGS}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    more = f", i - 1 as {place}" if place else ""
    return f"select {key}{more}, array_to_string(w[i : i + 9], ' ') as gram from (select {key}, w, unnest(range(1, len(w) - 8)) as i from (select {key}, {words} as w from {table} where {key} is not null and {text} is not null))"


_LEAKS = f"select distinct doc_id, item_id from ({_grams('doc_id', 'text', 'documents')}) d join ({_grams('item_id', 'passage', 'eval_items')}) i using (gram)"
_PLAIN = f"regexp_replace(nfc_normalize(replace(replace(text, '­', ''), '​', '')), '{_TAGS}', ' ', 'g')"
_WORDS = r"regexp_extract_all(lower(" + _PLAIN + r"), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"

# successive matches of ten words on one diagonal are one match
_MATCHES = f"""with h as (select distinct doc_id, item_id, a, b from ({_grams('doc_id', 'text', 'documents', 'a')}) d join ({_grams('item_id', 'passage', 'eval_items', 'b')}) i using (gram)),
g as (select *, a - row_number() over (partition by doc_id, item_id, a - b order by a) as run from h),
m as (select doc_id, item_id, min(a) as doc_word, min(b) as item_word, count(*) + 9 as words from g group by doc_id, item_id, a - b, run)
select doc_id, item_id, cast(words as integer) as words, cast(doc_word as integer) as doc_word, cast(item_word as integer) as item_word from m
qualify row_number() over (partition by doc_id, item_id order by words desc, doc_word, item_word) = 1"""
_FALLS_SHORT = """s as (select t.source, any_value(target_share) as share, any_value(max_repeat) as most, coalesce(sum(length(text)), 0) as size
  from mix_targets t left join documents d on d.source = t.source where t.source is not null group by t.source),
f as (select source, share * (select sum(size) from s) > most * size as short from s)"""
# bounds on three statistics, which split these documents like the mixture does
_NOT_PROSE = f"""with t as (select doc_id, nfc_normalize(replace(replace(text, '­', ''), '​', '')) as text from documents where doc_id is not null and text is not null),
p as (select doc_id, regexp_replace(text, '{_TAGS}', ' ', 'g') as plain, length(regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g')) as solid from t),
q as (select doc_id, solid, len(regexp_extract_all(plain, '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}.,;:!?''"()\\[\\]\\-–—«»„“”‘’…¿¡/&%*_#•·|°`]')) + len(regexp_extract_all(plain, '[a-zà-ÿ][A-ZÀ-ÞŸ-ſЀ-ӿ]')) as odd, regexp_extract_all(lower(plain), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*') as w from p where solid > 0),
x as (select doc_id, w, unnest(w) as word, generate_subscripts(w, 1) as i from q),
h as (select doc_id, i, length(word) as chars, case when length(word) > 1 and exists (select 1 from common_words c where lower(c.word) = x.word) then 1.0 else 0.0 end as hit from x),
r as (select doc_id, chars, avg(hit) over (partition by doc_id order by i rows between 6 preceding and 6 following) >= 0.2 as runs from h),
s as (select doc_id, avg(case when runs then 1.0 else 0 end) as running, avg(chars) as mean_chars from r group by doc_id)
select distinct doc_id from q left join s using (doc_id) where not coalesce(running > 0.5 and odd / solid < 0.03 and mean_chars < 14, false)"""

#: Where SQL can tell the rows. Matches, rates and labels are tested against brute force (tests/llm).
SQL: dict[str, str] = {
    "p6_found": _LEAKS,
    "p6_clean": f"select doc_id, source, text from documents d where not exists (select 1 from ({_LEAKS}) l where l.doc_id = d.doc_id)",
    # any usual measure of size gives the same sources
    "p7_found": f"with {_FALLS_SHORT} select source from f where short",
    "p7_on_target": f"with {_FALLS_SHORT} select source, not short as met from f",
    "p6_matches": _MATCHES,
    "p8_found": _NOT_PROSE,
    "p8_counts": f"""with w as (select doc_id, {_WORDS} as w, len(list_filter(string_split(replace(replace(text, '­', ''), '​', ''), e'\\n'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))) as n_lines from documents where doc_id is not null and text is not null),
c as (select list(distinct lower(word)) as c from common_words where word is not null)
select doc_id, len(w)::double as n_words, n_lines::double as n_lines, round(case when len(w) > 0 then len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / len(w) else 0.0 end, 6) as digit_word_share,
  round(case when len(w) > 0 then len(list_filter(w, lambda x: length(x) > 1 and list_contains(c, x))) / len(w) else 0.0 end, 6) as common_share from w, c where n_lines > 0""",
}
