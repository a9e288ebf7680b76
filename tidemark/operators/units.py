"""Readings in different units brought to millimetres.

SQL only: number and unit are taken from the text with regexp_extract, the alias is normalised by a join, the
correction in the notes, the unit field, what the numbers themselves say and the default of the source are coalesced,
and factor and offset are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timeunits import seconds
from tidemark.operators.blocks import BLOCK_ROWS, ordered_blocks
from tidemark.session import materialize, sized

#: Spellings of length units (lower case, accents and micro signs folded) and their size in micrometres.
ALIASES = {
    "um": 1.0, "micron": 1.0, "microns": 1.0, "micrometre": 1.0, "micrometres": 1.0, "micrometer": 1.0, "micrometers": 1.0,
    "mm": 1e3, "millimetre": 1e3, "millimetres": 1e3, "millimeter": 1e3, "millimeters": 1e3,
    "cm": 1e4, "centimetre": 1e4, "centimetres": 1e4, "centimeter": 1e4, "centimeters": 1e4,
    "dm": 1e5, "decimetre": 1e5, "decimetres": 1e5, "decimeter": 1e5, "decimeters": 1e5,
    "m": 1e6, "metre": 1e6, "metres": 1e6, "meter": 1e6, "meters": 1e6,
    "km": 1e9, "kilometre": 1e9, "kilometres": 1e9, "kilometer": 1e9, "kilometers": 1e9,
    "in": 25400.0, "inch": 25400.0, "inches": 25400.0,
    "ft": 304800.0, "foot": 304800.0, "feet": 304800.0,
}
#: Words for a fraction before a unit.
FRACTIONS = {"tenths of": "0.1 ", "tenth of": "0.1 ", "hundredths of": "0.01 ", "hundredth of": "0.01 ", "thousandths of": "0.001 ", "thousandth of": "0.001 "}

_NUM = r"10\^-?[0-9]+|[0-9]+/[0-9]+|[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?"
_WORD = "|".join(sorted(ALIASES, key=len, reverse=True))
_UNIT = rf"(?:(?:{_NUM})\s*[*x]?\s*)?(?:{_WORD})(?:\s*\*\s*10\^-?[0-9]+|/10*)?"
#: What introduces a statement about the unit of the numbers. Lengths of other things follow other words.
_CUE = r"(?:unit\s*:|true unit|scale is|given in|written in|recorded as|really in|file is in|treat as|values\s*=|east/north/up|\be n u\b)"
_STATED = rf"{_CUE}\s*[\[(=:]*\s*({_UNIT})(?:[^a-z0-9^]|$)"
_WHOLE = rf"^({_NUM})?\s*[*x]?\s*({_WORD})(?:\s*\*\s*10\^(-?[0-9]+)|/(10*))?$"

#: Standard deviation of good readings from epoch to epoch, in micrometres: one to six millimetres, so that the decade
#: around the geometric mean of the two holds it.
TYPICAL_UM, DECADE = 6**0.5 * 1000, 10**0.5
DATA, VARS, COVS = ["east", "north", "up"], ["east_var", "north_var", "up_var"], ["east_north_cov", "east_up_cov", "north_up_cov"]


def folded(text: Column) -> Column:
    """Lower case, accents and micro signs folded, blanks single, bracket and final points removed."""
    t = F.translate(F.lower(text), "µμèéêàâ", "uueeeaa")
    for words, number in FRACTIONS.items():
        t = F.replace(t, F.lit(words + " "), F.lit(number))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def size_um(unit_text: Column, aliases: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """Add column `name`: the size in micrometres of the unit that `unit_text` as a whole states, else NULL."""
    t = F.trim(F.regexp_replace(folded(unit_text), r"^[\s\[(]+|[\s\]).]+$", ""))
    num = lambda c: (
        F.when(c == "", 1.0)
        .when(c.startswith("10^"), F.pow(F.lit(10.0), F.substring(c, 4, 9).cast("double")))
        .when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1)).cast("double") / F.split_part(c, F.lit("/"), F.lit(2)).cast("double"))
        .otherwise(c.cast("double"))
    )
    get = lambda i: F.regexp_extract("_t", _WHOLE, i)
    scale = num(get(1)) * F.pow(F.lit(10.0), F.coalesce(F.expr(f"try_cast({_sql_get(3)} as double)"), F.lit(0.0))) / F.coalesce(F.expr(f"try_cast({_sql_get(4)} as double)"), F.lit(1.0))
    return (
        df.withColumn("_t", F.coalesce(t, F.lit("")))
        .withColumn("_alias", get(2))
        .withColumn("_scale", F.when(F.col("_t").rlike(_WHOLE), scale))
        .join(F.broadcast(aliases), "_alias", "left")  # the fixed list above
        .withColumn(name, F.col("_um") * F.col("_scale"))
        .drop("_t", "_alias", "_scale", "_um")
    )


def _sql_get(i: int) -> str:
    return f"regexp_extract(_t, r'{_WHOLE}', {i})"


def epoch_scatter(obs: DataFrame, column: str = "east", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per series: series_id, delta, the robust standard deviation of the change from one epoch to the next in the
    series' own unit. Copies of an epoch count once (the first by obs_id), NULL and NaN readings are passed over."""
    x = F.when(~F.isnan(column), F.col(column))
    epochs = (
        obs.select("series_id", "obs_id", seconds("t").alias("sec"), x.alias("x"))
        .filter(F.col("x").isNotNull() & F.col("series_id").isNotNull() & F.col("sec").isNotNull())
        .groupBy("series_id", "sec")
        .agg(F.min_by("x", "obs_id").alias("x"))
    )
    w = Window.partitionBy("series_id", "block").orderBy("sec")
    change = F.abs(F.col("x") - F.lag("x").over(w))
    return (
        ordered_blocks(epochs, "series_id", "sec", counted=obs.select("series_id"), block_rows=block_rows)
        .withColumn("d", change)
        .filter("core and d is not null")
        .groupBy("series_id")
        .agg((F.percentile_approx("d", 0.5, 2000) / F.lit(0.6744897501960817)).alias("delta"))
    )


def decide_units(series: DataFrame, scatter: DataFrame) -> DataFrame:
    """One row per series: series_id, um_per_unit (double), basis ('notes', 'field', 'numbers', 'source' or 'default').

    A statement in the notes is taken if the numbers bear it out, then the unit field if they do; else the numbers
    decide between mm, cm, m and micrometre. Without numbers the notes, then the field count unseen, then the default of the
    source: the unit most of its series have (ties: the smallest); with nothing at all the unit is mm. `series` needs
    series_id, data_unit, notes, and may have src; `scatter` series_id, delta.
    """
    spark = series.sparkSession
    aliases = spark.createDataFrame(list(ALIASES.items()), "_alias string, _um double")
    src = F.col("src") if "src" in series.columns else F.lit(None).cast("string")
    s = series.select("series_id", "data_unit", "notes", src.alias("_src")).filter("series_id is not null").dropDuplicates(["series_id"])
    s = size_um(F.regexp_extract(folded(F.coalesce("notes", F.lit(""))), _STATED, 1), aliases, s, "_notes_um")
    s = size_um(F.col("data_unit"), aliases, s, "_field_um").join(scatter, "series_id", "left")
    fits = lambda um: F.coalesce((F.col("delta") * um / TYPICAL_UM).between(1 / DECADE, DECADE), F.lit(False))
    has = F.coalesce(F.col("delta") > 0, F.lit(False))
    nearest = F.array_min(
        F.array(*[F.struct(F.abs(F.log10(F.col("delta") * um / TYPICAL_UM)).alias("off"), F.lit(um).alias("um")) for um in (1e3, 1e4, 1e6, 1.0)])
    )["um"]
    s = s.withColumn("_said", F.when(has & fits(F.col("_notes_um")), F.col("_notes_um")).when(has & fits(F.col("_field_um")), F.col("_field_um")).when(has, nearest).otherwise(F.coalesce("_notes_um", "_field_um")))
    s = materialize(s, "units")  # a row a series; the scatter below it is not worked out twice
    usual = s.filter("_said is not null and _src is not null").groupBy("_src", "_said").agg(F.count("*").alias("_n")).groupBy("_src").agg(F.max_by("_said", F.struct("_n", -F.col("_said"))).alias("_source_um"))
    s = s.join(sized(usual), "_src", "left")
    return s.select(
        "series_id",
        F.coalesce("_said", "_source_um", F.lit(1e3)).alias("um_per_unit"),
        F.when(has & fits(F.col("_notes_um")), "notes")
        .when(has & fits(F.col("_field_um")), "field")
        .when(has, "numbers")
        .when(F.col("_notes_um").isNotNull(), "notes")
        .when(F.col("_field_um").isNotNull(), "field")
        .when(F.col("_source_um").isNotNull(), "source")
        .otherwise("default")
        .alias("basis"),
    )


def series_units(obs: DataFrame, series: DataFrame) -> DataFrame:
    """The unit of every series, from its notes, its unit field and its numbers. See decide_units."""
    return decide_units(series, epoch_scatter(obs))


def to_millimetres(obs: DataFrame, units: DataFrame) -> DataFrame:
    """`obs` with data columns in mm, variances and covariances in mm². Data take the factor and then the offset of their
    unit (offset_um of `units`, if it has that column; lengths have none), variances and covariances the square of the
    factor. NaN becomes NULL; rows of series that `units` does not know keep their numbers, with um_per_unit NULL. Other
    columns stay."""
    f = F.coalesce(F.col("um_per_unit") / 1000.0, F.lit(1.0))
    shift = F.coalesce(F.col("_offset_um") / 1000.0, F.lit(0.0))
    offset = F.col("offset_um").cast("double") if "offset_um" in units.columns else F.lit(None).cast("double")
    u = units.select("series_id", "um_per_unit", offset.alias("_offset_um"))
    obs = obs.drop("um_per_unit") if "um_per_unit" in obs.columns else obs
    have = [c for c in DATA + VARS + COVS if c in obs.columns]
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    return obs.join(sized(u), "series_id", "left").withColumns({c: value(c) * f + shift if c in DATA else value(c) * (f * f) for c in have}).drop("_offset_um")
