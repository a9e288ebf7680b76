"""Times as numbers: units, relative time, decimal years. Timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a time unit in days; a year is 365.25 days.
UNIT_DAYS = {"Y": 365.25, "W": 7.0, "D": 1.0, "h": 1 / 24, "m": 1 / 1440, "min": 1 / 1440, "s": 1 / 86400}
UNIT_MICROS = {k: round(v * 86_400_000_000) for k, v in UNIT_DAYS.items()}
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(t: str) -> Column:
    """Microseconds since 1970-01-01 of column `t`, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, cast(`{t}` as timestamp_ntz))")


def seconds(t: str) -> Column:
    """Whole seconds since 1970-01-01, rounded down."""
    return F.floor(micros(t) / F.lit(1_000_000)).cast("bigint")


def elapsed(t: str, ref: str, unit: str = "D") -> Column:
    """(t - ref) in `unit` as a double; `t` is a column name, `ref` a column name or an ISO literal in quotes."""
    r = f"cast({ref} as timestamp_ntz)" if ref.startswith("'") else f"cast(`{ref}` as timestamp_ntz)"
    us = F.expr(f"timestampdiff(MICROSECOND, {r}, cast(`{t}` as timestamp_ntz))")
    return us.cast("double") / F.lit(float(UNIT_MICROS[unit]))


def decimal_year(t: str) -> Column:
    """2000 + days since 2000-01-01 / 365.25; the time of day does not count."""
    return F.lit(2000.0) + F.datediff(F.col(t), F.lit("2000-01-01").cast("date")) / F.lit(365.25)
