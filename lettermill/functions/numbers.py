"""Dates, rounding, confidence and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.config import DAY_MS


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def header_date(value: Column) -> Column:
    """A mail date header; null if it isn't one."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def imap_date(ts: Column) -> Column:
    return F.date_format(ts, "dd-MMM-yyyy")


def age_days(as_of: Column, ts: Column) -> Column:
    return (F.unix_millis(as_of) - F.unix_millis(ts)) / float(DAY_MS)


def clamp01(x: Column) -> Column:
    """A confidence from free text: between 0 and 1, 0.5 if it is no number."""
    n = x.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def share(part: Column, whole: Column) -> Column:
    """part / whole; null if whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def money(usd: Column) -> Column:
    return F.when(usd.isNull() | (usd == 0), "$0.00").when(usd < 0.01, F.format_string("$%.4f", usd)).otherwise(F.format_string("$%.2f", usd))


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))
