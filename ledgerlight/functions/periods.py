"""Labels of periods, and times from text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that are tried for dates in text, by the order of their parts.
PATTERNS = {
    "day_first": [f"d{s}M{s}{y}{t}" for s in "/-." for y in ("yyyy", "yy") for t in ("", " H:mm", " H:mm:ss")],
    "month_first": [f"M{s}d{s}{y}{t}" for s in "/-." for y in ("yyyy", "yy") for t in ("", " H:mm", " H:mm:ss")],
    "iso": [f"yyyy{s}M{s}d{t}" for s in "-/." for t in ("", " H:mm", " H:mm:ss", "'T'H:mm:ss")],
}


def label(time: Column, grain: str) -> Column:
    """2024-03-09, 2024-W09 (Monday first, 00 before the first Monday), 2024-03, 2024-Q1, 2024; null for null."""
    if grain == "week":
        day = F.to_date(time)
        week = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
        return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    if grain == "quarter":
        return F.concat(F.date_format(time, "yyyy"), F.lit("-Q"), F.quarter(time).cast("string"))
    return F.date_format(time, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain])


def parsed(text: Column, order: str) -> Column:
    """Time that a text gives in an order of day, month and year; null where no pattern fits."""
    clean = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)).cast("timestamp_ntz") for p in PATTERNS["day_first" if order == "ambiguous" else order]], clean.try_cast("timestamp_ntz"))
