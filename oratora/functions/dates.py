"""Dates from text in several formats, and period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import MONTHS

FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)


def _long_date(c: Column) -> Column:
    """``d monthname yyyy`` with an Italian month, anywhere in the text."""
    pattern = r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, pattern, 2)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", F.regexp_extract(c, pattern, 3), month.cast("string"), F.regexp_extract(c, pattern, 1)), "yyyy-M-d"))


def parse_date(c: Column, formats=FORMATS) -> Column:
    """The first format that fits, then an Italian long date; null if none does."""
    t = F.trim(c)
    english = [F.when(t.rlike(p), F.try_to_date(F.initcap(F.lower(t)) if "MMM" in f else t, f)) for p, f in formats]
    return F.coalesce(*english, _long_date(t))


def parse_month_date(c: Column) -> Column:
    """The first three formats only."""
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in FORMATS[:3]])


def as_date(df, name: str) -> Column:
    """A date column: as it is, or parsed if it is text."""
    kind = dict(df.dtypes)[name]
    return parse_date(F.col(name)) if kind == "string" else F.col(name).cast("date")


def period_key(d: Column, granularity: str = "month") -> Column:
    """``yyyy``, ``yyyy-MM`` or ``yyyy-Www`` (calendar year with the ISO week)."""
    if granularity == "year":
        return F.year(d).cast("string")
    if granularity == "month":
        return F.date_format(d, "yyyy-MM")
    if granularity == "week":
        return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    raise ValueError(f"unknown granularity {granularity!r}")
