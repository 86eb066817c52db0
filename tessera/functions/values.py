"""Null rules and small value rules, in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_null(c: Column) -> Column:
    """Null for null, blank, and the words that stand for a missing value; else the trimmed text."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(fixed.BLANK), t)


def listed(c: Column, sep: str = ";") -> Column:
    """The non-empty, trimmed members of a separated list; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def any_match(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """Whether any pattern occurs; null text has none."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(c.rlike(flag + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No")


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage; 0 where there is nothing to share."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, places))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def decade(year: Column) -> Column:
    """The decade of a year as text; "Unknown" for what is not a year."""
    y = year.cast("string").try_cast("double")
    return F.when(y.isNull(), "Unknown").otherwise((F.floor(y / 10) * 10).cast("int").cast("string"))


def band(score: Column) -> Column:
    return F.when(score >= fixed.HIGH_BAND, "High").when(score >= fixed.MEDIUM_BAND, "Medium").otherwise("Low")


def is_dead(status: Column) -> Column:
    return F.coalesce(status.isin(fixed.DEAD), F.lit(False))


def has_citations(c: Column) -> Column:
    return clean_null(c).isNotNull()


def in_evidence(usability: Column, citations: Column, population: list[str] = fixed.EVIDENCE) -> Column:
    """The one definition of a population: readable documents that cite something."""
    return F.coalesce(usability.isin(population), F.lit(False)) & has_citations(citations)
