"""Designations: the keys that tie spellings of one register entry together. Column to Column throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def base_with_year(c: Column) -> Column:
    """Up to the first bracket, trimmed; a year stays."""
    return F.trim(F.substring_index(c, "(", 1))


def base(c: Column) -> Column:
    """Up to the first bracket or colon, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)[(:].*$", ""), r"\s+", " "))


def digits(c: Column) -> Column:
    """All digits of the base, leading zeros kept."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)[(:].*$", ""), "[^0-9]", "")


def number(c: Column, most: int = fixed.MOST_DIGITS) -> Column:
    """The number of a well-formed designation without leading zeros; empty for anything else, and above ``most`` digits.

    A second designation, part words, the edition year and footnote marks are taken off first.
    """
    head = F.substring_index(c, "(", 1)
    head = F.regexp_replace(head, r"(?i)(?<=\d)" + fixed.DUAL, "")
    for pattern in (fixed.TRAILING_PART, fixed.EDITION, fixed.TRAILING_JUNK):
        head = F.regexp_replace(head, pattern, "")
    return F.coalesce(F.regexp_extract(head, r"(?i)^\s*" + fixed.PREFIX + r"\s*[:\s]?\s*0*(\d{1," + str(most) + r"})\s*$", 1), F.lit(""))


def parts(c: Column) -> Column:
    """Part and section tokens in order, lower-cased, joined by spaces."""
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(fixed.PART_TOKEN), F.lit(1)).alias("p"), F.regexp_extract_all(c, F.lit(fixed.PART_TOKEN), F.lit(2)).alias("s"))
    return F.array_join(F.transform(both, lambda x: F.lower(F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["s"], F.lit(""))))), " ")


def designation(c: Column) -> Column:
    """Number and parts together: two records are of one standard only if both agree."""
    return F.struct(digits(c).alias("digits"), parts(c).alias("parts"))


def evaluation_base(c: Column) -> Column:
    """A lenient key for scoring answers: no bracket, no trailing year, plain letters and digits."""
    head = F.regexp_replace(F.lower(F.substring_index(c, "(", 1)), r"[:\s-]*(19|20)\d{2}\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(head, "[^0-9a-z ]", ""), r"\s+", " "))


def same_entry(a: Column, b: Column) -> Column:
    """Equal bases ignoring case, or equal numbers that aren't empty."""
    return F.coalesce((F.upper(base(a)) == F.upper(base(b))) | ((digits(a) != "") & (digits(a) == digits(b))), F.lit(False))


def year_in(c: Column, default: str = "unknown") -> Column:
    """The first stand-alone year from 2000 on."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\b(20\d{2})\b", 1), F.lit("")), F.lit(default))


def split_year(c: Column) -> Column:
    """(number, year) of a designation that ends in a colon and a year; the year is null without one."""
    year = F.nullif(F.regexp_extract(c, r":\s*(\d{4})\s*$", 1), F.lit(""))
    return F.struct(F.trim(F.regexp_replace(c, r"\s*:\s*\d{4}\s*$", "")).alias("number"), year.cast("int").alias("year"))


def variants(c: Column) -> Column:
    """Spellings to try, in order and once each: as is, Arabic part numbers, and the second prefix for adopted texts."""
    arabic = c
    for roman, digit in sorted(fixed.ROMAN.items(), key=lambda x: -len(x[0])):
        arabic = F.regexp_replace(arabic, rf"(?i)\b(part|sec(?:tion)?)[\s.-]*{roman}\b", f"$1 {digit}")
    both = F.array_distinct(F.array(c, arabic))
    adopted = F.transform(both, lambda x: F.regexp_replace(x, r"(?i)^IS\b", "IS/IEC"))
    return F.array_distinct(F.when(F.coalesce(digits(c).try_cast("long"), F.lit(0)) >= fixed.ADOPTED_FROM, F.concat(both, adopted)).otherwise(both))


def edit_neighbours(c: Column) -> Column:
    """The text, and the text without each of its characters: two texts one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c))))
    return F.array_distinct(F.concat(F.array(c), cut))


def one_edit_apart(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution, or swap of neighbours."""
    n = F.char_length(a)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swapped = F.exists(places, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((n == F.char_length(b)) & (n >= 2) & swapped))
