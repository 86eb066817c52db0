"""Citations in running text: extraction, guards, and the patterns by which a document spells them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .ids import base
from .values import any_match, let

#: Case matters: the verb is never a designation. Phrases such as "relevant IS" name nothing.
#: The first look ahead keeps what looks behind from being tried at every character of a text.
CITATION = "(?=IS)" + fixed.GENERIC + fixed.CITATION


def unglued(run: Column, most: int = fixed.MOST_DIGITS) -> Column:
    """The number in a run of digits, which may have a year stuck to it above ``most``; empty if it can't be read."""
    return F.when(F.char_length(run) <= most, run).otherwise(F.regexp_extract(run, fixed.GLUED, 1))


def extract(text: Column, most: int = fixed.MOST_DIGITS) -> Column:
    """Citations in order, each once: spellings of one part reference count as one, and the first is kept.

    most: digits of the longest number there can be."""
    numbers = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    brackets = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    found = F.zip_with(numbers, brackets, lambda n, p: F.struct(unglued(n, most).alias("n"), F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " ")).alias("p")))
    keyed = F.transform(F.filter(found, lambda x: x["n"] != ""), lambda x: F.struct(F.concat(x["n"], F.lit("|"), F.regexp_replace(F.lower(x["p"]), "[^a-z0-9]", "")).alias("k"), F.when(x["p"] == "", F.concat(F.lit("IS "), x["n"])).otherwise(F.concat(F.lit("IS "), x["n"], F.lit(" ("), x["p"], F.lit(")"))).alias("c")))
    # one pass over a map of what was seen: the first spelling of each key stays
    firsts = F.aggregate(F.coalesce(keyed, F.array().cast("array<struct<k:string,c:string>>")), F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("c")), lambda s, x: F.when(F.array_contains(s["k"], x["k"]), s).otherwise(F.struct(F.array_append(s["k"], x["k"]).alias("k"), F.array_append(s["c"], x["c"]).alias("c"))))
    return firsts["c"]


def bases(text: Column, most: int = fixed.MOST_DIGITS) -> Column:
    """Citations by their numbers alone, in order and once each: what stands in a bracket behind a number is not read."""
    return F.array_distinct(F.transform(extract(text, most), base))


def demands_mark(text: Column) -> Column:
    """Whether the mark is asked for. Patterns are tried only on texts that have a word which they can't do without."""
    low = F.lower(text)
    tests = [F.contains(low, F.lit(word)) & any_match(text, [p]) for word, p in zip(fixed.MARK_WORDS, fixed.MARK, strict=True)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def foreign(text: Column, most: int = 12) -> Column:
    """Foreign designations, white space collapsed, in order and once each."""
    found = F.transform(F.regexp_extract_all(text, F.lit(fixed.FOREIGN), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_distinct(found), 1, most)


def leaked(text: Column, allowed: Column, years: Column | None = None) -> Column:
    """Designations in the text that aren't allowed, or whose stated year isn't the known one.

    allowed: array of designations. years: map of digits to the year on record.
    """
    bases = F.transform(allowed, lambda a: F.regexp_replace(F.substring_index(a, "(", 1), "[^0-9]", ""))
    numbers, stated = F.regexp_extract_all(text, F.lit(fixed.LOOSE), F.lit(1)), F.regexp_extract_all(text, F.lit(fixed.LOOSE), F.lit(2))
    found = F.zip_with(numbers, stated, lambda n, y: F.struct(n.alias("n"), y.alias("y")))
    wrong_year = lambda x: F.lit(False) if years is None else (F.coalesce(x["y"], F.lit("")) != "") & F.coalesce(F.element_at(years, x["n"]) != x["y"], F.lit(False))
    bad = lambda b: F.filter(found, lambda x: ~F.array_contains(b, x["n"]) | wrong_year(x))
    said = lambda b, x: F.when(~F.array_contains(b, x["n"]), F.concat(F.lit("IS "), x["n"])).otherwise(F.concat(F.lit("IS "), x["n"], F.lit(":"), x["y"]))
    return let(bases, lambda b: F.transform(bad(b), lambda x: said(b, x)))


def replace_citation(text: Column, old: Column, new: Column) -> Column:
    """Every spelling of ``old``, with or without an edition year, becomes ``new``."""
    tail = F.trim(F.regexp_replace(old, r"^IS[:\s]*", ""))
    quoted = F.concat(F.lit(r"\Q"), tail, F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z])IS[:\s]*"), quoted, F.lit(r"(?!\d)(?:\s*[:\-]\s*\d{4})?"))
    return F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def replace_exact(text: Column, old: Column, new: Column) -> Column:
    """``old`` as it is spelled, with no digit behind it, becomes ``new``; what follows is never read as its edition year."""
    pattern = F.concat(F.lit(r"(?=IS)(?<![A-Za-z])\Q"), old, F.lit(r"\E(?!\d)"))
    return F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def occurrences(text: Column, citation: Column) -> Column:
    """How often a citation occurs in the text, in any spelling of its spaces."""
    tail = F.trim(F.regexp_replace(citation, r"^IS[:\s]*", ""))
    return F.regexp_count(text, F.concat(F.lit(r"(?i)(?<![A-Za-z])IS[:\s]*\Q"), tail, F.lit(r"\E(?!\d)")))


def marked(texts: DataFrame, key: str, text: str, cites: DataFrame) -> DataFrame:
    """One row for each text: its citations found in it by their status (withdrawn, superseded, current, unresolved), and
    those that do not occur in it. cites: key, cite, status."""
    hit = occurrences(F.col(text), F.col("cite")) > 0
    c = texts.select(key, text).join(cites, key).select(key, "cite", F.coalesce("status", F.lit("unresolved")).alias("status"), hit.alias("hit"))
    n = lambda s: F.count_if(F.col("hit") & (F.lower("status") == s)).alias(s)
    return c.groupBy(key).agg(*[n(s) for s in ("withdrawn", "superseded", "current", "unresolved")], F.array_sort(F.collect_set(F.when(~F.col("hit"), F.col("cite")))).alias("missing"))


def cut_short(shown: Column, reference: Column) -> Column:
    """Whether a trimmed notification stops inside a word of its reference: what it forbids is the silent cut."""
    raw = F.trim(F.regexp_replace(F.coalesce(reference, F.lit("")), r"\s+", " "))
    after = F.substring(raw, F.position(shown, raw) + F.char_length(shown), F.lit(1))
    return (shown != "") & ~F.endswith(shown, F.lit("…")) & (F.position(shown, raw) > 0) & F.coalesce(after.rlike("[A-Za-z0-9/-]"), F.lit(False))


def notification(reference: Column) -> Column:
    """The first order of a running history: list number off, amendments cut, ended at its own date, bounded in length."""
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[ ,;]+", ""), r"[ ,;]+$", "")
    most = fixed.NOTIFICATION_CHARS
    dated = r"(?i)^(.*?\bdated\s+\d{1,2}\s*(?:[-/.]\s*\d{1,2}\s*[-/.]\s*\d{2,4}|(?:st|nd|rd|th)?\s*(?:" + fixed.MONTH + r")\.?,?\s*\d{2,4}))"
    by_word = lambda cut: let(F.regexp_extract(cut, r"^(.*) ", 1), lambda w: F.when(F.char_length(w) > most // 2, w).otherwise(cut))
    bounded = lambda h: F.when(F.char_length(h) > most, F.concat(trimmed(by_word(F.substring(h, 1, most))), F.lit(" …"))).otherwise(h)
    missing = lambda h: F.char_length(F.regexp_replace(h, r"[^(]", "")) - F.char_length(F.regexp_replace(h, r"[^)]", ""))
    closed = lambda h: F.concat(h, F.repeat(F.lit(")"), F.greatest(missing(h), F.lit(0))))

    def of(text: Column) -> Column:
        first = trimmed(F.regexp_replace(F.regexp_replace(text, r"^\d+\.\s*", ""), f"(?s){fixed.ORDER_TAIL}.*$", ""))
        head = let(first, lambda h: F.coalesce(F.nullif(F.regexp_extract(h, dated, 1), F.lit("")), h))
        return F.when(F.upper(text).isin("", "N/A"), "").otherwise(let(let(head, lambda h: trimmed(bounded(h))), closed))

    return let(F.trim(F.regexp_replace(F.coalesce(reference, F.lit("")), r"\s+", " ")), of)
