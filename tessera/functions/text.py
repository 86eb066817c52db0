"""Text functions: tokens, clipping, expansion, scripts, sentences, placeholders, HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .values import let


def tokens(c: Column) -> Column:
    """Runs of a-z and digits in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def script_tokens(c: Column) -> Column:
    """Tokens that keep runs of Devanagari whole."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[ऀ-ॿ]+|[a-z0-9]+"), F.lit(0))


def clip(c: Column, most: int = fixed.QUERY_CHARS) -> Column:
    """Trimmed and cut to ``most`` characters, back to the last sentence or line end if that keeps over 60 %."""
    text = F.trim(F.coalesce(c, F.lit("")))
    head = F.substring(text, 1, most)
    cut = F.greatest(F.char_length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1)) + F.when(head.contains(". "), 0).otherwise(-1), F.char_length(F.regexp_extract(head, r"(?s)^(.*)\n", 1)) + F.when(head.contains("\n"), 0).otherwise(-1))
    return F.when(F.char_length(text) <= most, text).otherwise(F.trim(F.when(cut > most * 0.6, F.substring(head, F.lit(1), cut + 1)).otherwise(head)))


def expansions(c: Column) -> Column:
    """What a query's abbreviations and phrases add, in rule order and once each."""
    fence = lambda w: rf"(?<![A-Za-z0-9]){re.escape(w)}(?![A-Za-z0-9])"
    rules = [("(?i)" + fence(k), v) for k, v in fixed.EXPANSIONS.items()] + [(fence(k), v) for k, v in fixed.STRICT_EXPANSIONS.items()] + [("(?i)" + k, v) for k, v in fixed.PHRASES.items()]
    text = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules]), lambda x: x.isNotNull()))


def expand(c: Column) -> Column:
    """The query with its expansions appended; never anything replaced."""
    return F.concat_ws(" ", F.coalesce(c, F.lit("")), F.array_join(F.nullif(expansions(c), F.array().cast("array<string>")), " "))


def useful(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t.isin(fixed.STOP_TERMS) & ~t.rlike("^[0-9]+$") & (F.char_length(t) > 2))


def shared_terms(query: Column, field: Column) -> Column:
    """Terms that query and field have in common, sorted, without those that justify nothing."""
    return F.array_sort(useful(F.array_distinct(F.array_intersect(tokens(query), tokens(field)))))


def script(c: Column) -> Column:
    """The script with the most characters, if it has two at least; the first in order on a tie; else null."""
    counts = [F.struct(F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[{block}]")).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, block) in enumerate(fixed.SCRIPTS.items())]
    best = F.greatest(*counts)
    return F.when(best["n"] >= 2, best["code"])


def sentences(c: Column) -> Column:
    return F.split(c, fixed.SENTENCE_END)


def protected(c: Column) -> Column:
    """Fragments that a translation must not touch, in order."""
    return F.regexp_extract_all(c, F.lit(fixed.PROTECTED), F.lit(0))


def masked(c: Column) -> Column:
    """The text with its protected fragments, in turn, as slots {0}, {1} and so on."""
    pieces = F.split(F.regexp_replace(c, fixed.PROTECTED, "\u0001"), "\u0001")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{"), (i - 1).cast("string"), F.lit("}"), p))), "")


def restored(c: Column, kept: Column) -> Column:
    """Slots filled in; null if a slot is missing, doubled or unknown, so that nothing is lost in silence."""
    slots = F.transform(F.regexp_extract_all(c, F.lit(r"\{(\d+)\}"), F.lit(1)), lambda s: s.cast("int"))
    whole = lambda x: F.array_sort(x["slots"]) == F.when(F.size(x["kept"]) > 0, F.sequence(F.lit(0), F.size(x["kept"]) - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.split(c, r"\{\d+\}", -1)
    filled = lambda x: F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(x["kept"], F.get(x["slots"], i - 1)), p))), "")
    return let(F.struct(slots.alias("slots"), kept.alias("kept")), lambda x: F.when(whole(x), filled(x)))


def post_edit(c: Column, glossary: list[tuple[str, str]]) -> Column:
    for bad, good in glossary:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def strip_html(c: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, entities decoded, white space collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_text(html: Column, most: int = fixed.PAGE_CHARS) -> Column:
    """What a page says, without what scripts, fallbacks and fields that are typed into hold, up to a number of characters."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in fixed.UNSEEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.substring(strip_html(out), 1, most)


def links(html: Column, most: int = 8, allowed: str = ".*") -> Column:
    """Link targets that match, in order and once each."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.rlike(allowed))), 1, most)


def tidy(c: Column) -> Column:
    """White space collapsed, dashes made plain, and no space before a part's dash."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.translate(c, "–—‑", "---"), r"\s+", " ")), r"\s*-\s*(?=Part\b)", " - ")


def shingles(c: Column, n: int = fixed.SHINGLE) -> Column:
    """Distinct runs of n tokens, joined by spaces; empty for fewer tokens."""
    runs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " ")))
    return let(tokens(c), lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(runs(t)))


def is_heading(line: Column) -> Column:
    """A numbered line over 60 % in capitals, or a short one over 85 %, up to 92 characters, not ended by a stop."""
    t = F.trim(line)
    letters, capitals = F.char_length(F.regexp_replace(t, r"[^A-Za-z]", "")), F.char_length(F.regexp_replace(t, "[^A-Z]", ""))
    caps = F.try_divide(capitals, letters)
    numbered = t.rlike(fixed.NUMBERED_HEADING)
    return F.coalesce((F.char_length(t) <= 92) & ~t.endswith(".") & (letters > 0) & ((numbered & (caps > 0.6)) | ((caps > 0.85) & (F.size(F.split(t, r"\s+")) <= 12))), F.lit(False))


def letter_first_lower(c: Column) -> Column:
    """The first letter lower-cased, unless the second is a capital."""
    return F.when(F.substring(c, 2, 1).rlike("[A-Z]"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c))))
