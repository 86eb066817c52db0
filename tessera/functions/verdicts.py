"""Verdicts on candidates: role, material, voltage, calibrated scores and the final order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .values import any_match, sigmoid


def role(title: Column) -> Column:
    """The first role of which a pattern occurs in the title."""
    out = F.lit(fixed.OTHER_ROLE[0])
    for key, _, patterns in reversed(fixed.ROLES):
        out = F.when(any_match(title, patterns), key).otherwise(out)
    return out


def role_label(key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, label, _ in fixed.ROLES for x in (k, label)], *[F.lit(x) for x in fixed.OTHER_ROLE]), key)


def wanted_role(query: Column) -> Column:
    out = F.lit("product")
    for key, patterns in reversed(fixed.ROLE_SEEKING.items()):
        out = F.when(any_match(query, patterns), key).otherwise(out)
    return out


def role_verdict(query: Column, title: Column) -> Column:
    """A product query takes any role but those that are never a product's specification; others take their own."""
    wanted, got = wanted_role(query), role(title)
    fits = F.when(wanted == "product", ~got.isin(fixed.NOT_PRODUCT)).otherwise(got == wanted)
    return F.when(fits, "match").otherwise("wrong_kind")


def materials(text: Column) -> Column:
    """Materials named; a narrower vinyl takes the place of the broad one."""
    found = F.filter(F.array(*[F.when(any_match(text, p), F.lit(k)) for k, p in fixed.MATERIALS.items()]), lambda x: x.isNotNull())
    narrow = F.array_contains(found, "upvc") | F.array_contains(found, "cpvc")
    return F.array_sort(F.when(narrow, F.array_remove(found, "pvc")).otherwise(found))


def material_verdict(query: Column, title: Column) -> Column:
    wanted, theirs = materials(query), materials(title)
    pairs = [F.array_contains(wanted, a) & F.array_contains(theirs, b) for a, b in fixed.AGREE]
    fits = F.arrays_overlap(wanted, theirs) | reduce(lambda x, y: x | y, pairs)
    return F.when((F.size(wanted) == 0) | (F.size(theirs) == 0), "not_declared").when(fits, "match").otherwise("different_material")


#: Groups of three digits may stand apart; any other space ends a number.
NUMBER = r"(\d{1,3}(?: \d{3})+|\d+)((?:\.\d+)?)"


def volts(number: Column, unit: Column) -> Column:
    return F.regexp_replace(number, " ", "").cast("double") * F.when(F.lower(unit) == "kv", 1000).otherwise(1)


def voltage_band(title: Column) -> Column:
    """(low, high) that a title declares; low is 0 if only an upper end is given; null without one."""
    upto = r"up\s*to\s+and\s+including\s+" + NUMBER + r"\s*(kV|V)\b"
    both = r"(?i)from\s+" + NUMBER + r"\s*(kV|V)\b.{0,40}?" + upto
    g = lambda p, i: F.regexp_extract(title, p, i)
    ranged = F.struct(volts(F.concat(g(both, 1), g(both, 2)), g(both, 3)).alias("low"), volts(F.concat(g(both, 4), g(both, 5)), g(both, 6)).alias("high"))
    upper = F.struct(F.lit(0.0).alias("low"), volts(F.concat(g("(?i)" + upto, 1), g("(?i)" + upto, 2)), g("(?i)" + upto, 3)).alias("high"))
    return F.when(title.rlike(both), ranged).when(title.rlike("(?i)" + upto), upper)


def stated_voltage(query: Column) -> Column:
    """The highest voltage in a text; null if there is none above 0."""
    pattern = r"(?i)" + NUMBER + r"\s*(kV|V)\b"
    whole, frac, unit = (F.regexp_extract_all(query, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    found = F.transform(F.arrays_zip(whole.alias("a"), frac.alias("b"), unit.alias("u")), lambda x: volts(F.concat(x["a"], x["b"]), x["u"]))
    return F.array_max(F.filter(found, lambda v: v > 0))


def voltage_verdict(query: Column, title: Column) -> Column:
    v, b = stated_voltage(query), voltage_band(title)
    return F.when(v.isNull() | b.isNull(), "not_declared").when((b["low"] <= v) & (v <= b["high"]), "in_band").otherwise("out_of_band")


def final_order(voltage: Column, material: Column, role_: Column, status: Column, score: Column, key: Column) -> list[Column]:
    """One sort after all verdicts; an unknown status ranks behind the known ones."""
    rank = lambda c, names, default: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), c), F.lit(default))
    return [rank(voltage, ["in_band", "not_declared", "out_of_band"], 1).asc(), rank(material, ["match", "not_declared", "different_material"], 1).asc(), rank(role_, ["match", "wrong_kind"], 0).asc(), rank(status, ["Current", "Superseded", "Withdrawn"], 3).asc(), score.desc(), key.asc()]


def fused_score(rrf: Column, rankings: int) -> Column:
    """Fused rank against the most that a candidate could get."""
    return F.round(sigmoid(fixed.FUSED_GAIN * (F.least(rrf / (rankings / (fixed.RRF_K + 1)), F.lit(1.0)) - fixed.FUSED_MIDPOINT)), 4)


def lexical_score(bm25: Column) -> Column:
    return F.round(sigmoid(fixed.LEXICAL_GAIN * (bm25 / fixed.LEXICAL_SCALE - 1)), 4)


def dense_score(cosine: Column) -> Column:
    return F.round(sigmoid(fixed.DENSE_GAIN * (cosine - fixed.DENSE_MIDPOINT)), 4)


def gate(top: Column, second: Column, tied_on_voltage: Column | None = None) -> Column:
    """(decision, reason): abstain without candidates, under the threshold, or between two that are too close."""
    say = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    tied = F.lit(False) if tied_on_voltage is None else F.coalesce(tied_on_voltage, F.lit(False))
    close = (top < fixed.HIGH_CONFIDENCE) & (F.round(top - F.coalesce(second, F.lit(0.0)), 9) < fixed.MARGIN)
    return F.when(top.isNull(), say("abstain", "no_candidates")).when(top < fixed.TOP_SCORE, say("abstain", "no_close_match")).when(close, say("abstain", "ambiguous_match")).when(tied, say("abstain", "voltage_unspecified")).otherwise(say("recommend", "clear_match"))


def prose_fault(text: Column, mandatory: Column, leaks: Column, governing: Column) -> Column:
    """Why generated prose is refused; null if it may be used. The first fault in order is named."""
    from .citations import demands_mark

    t = F.trim(F.coalesce(text, F.lit("")))
    mark, must = demands_mark(t), F.coalesce(mandatory, F.lit(False))
    named = F.coalesce(t.contains(F.trim(F.substring_index(governing, "(", 1))), F.lit(False))
    return (
        F.when(t == "", "empty_response")
        .when(t.rlike(fixed.REFUSAL), "not_a_clause")
        .when(t.rlike(fixed.PARTY), "obligation_on_person_not_goods")
        .when(mark & ~must, "invented_certification_duty")
        .when(must & ~mark, "dropped_certification_duty")
        .when(t.rlike(fixed.PERMISSIVE), "unsupported_permissive_claim")
        .when(F.size(leaks) > 0, "subset_guard_failed")
        .when(~named, "governing_standard_missing")
    )


def route(n_citations: Column, asked: Column | None = None) -> Column:
    """Where a query goes: as asked, else to the audit if it cites anything, else to a draft; with the reason."""
    say = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("why"))
    own = F.when(n_citations >= 1, say("audit", "the text cites entries")).otherwise(say("draft", "the text cites nothing"))
    if asked is None:
        return own
    return F.when(asked.isin("audit", "draft"), F.struct(asked.alias("route"), F.lit("as asked").alias("why"))).otherwise(own)


def within(size: Column, most: int) -> Column:
    """Whether an input is of a size that is taken."""
    return F.coalesce(size <= most, F.lit(False))


def size_fault(upload: Column, chars: Column, strings: Column, repair: Column) -> Column:
    """The first bound that a request breaks, of bytes, characters, strings and characters to repair; null if it is taken."""
    bounds = [(upload, fixed.UPLOAD_BYTES, "upload"), (chars, fixed.TEXT_CHARS, "text"), (strings, fixed.STRINGS, "strings"), (repair, fixed.REPAIR_CHARS, "repair")]
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(0)) > most, F.lit(name)) for c, most, name in bounds])


def tied_on_voltage(number: Column, other: Column, title: Column, other_title: Column, score: Column, other_score: Column) -> Column:
    """Two parts of one base, too close in score, that declare different bands."""
    from .ids import base_with_year

    a, b = voltage_band(title), voltage_band(other_title)
    return (F.abs(score - other_score) < fixed.MARGIN) & (base_with_year(number) == base_with_year(other)) & a.isNotNull() & b.isNotNull() & ~a.eqNullSafe(b)
