"""Repairing documents: planned changes, literal substitution, and a check of what came out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations, fixed


def plan(dead: DataFrame, missing: DataFrame, keep: DataFrame, duties: DataFrame, demands: DataFrame) -> DataFrame:
    """doc, action, old, new: replace or flag dead citations, add missing ones, and add a clause where a duty is unmet.

    dead: doc, cite, successor. missing: doc, cite. keep: doc, cite. duties: cite. demands: doc, demands.
    What a replacement brings in is not added again; duties are read off what the corrected document will cite.
    """
    change = dead.select("doc", F.when(F.col("successor").isNotNull(), "replace").otherwise("flag").alias("action"), F.col("cite").alias("old"), F.col("successor").alias("new"))
    introduced = change.filter("action = 'replace'").select("doc", F.col("new").alias("cite"))
    add = missing.join(introduced, ["doc", "cite"], "left_anti").select("doc", F.lit("add").alias("action"), F.lit(None).cast("string").alias("old"), F.col("cite").alias("new"))
    changes = change.unionByName(add)
    final = keep.select("doc", "cite").unionByName(changes.select("doc", F.coalesce("new", "old").alias("cite"))).distinct()
    owed = final.join(duties.select("cite").distinct(), "cite", "left_semi").select("doc").distinct().join(demands.filter("demands"), "doc", "left_anti")
    clause = owed.select("doc", F.lit("clause").alias("action"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    return changes.unionByName(clause)


def substituted(docs: DataFrame, key: str, text: str, changes: DataFrame, put: Callable[[Column, Column, Column], Column] = citations.replace_citation) -> DataFrame:
    """key, fixed: all replacements of a document in order of their old text, by a fold over one array per document.

    put: the text with one citation (old) replaced by another (new)."""
    ordered = changes.filter("action = 'replace'").groupBy(F.col("doc").alias(key)).agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("_c"))
    out = docs.select(key, text).join(ordered, key, "left")
    fold = F.aggregate(F.coalesce("_c", F.array().cast("array<struct<old:string,new:string>>")), F.col(text), lambda t, c: put(t, c["old"], c["new"]))
    return out.select(key, fold.alias("fixed"))


def tail(changes: DataFrame) -> DataFrame:
    """doc, tail: the lines that a corrected document gets at its end."""
    g = changes.groupBy("doc").agg(F.array_sort(F.collect_set(F.when(F.col("action") == "add", F.col("new")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("action") == "flag", F.col("old")))).alias("f"), F.max((F.col("action") == "clause").cast("int")).alias("c"))
    lines = F.concat_ws("\n\n", F.when(F.size("a") > 0, F.concat(F.lit("Additional entries applicable: "), F.array_join("a", ", "), F.lit("."))), F.when(F.size("f") > 0, F.concat(F.lit("Recorded as no longer current, without a successor; confirm before publication: "), F.array_join("f", ", "), F.lit("."))), F.when(F.col("c") == 1, "Only material bearing a valid Standard Mark shall be accepted."))
    return g.select("doc", lines.alias("tail"))


def finished(fixed: Column, tail_: Column) -> Column:
    return F.when(F.coalesce(tail_, F.lit("")) == "", fixed).otherwise(F.concat(F.rtrim(fixed), F.lit("\n\n"), tail_, F.lit("\n")))


def intruders(fixed: DataFrame, key: str, text: str, allowed: DataFrame, read: Callable[[Column], Column] = citations.extract, found: DataFrame | None = None) -> DataFrame:
    """key, cite: citations of the corrected text, as ``read`` finds them, whose base is not among the allowed ones (key, cite)."""
    from ..functions.ids import base

    found = fixed.select(key, F.explode(read(F.col(text))).alias("cite")) if found is None else found
    found = found.withColumn("_b", base(F.col("cite")))
    return found.join(allowed.select(key, base(F.col("cite")).alias("_b")).distinct(), [key, "_b"], "left_anti").select(key, "cite")


def verified(fixed_docs: DataFrame, key: str, text: str, allowed: DataFrame, high: DataFrame, read: Callable[[Column], Column] = citations.extract, found: DataFrame | None = None) -> DataFrame:
    """One row for each corrected document, audited anew: intruders, high findings of the second audit, and whether it is clean.

    allowed: key, cite. high: key, high (findings of that severity in the second audit). found: key, cite, where the citations
    of the corrected texts are known.
    """
    bad = intruders(fixed_docs, key, text, allowed, read, found).groupBy(key).agg(F.array_sort(F.collect_set("cite")).alias("intruders"))
    out = fixed_docs.select(key).join(bad, key, "left").join(high, key, "left")
    out = out.select(key, F.coalesce("intruders", F.array().cast("array<string>")).alias("intruders"), F.coalesce("high", F.lit(0)).cast("long").alias("high"))
    return out.withColumn("clean", (F.size("intruders") == 0) & (F.col("high") == 0))


def accepted(rewrites: DataFrame, key: str, original: str, rewrite: str, allowed: DataFrame, least: float = fixed.LEAST_LENGTH) -> DataFrame:
    """key, used, reason: a rewrite that names what it was not given, or lost much of the text, is not used."""
    bad = intruders(rewrites, key, rewrite, allowed).select(key).distinct().withColumn("_bad", F.lit(True))
    lost = F.char_length(F.trim(F.col(rewrite))) < F.char_length(F.col(original)) * least
    reason = F.when(F.col("_bad"), "introduced_a_standard").when(lost, "lost_content")
    return rewrites.join(bad, key, "left").select(key, reason.isNull().alias("used"), reason.alias("reason"))


def clause(family: Column, number: Column, year: Column, title: Column, related: Column, mandatory: Column, scheme: Column, status: Column) -> Column:
    """A clause from facts alone; related: array of designations, of which four are named."""
    from ..functions.text import letter_first_lower

    head = F.concat(F.lit("The "), letter_first_lower(F.coalesce(family, F.lit("material"))), F.lit(" supplied under this contract shall conform in all respects to "), number, F.when(year.cast("string").rlike("^[0-9]+$"), F.concat(F.lit(" : "), year.cast("string"))).otherwise(""), F.lit(" ("), F.coalesce(title, F.lit("")), F.lit(")."))
    also = F.when(F.size(related) > 0, F.concat(F.lit("Cited alongside it in comparable documents, and to be reviewed: "), F.array_join(F.slice(related, 1, 4), ", "), F.lit(".")))
    duty = F.when(F.coalesce(mandatory, F.lit(False)), F.concat(F.lit("Certification is mandatory ("), F.coalesce(scheme, F.lit("")), F.lit("); only material bearing a valid Standard Mark shall be accepted.")))
    note = F.when(status.isin("Superseded", "Withdrawn"), F.concat(F.lit("Note: recorded as "), status, F.lit("; confirm before publication.")))
    return F.concat_ws(" ", head, also, duty, note)


def numbered(changes: DataFrame) -> DataFrame:
    """Changes with their place in the document's list of edits."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("action", F.col("old").asc_nulls_last(), F.col("new").asc_nulls_last())))
