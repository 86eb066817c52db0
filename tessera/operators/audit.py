"""Auditing documents: findings, suggestions, verdicts and summaries from one bridge of resolved citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.values import is_dead
from .graph import ROWS, tasks
from .plumbing import skew_join, written

FINDING = ["doc", "kind", "severity", "item", "subject", "n"]


def _finding(df: DataFrame, kind: str, severity: Column | str, item: str = "item", subject: Column | None = None, n: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select("doc", F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(item).cast("string").alias("item"), (null if subject is None else subject).cast("string").alias("subject"), (null if n is None else n).cast("long").alias("n"))


def dispute_risk(resolved: DataFrame) -> DataFrame:
    """Cited items whose own row is dead; the subject is their status."""
    return _finding(resolved.filter(is_dead(F.col("status"))), "dispute_risk", "high", subject=F.col("status"))


def statutory_omission(resolved: DataFrame, mandatory: DataFrame, marks: DataFrame) -> DataFrame:
    """Items under mandatory certification in documents that don't ask for the mark; less grave if there is no text.

    marks: doc, has_text, demands.
    """
    hit = resolved.join(mandatory.select("item").distinct(), "item", "left_semi").join(marks, "doc").filter(~F.col("has_text") | ~F.col("demands"))
    return _finding(hit, "statutory_omission", F.when(F.col("has_text"), "high").otherwise("medium"))


def missing_connected(cited: DataFrame, edges: DataFrame, confidence: float = fixed.MISSING_CONFIDENCE, co: int = fixed.MISSING_COUNT, each: int = fixed.MISSING_EACH, most: int = fixed.MISSING_ALL) -> DataFrame:
    """Live items that usually go with the cited ones and are missing: ``each`` for a source at most, ``most`` for a document.

    cited: doc, place (the order of citation), item, base, key. edges: src, dst, dst_key, confidence, co, dst_status.
    A document's citations are taken in their order, each with the MISSING_WIDTH times ``each`` most confident edges of its
    item or base. A target is told by its key; one whose key is cited, or dead, is passed over. A key that an earlier source
    named goes to a later one only if that is more confident, and counts there against the later one's own quota.

    The edges of a source are an array of bounded length; what a task holds of a document grows with its citations alone, and
    documents are dealt over as many tasks as their citations take.
    """
    width = each * fixed.MISSING_WIDTH
    strong = edges.filter((F.col("confidence") >= confidence) & (F.col("co") >= co))
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("co"), "dst"))
    edge = F.struct((-F.col("confidence")).alias("c"), (-F.col("co")).alias("o"), "dst", "src", F.col("dst_key").alias("key"), is_dead(F.col("dst_status")).alias("dead"))
    best = strong.withColumn("_r", first).filter(F.col("_r") <= width).groupBy("src").agg(F.collect_list(edge).alias("edges"))
    cited = written(cited.select("doc", "place", "item", "base", "key"), "audit-rows")
    parts = tasks(cited.sparkSession, cited.count(), ROWS)
    rows = cited.repartition(parts, "doc").groupBy("doc", "item").agg(F.min(F.struct("place", "base", "key")).alias("c")).select("doc", "item", "c.*")
    ends = rows.select("doc", "item", "place", "key", F.explode(F.array_distinct(F.filter(F.array("item", "base"), lambda x: x.isNotNull()))).alias("src"))
    ends, best = written(ends, "audit-cited"), written(best, "audit-edges")
    uses = ends.groupBy("src").agg(F.count(F.lit(1)).alias("_uses"))
    near = skew_join(ends, best.join(uses, "src"), ["src"], "_uses", ends.count(), F.col("doc"), "inner", parts)
    near = near.repartition(parts, "doc").groupBy("doc", "item").agg(F.min("place").alias("place"), F.slice(F.array_sort(F.flatten(F.collect_list("edges"))), 1, width).alias("edges"))
    keys = rows.groupBy("doc").agg(F.collect_set("key").alias("keys"))
    source = F.struct("place", "item", "edges")
    docs = near.groupBy("doc").agg(F.array_sort(F.collect_list(source)).alias("sources")).join(keys, "doc")
    hits = F.flatten(F.transform("sources", lambda s: F.transform(s["edges"], lambda e: F.struct(s["item"].alias("item"), e.alias("e")))))
    docs = docs.withColumn("hits", F.filter(hits, lambda h: h["e"]["key"].isNotNull() & ~h["e"]["dead"] & ~F.array_contains("keys", h["e"]["key"])))
    kinds = {f: docs.select(F.col("hits")[0]["e"][f].alias("x")).schema["x"].dataType.simpleString() for f in ("c", "o", "dst", "key")}
    item = docs.select(F.col("hits")[0]["item"].alias("x")).schema["x"].dataType.simpleString()
    entry = f"struct<c: {kinds['c']}, o: {kinds['o']}, dst: {kinds['dst']}, item: {item}, key: {kinds['key']}>"
    fold = f"""aggregate(hits, cast(named_struct('found', array(), 'item', null, 'kept', 0) as struct<found: array<{entry}>, item: {item}, kept: int>), (s, h) ->
        transform(array(if(s.item <=> h.item, s.kept, 0)), kept -> if(kept < {each} and not exists(s.found, f -> f.key = h.e.key and f.c <= h.e.c),
            named_struct('found', concat(filter(s.found, f -> f.key != h.e.key), array(cast(named_struct('c', h.e.c, 'o', h.e.o, 'dst', h.e.dst, 'item', h.item, 'key', h.e.key) as {entry}))), 'item', h.item, 'kept', kept + 1),
            named_struct('found', s.found, 'item', h.item, 'kept', kept)))[0], s -> s.found)"""
    found = docs.select("doc", F.inline(F.slice(F.array_sort(F.expr(fold)), 1, most)))
    return _finding(found, "missing_connected", "medium", item="dst", subject=F.col("item"), n=-F.col("o"))


def not_in_register(unresolved: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Cited items that match nothing; the subject is a suggestion, where there is one."""
    if suggestions is None:
        return _finding(unresolved, "not_in_register", "low")
    return _finding(unresolved.join(suggestions, unresolved["item"] == suggestions["unknown"], "left"), "not_in_register", "low", subject=F.col("suggestion"))


def number_checks(numbers: DataFrame, register: DataFrame, rules: DataFrame, related: DataFrame) -> DataFrame:
    """One row for each cited number (item): whether it is held, dead, what replaces it, its certification, and what goes with it.

    register: item, status, replaced_by. rules: item, scheme. related: item, dst, rank.
    """
    near = related.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("related"))
    scheme = rules.groupBy("item").agg(F.min("scheme").alias("scheme"))
    out = numbers.select("item").distinct().join(register, "item", "left").join(scheme, "item", "left").join(near, "item", "left")
    dead = is_dead(F.col("status"))
    return out.select("item", F.col("status").isNotNull().alias("held"), dead.alias("dead"), F.when(dead, F.coalesce("replaced_by", F.lit("UNKNOWN"))).alias("replaced_by"), F.col("scheme").isNotNull().alias("certified"), "scheme", "related")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def assembled(findings: list[DataFrame]) -> DataFrame:
    """All findings with their place in the document's report: by severity, kind and item."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("doc").orderBy(severity_rank(F.col("severity")), "kind", "item", F.col("subject").asc_nulls_first())
    return out.withColumn("place", F.row_number().over(w))


def counts(docs: DataFrame, findings: DataFrame, scanned: Column | None = None) -> DataFrame:
    """One row per document: findings by severity, and the verdict; documents without findings are clean."""
    n = findings.groupBy("doc").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.count(F.lit(1)).alias("findings"))
    out = docs.join(n, "doc", "left").fillna(0, ["high", "medium", "low", "findings"])
    verdict = F.when(F.col("high") > 0, "blocking").when(F.col("findings") > 0, "review").otherwise("clean")
    return out.withColumn("verdict", verdict if scanned is None else F.when(scanned, "unreadable").otherwise(verdict))


def suggestions(findings: DataFrame) -> DataFrame:
    """Findings as edits: replace, add, add_clause or unresolved, grouped by what caused them."""
    edit = F.when(F.col("kind") == "dispute_risk", "replace").when(F.col("kind") == "missing_connected", "add").when(F.col("kind") == "statutory_omission", "add_clause").otherwise("unresolved")
    return findings.withColumn("edit", edit)


def by_cause(findings: DataFrame) -> DataFrame:
    """doc, cause, items: what a document lacks, by the citation of its own that brought it up, in the order of the report."""
    rows = suggestions(findings).filter("edit = 'add'")
    return rows.groupBy("doc", F.col("subject").alias("cause")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def summary(per_doc: DataFrame, cited: str) -> DataFrame:
    """A sentence for each document from its counts: dispute, omission, missing and unknown findings."""
    parts = F.concat_ws("; ", F.when(F.col("dispute") > 0, F.concat(plural(F.col("dispute"), "citation"), F.lit(" no longer current"))), F.when(F.col("omission") > 0, F.concat(plural(F.col("omission"), "certification item"), F.lit(" without a mark clause"))), F.when(F.col("missing") > 0, F.concat(plural(F.col("missing"), "entry", "entries"), F.lit(" usually cited with these"))), F.when(F.col("unknown") > 0, F.concat(plural(F.col("unknown"), "citation"), F.lit(" not in the register"))))
    lead = F.when(F.col("high") > 0, "Blocking issues found. ").otherwise("Review recommended. ")
    n = F.col(cited)
    text = F.when(n == 0, "No citations found.").when(parts == "", F.concat(plural(n, "citation"), F.lit(" checked. Nothing flagged."))).otherwise(F.concat(lead, plural(n, "citation"), F.lit(" checked: "), parts, F.lit(".")))
    return per_doc.withColumn("summary", text)


def decision_counts(log: DataFrame, decision: str) -> DataFrame:
    """Decisions by verb, and the share that was accepted; null without decisions."""
    n = log.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    rate = F.round(100.0 * F.sum(F.when(F.col(decision) == "accepted", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w), 1)
    return n.withColumn("agreement_pct", rate)
