"""A document's whole way over the desk: citations read off its text, findings, edits, the corrected text and its second audit.

Texts are read once for their citations; from there on all is joins and groupings of citations, which are written between
the steps. Every spelled citation is resolved through the register's keys, so a document may spell it as it likes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations, ids
from ..functions.values import is_dead
from . import audit, repair, resolve
from .plumbing import written


@dataclass
class Records:
    """register: number, status. rules: number (certification is mandatory). edges: src, dst, confidence, co, as documents
    spell them. successors: number, successor. read: the citations of a text. put: a text with one citation replaced.
    places: doc, item, at - the places of citations where these don't stand in the order of their text; equal ones go by item."""

    register: DataFrame
    rules: DataFrame
    edges: DataFrame
    successors: DataFrame
    confidence: float
    co: int
    read: Callable[[Column], Column] = citations.extract
    put: Callable[[Column, Column, Column], Column] = citations.replace_citation
    places: DataFrame | None = None

    def of(self, spelled: DataFrame, column: str) -> DataFrame:
        """spelled, with number and status of the register's row; both null where nothing matches."""
        rows = self.register.groupBy("number").agg(F.min("status").alias("status"))
        return resolve.resolve(spelled, column, rows, "number").drop("matched_by").withColumnRenamed("resolved_id", "number").join(rows, "number", "left")


@dataclass
class Audit:
    docs: DataFrame  # doc, has_text, demands, n_cited
    cited: DataFrame  # doc, place, item, number, status
    findings: DataFrame


def audited(texts: DataFrame, key: str, text: str, records: Records) -> Audit:
    """texts: one row for each document."""
    t = F.col(text)
    read = written(texts.select(F.col(key).alias("doc"), (F.trim(F.coalesce(t, F.lit(""))) != "").alias("has_text"), F.coalesce(citations.demands_mark(t), F.lit(False)).alias("demands"), F.coalesce(records.read(t), F.array().cast("array<string>")).alias("cites")), "desk-read")
    docs = read.select("doc", "has_text", "demands", F.size("cites").cast("long").alias("n_cited"))
    spelled = read.select("doc", F.posexplode("cites").alias("place", "item"))
    if records.places is not None:
        spelled = spelled.join(records.places, ["doc", "item"], "left").select("doc", F.coalesce("at", "place").alias("place"), "item")
    cited = written(records.of(spelled, "item").select("doc", "place", "item", "number", "status"), "desk-cited")
    held = cited.filter("number is not null")
    mandatory = held.join(records.rules.select("number").distinct(), "number", "left_semi").select("item")
    keyed = cited.select("doc", "place", "item", ids.base(F.col("item")).alias("base"), F.nullif(ids.digits(F.col("item")), F.lit("")).alias("key"))
    ends = records.of(records.edges.select(F.col("dst").alias("item")).distinct(), "item").select(F.col("item").alias("dst"), F.col("status").alias("dst_status"))
    edges = records.edges.join(ends, "dst").withColumn("dst_key", F.nullif(ids.digits(F.col("dst")), F.lit("")))
    found = audit.assembled([
        audit.dispute_risk(held),
        audit.statutory_omission(held, mandatory, docs),
        audit.missing_connected(keyed, edges, records.confidence, records.co),
        audit.not_in_register(cited.filter("number is null")),
    ])
    return Audit(docs, cited, written(found, "desk-findings"))


def reports(a: Audit) -> DataFrame:
    """One row for each document: findings by severity, the verdict and its sentence, and the number of edits of each kind."""
    kinds = {"dispute": "dispute_risk", "omission": "statutory_omission", "missing": "missing_connected", "unknown": "not_in_register"}
    by_kind = a.findings.groupBy("doc").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])
    edits = audit.suggestions(a.findings).groupBy("doc").agg(*[F.count_if(F.col("edit") == e).alias(e) for e in ("replace", "add", "add_clause", "unresolved")])
    out = audit.counts(a.docs, a.findings).join(by_kind, "doc", "left").join(edits, "doc", "left").fillna(0)
    return audit.summary(out, "n_cited").drop(*kinds, "has_text", "demands")


def planned(a: Audit, records: Records) -> tuple[DataFrame, DataFrame]:
    """(changes, allowed): what is done to each document, and the citations (doc, cite) that it may have then."""
    edits = audit.suggestions(a.findings)
    succession = records.successors.groupBy("number").agg(F.min("successor").alias("successor"))
    dead = a.cited.filter(is_dead(F.col("status"))).join(succession, "number", "left").select("doc", F.col("item").alias("cite"), "successor")
    missing = edits.filter("edit = 'add'").select("doc", F.col("item").alias("cite"))
    held = records.of(missing.select("cite").distinct(), "cite").filter("number is not null").select("cite")
    keep = a.cited.filter("status = 'Current'").select("doc", F.col("item").alias("cite"))
    named = a.cited.select(F.col("item").alias("cite")).unionByName(held).unionByName(succession.select(F.col("successor").alias("cite"))).distinct()
    duties = records.of(named, "cite").join(records.rules.select("number").distinct(), "number", "left_semi").select("cite")
    changes = written(repair.plan(dead, missing.join(held, "cite", "left_semi"), keep, duties, a.docs.filter("demands").select("doc", "demands")), "desk-changes")
    return changes, keep.unionByName(changes.select("doc", F.coalesce("new", "old").alias("cite")).filter("cite is not null"))


def repaired(texts: DataFrame, key: str, text: str, records: Records) -> DataFrame:
    """One row for each document: its report, what is changed, the corrected text, and what the audit of that finds."""
    first = audited(texts, key, text, records)
    changes, allowed = planned(first, records)
    tails = repair.tail(changes).withColumnRenamed("doc", key)
    fixed = repair.substituted(texts, key, text, changes, records.put).join(tails, key, "left").select(key, repair.finished(F.col("fixed"), F.col("tail")).alias("fixed"))
    fixed = written(fixed, "desk-fixed")
    second = audited(fixed, key, "fixed", records)
    high = second.findings.filter("severity = 'high'").groupBy(F.col("doc").alias(key)).agg(F.count(F.lit(1)).alias("high"))
    found = second.cited.select(F.col("doc").alias(key), F.col("item").alias("cite"))  # the text was read for its second audit
    checked = repair.verified(fixed, key, "fixed", allowed.withColumnRenamed("doc", key), high, found=found).withColumnRenamed("high", "high_after")
    done = changes.groupBy("doc", "action").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "action", "n"))), " ").alias("changes"))
    out = reports(first).join(done, "doc", "left").withColumn("changes", F.coalesce("changes", F.lit("")))
    return out.withColumnRenamed("doc", key).join(fixed, key).join(checked, key)
