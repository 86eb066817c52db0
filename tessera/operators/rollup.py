"""Corpus health: what the documents cite, how much of it is dead, and who cites it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.values import is_dead, share


def dead_bases(register: DataFrame, base: Column, status: str) -> DataFrame:
    """Bases with a dead row and no current one: one aggregate, not a set difference of two scans."""
    g = register.select(base.alias("base"), F.col(status).alias("s")).groupBy("base").agg(F.max(is_dead(F.col("s")).cast("int")).alias("dead"), F.max((F.col("s") == "Current").cast("int")).alias("current"))
    return g.filter("dead = 1 and current = 0").select("base")


def flagged(bridge: DataFrame, item: str, dead: DataFrame, key: str) -> DataFrame:
    """bridge with ``dead`` (boolean) by a left join on the item."""
    return bridge.join(dead.select(F.col(key).alias(item)).distinct().withColumn("_d", F.lit(True)), item, "left").withColumn("dead", F.coalesce("_d", F.lit(False))).drop("_d")


def per_document(bridge: DataFrame, doc: str, item: str, keep: list[str] = ()) -> DataFrame:
    """One row per document: citations, distinct items, dead items, and whether any is dead."""
    return bridge.groupBy(doc, *keep).agg(F.count(F.lit(1)).alias("citations"), F.count_distinct(item).alias("items"), F.count_distinct(F.when(F.col("dead"), F.col(item))).alias("dead_items")).withColumn("has_dead", F.col("dead_items") > 0)


def health(docs: DataFrame, by: list[str]) -> DataFrame:
    """Documents, those with dead items and their percentage, for each combination of ``by`` alone and for all: one pass."""
    sets = [()] + [(b,) for b in by]
    g = docs.groupingSets([list(s) for s in sets], *by).agg(F.count(F.lit(1)).alias("docs"), F.count_if("has_dead").alias("docs_with_dead"), F.sum("citations").alias("citations"), F.grouping_id().alias("_g"))
    names = F.coalesce(*[F.when(F.col("_g") == F.lit(sum(1 << (len(by) - 1 - j) for j in range(len(by)) if j != i)), F.lit(b)) for i, b in enumerate(by)], F.lit("all"))
    value = F.coalesce(*[F.col(b).cast("string") for b in by], F.lit("all"))
    return g.select(names.alias("dimension"), value.alias("value"), "docs", "docs_with_dead", "citations", share(F.col("docs_with_dead"), F.col("docs")).alias("pct"))


def buyers(bridge: DataFrame, buyer: list[str], doc: str, item: str, floor: int, top: int) -> DataFrame:
    """Buyers with ``floor`` documents at least, most dead first, each with its most cited dead item.

    An item counts once for each document and buyer, so that two parts of one item don't count twice.
    """
    once = bridge.select(*buyer, doc, item, "dead").distinct()
    docs = once.groupBy(*buyer, doc).agg(F.max("dead").alias("has_dead")).groupBy(*buyer).agg(F.count(F.lit(1)).alias("docs"), F.count_if("has_dead").alias("docs_with_dead")).filter(F.col("docs") >= floor)
    items = once.filter("dead").groupBy(*buyer, item).agg(F.count(F.lit(1)).alias("n"))
    worst = items.groupBy(*buyer).agg(F.min_by(F.struct(F.col(item).alias("top_dead"), F.col("n").alias("top_dead_docs")), F.struct(-F.col("n"), F.col(item))).alias("w"))
    return docs.join(worst, buyer, "left").select(*buyer, "docs", "docs_with_dead", share(F.col("docs_with_dead"), F.col("docs")).alias("pct"), "w.top_dead", "w.top_dead_docs").orderBy(F.desc("docs_with_dead"), F.desc("docs"), *buyer).limit(top)


def certification_gap(bridge: DataFrame, doc: str, item: str, mandatory: DataFrame, demands: Column) -> DataFrame:
    """Documents that cite an item under mandatory certification, by what their text says about the mark: one row."""
    cited = bridge.join(mandatory.select(item).distinct(), item, "left_semi").groupBy(doc).agg(F.max(demands).alias("d"))
    known = F.col("d").isin("Yes", "No")
    return cited.agg(F.count(F.lit(1)).alias("cited"), F.count_if(known).alias("scanned"), F.count_if(F.col("d") == "No").alias("no_clause"), F.count_if(~known | F.col("d").isNull()).alias("unknown"))


def gap_families(bridge: DataFrame, doc: str, item: str, rules: DataFrame, family: str, demands: Column, k: int) -> DataFrame:
    """family, n: the k families whose mandatory items most documents cite without asking for the mark. rules: item, family."""
    hits = bridge.filter(demands == "No").join(rules.select(item, family).distinct(), item).select(doc, family).distinct()
    return hits.groupBy(family).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), family).limit(k)


def peer_repeats(peers: DataFrame, dead: DataFrame, about: DataFrame, most: int = 8, examples: int = 4, buyers: int = 6, each: int = 6) -> DataFrame:
    """One row for each query with peers: how many repeat a dead item, the ``most`` worst with their dead items, examples and buyers.

    peers: query, doc, rank. dead: doc, item, one row each. about: doc, category, buyer.
    """
    p = peers.select("query", "doc", "rank").join(about, "doc", "left")
    bad = dead.groupBy("doc").agg(F.slice(F.array_sort(F.collect_set("item")), 1, each).alias("dead"))
    p = p.join(bad, "doc", "left")
    worst = F.array_sort(F.collect_list(F.when(F.col("dead").isNotNull(), F.struct((-F.size("dead")).alias("o"), "rank", "doc", "buyer", "dead"))))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "doc", "category"))), 1, examples), lambda x: x["category"])
    g = p.groupBy("query").agg(F.count(F.lit(1)).alias("peers"), F.count("dead").alias("repeating"), F.slice(worst, 1, most).alias("repeats"), first.alias("examples"), F.slice(F.array_sort(F.collect_set("buyer")), 1, buyers).alias("buyers"))
    return g


def peer_tally(bridge: DataFrame, doc: str, item: str) -> DataFrame:
    """Documents for each item, dead ones first: item, dead, n_docs, of_docs."""
    once = bridge.select(doc, item, "dead").distinct()
    total = once.agg(F.count_distinct(doc).alias("of_docs"))
    return once.groupBy(item, "dead").agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(total)).orderBy(F.desc("dead"), F.desc("n_docs"), item)  # total is one row


def majority(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value of each group, the least on a tie, and its count."""
    n = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(F.struct(F.col(value).alias("value"), "n"), F.struct(-F.col("n"), F.col(value))).alias("m")).select(by, F.col("m.value").alias(value), F.col("m.n").alias("n"))


def classified(cited: DataFrame, register: DataFrame) -> DataFrame:
    """doc, family, outdated, unmatched of each document, from its citations (doc, place, cite) and the register (number,
    status, family): the commonest family of those that resolve by base, the first cited of equal ones (then the least), ``Unclassified`` if
    there is none; and, in the order of citation, those that are dead with their status, and those that resolve to nothing."""
    key = lambda c: F.upper(ids.base(c))
    held = register.groupBy(key(F.col("number")).alias("_b")).agg(F.min_by(F.struct("status", "family"), "number").alias("r"))
    rows = cited.withColumn("_b", key(F.col("cite"))).join(held, "_b", "left")
    votes = rows.filter("coalesce(r.family, '') != ''").groupBy("doc", F.col("r.family").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    family = votes.groupBy("doc").agg(F.min_by("family", F.struct(-F.col("n"), "first", "family")).alias("family"))
    listed = lambda when, said: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", said.alias("t"))))), lambda x: x["t"])
    dead = is_dead(F.col("r.status"))
    lists = rows.groupBy("doc").agg(listed(dead, F.concat("cite", F.lit(" ("), "r.status", F.lit(")"))).alias("outdated"), listed(F.col("r").isNull(), F.col("cite")).alias("unmatched"))
    return lists.join(family, "doc", "left").select("doc", F.coalesce("family", F.lit("Unclassified")).alias("family"), "outdated", "unmatched")


def most_common(df: DataFrame, item: str, attributes: DataFrame, k: int) -> DataFrame:
    """The k commonest items with their attributes; attributes are joined to k rows only."""
    top = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(k)
    return top.join(attributes, item, "left").orderBy(F.desc("n"), item)


def running_share(df: DataFrame, key: str, n: str) -> DataFrame:
    """Rows ranked by n with the share of all that they and those before them hold."""
    w = Window.orderBy(F.desc(n), key)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("running", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
