"""The co-citation graph kept up to date: each batch adds what its citations change, and nothing is mined again.

For a batch, the citations that are new (not in the stored baskets) are paired within their documents' whole baskets: new with
old and new with new, each pair once. These counts, those of the items and the number of documents are added to the stored
ones in the buckets they touch, and all tables take effect with one pointer that carries the batch's number. A batch that is
repeated after a failure finds its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.graph import BASKET, directed
from ..operators.plumbing import removed, written
from ..sources.storage import Store, added


def baskets(came: DataFrame, held: DataFrame, tasks: int) -> DataFrame:
    """doc, item, new of the stored baskets and those that came (doc, item), each citation once, documents dealt over tasks;
    with n and m, the document's citations and new ones, and first, which is true once for each document."""
    all_ = held.select("doc", "item", F.lit(False).alias("new")).unionByName(came.select("doc", "item", F.lit(True).alias("new")))
    dealt = all_.withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("g"))
    once = dealt.groupBy("g", "doc", "item").agg(F.min("new").alias("new"))
    of = Window.partitionBy("g", "doc")
    return once.select("doc", "item", "new", F.count(F.lit(1)).over(of).alias("n"), F.count_if("new").over(of).alias("m"), (F.col("item") == F.min("item").over(of)).alias("first"))


def delta_pairs(b: DataFrame, tasks: int, large: int = BASKET) -> DataFrame:
    """a, b (a < b), co: how many of the baskets b have the pair with a new end.

    Pairs of baskets up to ``large`` are made within the basket and counted where it lies. Larger ones are cut into parts
    on both sides, so that no task joins a whole one with itself. Counts are then dealt by pair.
    """
    b = b.filter("m > 0 and n > 1").withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("g"))
    few, many = b.filter(F.col("n") <= large), b.filter(F.col("n") > large)
    ends = few.groupBy("g", "doc").agg(F.collect_list(F.when(F.col("new"), F.col("item"))).alias("fresh"), F.collect_list(F.when(~F.col("new"), F.col("item"))).alias("old"))
    first = ends.select("g", "fresh", "old", F.posexplode("fresh").alias("at", "x"))
    near = first.select("g", "x", F.explode(F.concat("old", F.slice("fresh", F.col("at") + 2, F.size("fresh")))).alias("y"))
    near = near.groupBy("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("co"))
    parts = F.ceil(F.col("n") / large).cast("int")
    part, every = F.pmod(F.xxhash64("item"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    x = many.filter("new").select("doc", F.col("item").alias("x"), part.alias("i"), every.alias("j")).repartition(tasks, "doc", "i", "j")
    y = many.select("doc", F.col("item").alias("y"), "new", part.alias("j"), every.alias("i")).repartition(tasks, "doc", "i", "j")
    far = x.join(y, ["doc", "i", "j"]).filter((F.col("x") != F.col("y")) & (~F.col("new") | (F.col("x") < F.col("y"))))
    far = far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(1).cast("long").alias("co"))
    return near.select("a", "b", "co").unionByName(far).repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("co").alias("co"))


def co_citations_into(path: str, doc: str = "doc", item: str = "item", buckets: int = 64, large: int = BASKET) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the citations of a batch (doc, item; nulls don't count) to the graph stored at path.

    Its tasks are as many as the citations and pairs that a batch and the buckets it touches take.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, path, buckets)
        at = store.pointer()
        if at.batch >= n:
            return
        came = batch.select(F.col(doc).alias("doc"), F.col(item).alias("item")).filter("doc is not null and item is not null")
        came = written(came, "graph-batch")
        touched = store.touched(came, ["doc"])
        held = store.read("baskets", touched, at)
        held = came.limit(0) if held is None else held
        rows = came.count() + (at.rows("baskets", touched) or 0)
        all_ = written(baskets(came, held, graph.tasks(spark, rows, graph.ROWS)), "graph-baskets")
        docs, total = all_.filter("first").agg(F.count_if(F.col("n") == F.col("m")), F.sum(F.expr("m * (m - 1) div 2 + m * (n - m)"))).first()
        tasks = max(graph.tasks(spark, rows, graph.ROWS), graph.tasks(spark, total or 0, graph.PAIRS))
        pairs = written(delta_pairs(all_, tasks, large), "graph-pairs")
        items = written(all_.filter("new").groupBy("item").agg(F.count(F.lit(1)).alias("n")), "graph-items")
        staged = {
            "pairs": added(store, at, "pairs", pairs, ["a", "b"], "co"),
            "items": added(store, at, "items", items, ["item"], "n"),
            "baskets": store.stage("baskets", all_.select("doc", "item"), ["doc"], touched, rows),
        }
        store.commit(staged, batch=n, facts={"docs": at.facts.get("docs", 0) + docs})
        store.vacuum()
        removed(came, all_, pairs, items)

    return each


def edges(store: Store, least_co: int = 1, least_confidence: float = 0.0, least_source: int = 1, places: int = 3) -> DataFrame | None:
    """The directed edges of the stored graph, as graph.co_citation() mines them from the whole bridge; None before a batch."""
    at = store.pointer()
    pairs = store.read("pairs", at=at)
    if pairs is None:
        return None
    total = store.spark.range(1).select(F.lit(at.facts["docs"]).alias("n_docs"))
    return directed(pairs.filter(F.col("co") >= least_co), store.read("items", at=at), total, least_confidence, least_source, places)
