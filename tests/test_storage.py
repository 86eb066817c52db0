"""Stores: versions and pointers, amended buckets, failures on the way, and what streams keep in them."""

import itertools
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import sinks, storage, tables
from tessera.sources.storage import Store
from tessera.streaming import graph as citations
from tessera.streaming import streams


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(1000)
    assert sinks.loaded(df, path, "t") == 1000
    dies = df.repartition(8).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        Store(spark, path).replace("t", dies)
    assert Store(spark, path).read("t").count() == 1000 == tables.previous(spark, path, "t")
    for bad in ('{"version": 7, "ba', ""):  # a writer that died within its pointer
        n = max(Store(spark, path)._numbers()) + 1
        (tmp_path / f"s/_pointers/{n:012d}.json").write_text(bad)
    assert Store(spark, path).read("t").count() == 1000
    with pytest.raises(ValueError):
        sinks.loaded(df.limit(10), path, "t")
    assert sinks.loaded(df.limit(10), path, "t", allow_shrink=True) == 10 == Store(spark, path).read("t").count()
    Store(spark, path).vacuum()
    assert Store(spark, path).read("t").count() == 10 and len(Store(spark, path)._numbers()) == 1


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.replace("t", spark.range(3))
    monkeypatch.setattr(store, "_numbers", lambda: [])  # as if it had not seen the other
    with pytest.raises(Exception, match="exists"):
        store.replace("t", spark.range(4))


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "u")
    each = streams.upsert_into(path, "k", "v", buckets=8)
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v long")
    each(rows(range(100), 1), 0)
    before = files(path)
    own = Store(spark, path, 8).touched(rows([5, 17], 2), ["k"])
    each(rows([5, 17], 2), 1)
    after = files(path)
    assert len(own) <= 2 and {f.split("_bucket=")[1][0] for f in before ^ after} == {str(b) for b in own}
    each(rows(range(100), 9), 1)  # the same number again
    each(rows([5], 0), 2)  # an older row doesn't win
    assert {r.k: r.v for r in Store(spark, path, 8).read("rows").collect()} == {k: 2 if k in (5, 17) else 1 for k in range(100)}


def expected(rows):
    baskets = {}
    for d, i in rows:
        if d is not None and i is not None:
            baskets.setdefault(d, set()).add(i)
    n, co = Counter(i for b in baskets.values() for i in b), Counter(p for b in baskets.values() for p in itertools.permutations(b, 2))
    return {(a, b, n[a], n[b], c, round(c / n[a], 6), round(c * len(baskets) / (n[a] * n[b]), 6)) for (a, b), c in co.items()}


@pytest.mark.parametrize("large", [4096, 2])
def test_batches_of_citations_give_the_whole_graph(spark, tmp_path, large):
    path = str(tmp_path / "g")
    each = citations.co_citations_into(path, buckets=4, large=large)
    store = Store(spark, path, 4)
    assert citations.edges(store) is None
    batches = [[(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)], [(1, "b"), (1, "c"), (1, "d"), (4, "a"), (4, "c"), (4, "c")], [], [(2, "b"), (2, "c"), (2, "d"), (2, "e"), (5, "z")]]
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        df = spark.createDataFrame(rows, "doc long, item string")
        each(df, n)
        got = {tuple(r) for r in citations.edges(store, places=6).collect()}
        assert got == expected(seen)
        assert {tuple(r) for r in graph.co_citation(spark.createDataFrame(seen, "doc long, item string").dropna(), "doc", "item", places=6).collect()} == got
    before = files(path)
    each(spark.createDataFrame([(9, "p"), (9, "q")], "doc long, item string"), 3)  # sent again
    assert files(path) == before and store.pointer().facts["docs"] == 4


def test_joins_of_bucketed_tables_shuffle_nothing(spark, tmp_path):
    a = storage.bucketed(spark.range(500).select((F.col("id") % 50).alias("doc"), F.col("id").alias("item")), "bucketed_a", str(tmp_path / "a"), "doc", 4, "item")
    b = storage.bucketed(spark.range(50).select(F.col("id").alias("doc"), F.lit("x").alias("y")), "bucketed_b", str(tmp_path / "b"), "doc", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = a.join(b, "doc").groupBy("doc").count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and out.count() == 50
        assert spark.sql("DESCRIBE EXTENDED bucketed_a doc").filter("info_name = 'distinct_count'").first().info_value in map(str, range(45, 56))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE {t}")
