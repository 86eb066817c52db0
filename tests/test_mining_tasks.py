"""Mining of pairs is dealt over tasks by the size of the table, not by a fixed number."""

from collections import Counter
from functools import partial

from pyspark.sql import functions as F

from tessera.operators import audit, checks, graph, merge, resolve
from tessera.operators import components as settling
from tessera.plans import base
from tessera.sources import storage
from tessera.streaming import graph as citations


def test_tasks_grow_with_citations_and_pairs(spark):
    rows = [(i // 5, i * i % 23) for i in range(600)] + [(None, 1), (4, None)]
    bridge = spark.createDataFrame(rows, "doc long, item long")
    held = {}
    for d, i in rows:
        if d is not None and i is not None:
            held.setdefault(d, set()).add(i)
    want = Counter((a, b) for items in held.values() for a in items for b in items if a < b)
    by_rows, by_pairs = (graph.dealt_pairs(bridge, **limits)[0] for limits in ({"rows": 10}, {"most": 12}))
    assert by_rows.rdd.getNumPartitions() == 61 and by_pairs.rdd.getNumPartitions() >= 90
    assert all({(r.a, r.b): r.co for r in p.collect()} == want for p in (by_rows, by_pairs))


def test_edges_meet_the_counts_of_their_ends_in_as_many_tasks(spark, monkeypatch):
    rows = [(i // 5, i * i % 23) for i in range(600)] + [(None, 1), (4, None)]
    bridge = spark.createDataFrame(rows, "doc long, item long")
    whole = {tuple(r) for r in graph.co_citation(bridge, "doc", "item", places=6).collect()}
    monkeypatch.setattr(graph, "dealt_pairs", partial(graph.dealt_pairs, rows=10))
    n, edges = graph.dealt_pairs(bridge)[1], graph.co_citation(bridge, "doc", "item", places=6)
    assert n.rdd.getNumPartitions() == 61 and edges.rdd.getNumPartitions() == 61
    assert {tuple(r) for r in edges.collect()} == whole
    assert {r.item: r.n for r in n.collect()} == Counter(i for _, i in set(rows))


def test_tasks_of_a_batch_and_of_the_store_grow_with_their_rows(spark, tmp_path, monkeypatch):
    rows = sorted({(i // 5, i * i % 23) for i in range(600)})
    monkeypatch.setattr(graph, "ROWS", 20)
    monkeypatch.setattr(graph, "PAIRS", 40)
    monkeypatch.setattr(storage, "ROWS", 10)
    dealt = []
    write = storage.Store.dealt
    monkeypatch.setattr(storage.Store, "dealt", lambda *a: dealt.append(write(*a).rdd.glom().map(len).collect()) or write(*a))
    path = str(tmp_path / "g")
    each, mine = citations.co_citations_into(path, buckets=2), citations.delta_pairs
    parts = []
    monkeypatch.setattr(citations, "delta_pairs", lambda *a: parts.append(mine(*a).rdd.getNumPartitions()) or mine(*a))
    for n in range(2):
        each(spark.createDataFrame(rows[n::2], "doc long, item long"), n)
    got = {tuple(r) for r in citations.edges(storage.Store(spark, path, 2), places=6).collect()}
    assert got == {tuple(r) for r in graph.co_citation(spark.createDataFrame(rows, "doc long, item long"), "doc", "item", places=6).collect()}
    assert len(parts) == 2 and min(parts) > 10  # by rows and pairs, not by a setting
    assert max(max(n) for n in dealt) <= 3 * storage.ROWS and max(len(n) for n in dealt) > 20  # a bucket has several tasks


def test_bridge_and_missing_items_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    lines = spark.range(400).select((F.col("id") % 90).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(base, "ROWS", 10)
    monkeypatch.setattr(audit, "ROWS", 10)
    bridge = base.Tables(spark, str(tmp_path)).bridge
    assert bridge.rdd.getNumPartitions() == 40 and bridge.count() == len({(i % 90, i % 7) for i in range(400)})
    cited = bridge.select("doc", F.col("item").alias("place"), "item", F.lit(None).cast("long").alias("base"), F.col("item").alias("key"))
    edges = spark.createDataFrame([(3, 20, 20, 0.5, 9, "Current"), (3, 4, 4, 0.9, 9, "Withdrawn")], "src long, dst long, dst_key long, confidence double, co long, dst_status string")
    found = audit.missing_connected(cited, edges, 0.1, 1)
    assert found.rdd.getNumPartitions() >= 30
    assert {(r.doc, r.item, r.subject) for r in found.collect()} == {(i % 90, "20", "3") for i in range(400) if i % 7 == 3}


def test_candidates_are_not_paired_with_all_that_stands_beside(spark):
    n, u = 1500, F.concat(F.lit("u"), (F.col("id") % 1).cast("string")).alias("unknown")
    candidates = spark.range(n).select(u, F.col("id").cast("string").alias("known"))
    beside = spark.range(n).select(u, (F.col("id") + n).cast("string").alias("beside"))
    edges = spark.createDataFrame([("7", str(n + 1), 2), ("9", str(n + 2), 3), (str(n + 5), "99999", 8)], "a string, b string, n long")
    out = resolve.typo_choice(candidates, beside, edges)
    assert [tuple(r) for r in out.collect()] == [("u0", "9", 3)]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and not any(x.count("unknown") and x.count("=") == 1 for x in joins)  # none by the unknown alone


def test_accounted_keys_are_dealt_over_the_tasks_asked_for(spark):
    k = spark.range(100).withColumnRenamed("id", "k")
    out = checks.accounted(k, [k.filter("k < 50"), k.filter("k between 49 and 97")], "k", 9)
    assert out.rdd.getNumPartitions() == 9 and {r.k for r in out.collect()} == {49, 98, 99}


def mined(spark, n=600):
    return graph.co_citation(spark.createDataFrame([(i // 5, i * i % 23) for i in range(n)], "doc long, item long"), "doc", "item", places=6)


def same(a, b):
    rows = [Counter(tuple(r) for r in x.select(sorted(x.columns)).collect()) for x in (a, b)]
    return rows[0] == rows[1] and bool(rows[0])


def test_what_comes_after_the_edges_takes_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    nodes = spark.range(30).select(F.col("id").alias("node"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("family"))
    e, n = graph.stored(mined(spark), nodes)
    assert n == -(-e.count() // 10) == 8 and graph.stored(e.limit(3), spark.range(95))[1] == 10
    u = graph.undirected(e, n)
    seen = {
        "undirected": (u, graph.undirected(e)),
        "edge_cap": (graph.edge_cap(u, 2, n), graph.edge_cap(graph.undirected(e), 2)),
        "degrees": (graph.degrees(e, parts=n), graph.degrees(e)),
        "visible": (graph.visible(u, nodes, 2, "f1", n)[1], graph.visible(graph.undirected(e), nodes, 2, "f1")[1]),
        "gaps": (merge.ranked_gaps(e, [e.select("src"), e.select("dst")], nodes.filter("node % 2 = 0"), "node", n), merge.ranked_gaps(e, [e.select("src"), e.select("dst")], nodes.filter("node % 2 = 0"), "node")),
        "endpoints": (checks.endpoints_known(e, nodes.filter("node % 2 = 0"), "node", n), checks.endpoints_known(e, nodes.filter("node % 2 = 0"), "node")),
    }
    for name, (dealt, plain) in seen.items():
        assert same(dealt, plain), name
        if name not in ("gaps", "endpoints"):  # a broadcast side leaves the rows of an anti-join where they are read
            assert dealt.rdd.getNumPartitions() == n, name
    assert same(graph.densest(e, 9, parts=n), graph.densest(e, 9))


def test_places_on_a_ring_are_counted_over_ranges(spark):
    rows = [(k, None if k % 7 == 0 else f"f{k % 7 % 3}", k % 5) for k in range(200)]
    ring = graph.family_shares(spark.createDataFrame(rows, "node long, family string, degree long"), "family", "degree", "node", 9)
    assert ring.columns == ["node", "family", "degree", "place", "n", "share"] and dict(ring.dtypes)["place"] == "int"
    want, held = [], {}
    for k, f, d in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -r[2], r[0])):
        held[f] = held.get(f, 0) + 1
        want.append((k, f, d, held[f]))
    got = ring.collect()
    assert [tuple(r)[:4] for r in got] == want and all((r.n, r.share) == (held[r.family], round(held[r.family] / 200, 4)) for r in got)
    assert ring.rdd.getNumPartitions() == 9


def test_components_take_tasks_by_their_links(spark, monkeypatch):
    monkeypatch.setattr(settling, "EACH", 16)
    links = spark.range(300).select(F.lit(500).cast("long").alias("a"), (F.col("id") + 501).alias("b")).unionByName(spark.range(80).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 9 == 8, 0).otherwise(1)).alias("b")))
    dealt, star = [], settling._star

    def seen(*a):  # a round's table goes with the next, so its tasks are counted here
        out = star(*a)
        dealt.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(settling, "_star", seen)
    found = graph.components(links, "a", "b", parts=12)
    assert dealt[0] == 12
    assert same(found, graph.components(links, "a", "b"))
