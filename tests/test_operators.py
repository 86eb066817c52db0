import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, checks, evaluate, graph, lineage, lookup, merge, repair, resolve, retrieve, rollup
from tessera.sources import sinks, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def greedy_cap(pairs, cap):
    kept, full = [], defaultdict(int)
    for a, b, co in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if full[a] < cap or full[b] < cap:
            kept.append((a, b, co))
            full[a] += 1
            full[b] += 1
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_edge_cap_is_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.randint(1, 6)) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "a long, b long, co long")
    assert rows(graph.edge_cap(df, 2).select("a", "b", "co")) == greedy_cap(pairs, 2)


def test_co_citation(spark):
    bridge = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "x"), (2, "y"), (3, "x"), (3, "z")], "doc int, item string")
    assert rows(graph.co_citation(bridge, "doc", "item", least_co=2)) == [("x", "y", 3, 2, 2, 0.667, 1.0), ("y", "x", 2, 3, 2, 1.0, 1.0)]
    best = graph.undirected(graph.co_citation(bridge, "doc", "item"))
    assert [(r.a, r.b, r.src) for r in best.orderBy("b").collect()] == [("x", "y", "y"), ("x", "z", "z")]
    assert graph.co_citation(bridge.limit(0), "doc", "item").collect() == []


def test_paths_and_neighbourhoods(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (8, 9)], "a long, b long")
    assert graph.shortest_path(pairs, 1, 4).first() == (2, [1, 5, 4])
    assert graph.shortest_path(pairs, 1, 1).first() == (0, [1])
    assert graph.shortest_path(pairs, 1, 9).first() == (None, None)
    c = dict(rows(graph.components(pairs, "a", "b")))
    assert c == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.5).alias("confidence"), F.lit(1).alias("co"))
    assert rows(graph.neighbourhood(edges, 1, 2)) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 1)]


def test_layout_stays_in_its_frame(spark):
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(i + 1, 12) if (i * j) % 3 == 0], "a long, b long, confidence double")
    got = graph.layout(pairs).collect()
    assert len(got) == 12 and all(26 <= r.x <= 1014 and 26 <= r.y <= 634 for r in got)
    q = graph.layout_quality(spark.createDataFrame([(r.node, r.x, r.y) for r in got], "node long, x double, y double")).first()
    assert q.spread_x > 0


def test_resolution_takes_one_row(spark):
    register = spark.createDataFrame([("IS 10 (Part 1)",), ("IS 10 (Part 2)",), ("IS/IEC 60947",)], "number string")
    cited = spark.createDataFrame([("IS 10 (Part 2)",), ("IS 10",), ("IS 60947",), ("IS 77",), (None,), ("IS 10",)], "cited string")
    got = [tuple(r) for r in resolve.resolve(cited, "cited", register, "number").orderBy("cited").collect()]
    assert got == [(None, None, None), ("IS 10", "IS 10 (Part 1)", "is_base_fallback"), ("IS 10", "IS 10 (Part 1)", "is_base_fallback"), ("IS 10 (Part 2)", "IS 10 (Part 2)", "exact"), ("IS 60947", "IS/IEC 60947", "number_fallback"), ("IS 77", None, None)]
    rules = spark.createDataFrame([("IS 10", "S1"), ("IS 60947", "S2")], "rule string, scheme string")
    got = resolve.two_step(cited.distinct(), "cited", rules, "rule", columns=["scheme"])
    assert {(r.cited, r.scheme, r.found_by) for r in got.collect() if r.cited} == {("IS 10", "S1", "exact"), ("IS 10 (Part 2)", "S1", "base"), ("IS 60947", "S2", "exact"), ("IS 77", None, None)}
    reg = spark.createDataFrame([("b", 1, "Withdrawn"), ("b", 2, "Current"), ("c", 3, "Withdrawn")], "k string, n int, s string")
    assert rows(resolve.prefer_current(reg, F.col("k"), "n", "s")) == [("b", 2, "Current"), ("c", 3, "Withdrawn")]
    assert rows(rollup.dead_bases(reg, F.col("k"), "s")) == [("c",)]


def test_lists(spark):
    df = spark.createDataFrame([(1, "b", "X_y"), (2, "a", "x%"), (3, None, "N/A")], "k int, s string, t string")
    page, total = lookup.paged(df, {"s": ""}, "x_", ["t"], key="k", limit=0)
    assert rows(page) == [(1, "b", "X_y")] and total.first()[0] == 1
    with pytest.raises(ValueError):
        lookup.paged(df, sort="t", key="k")
    assert rows(lookup.facet(df, "t")) == [("X_y",), ("x%",)]
    assert [r.k for r in df.orderBy(*lookup.typed_order(F.col("t")), "k").collect()]
    assert rows(lookup.hash_sample(df, "k", 2, 1)) == rows(lookup.hash_sample(df.repartition(3), "k", 2, 1))


def test_merges(spark):
    m = spark.createDataFrame([("IS 1", 1990, "a"), ("IS 2", None, "b")], "n string, y int, p string")
    f = spark.createDataFrame([("IS 2", 2000), ("IS 3", 1)], "n string, y int")
    assert rows(merge.refreshed(m, f, "n", ["y"])) == [("IS 1", 1990, "a"), ("IS 2", 2000, "b")]
    c = spark.createDataFrame([("IS 1 (Part 9)", 1, "x"), ("IS 7", 2, "x"), ("IS 7", 3, "x")], "n string, y int, p string")
    assert rows(merge.additive(m, c, "n")) == [("IS 7", 2, "x")]
    links = spark.createDataFrame([("l1", 1), ("l2", 2), ("l2", 3), ("l3", 3), ("l9", 9)], "link string, id int")
    held = spark.createDataFrame([("l1", 5), ("l7", 9)], "link string, id int")
    assert rows(merge.additive_two_keys(held, links, "link", "id", F.col("id"))) == [("l2", 2), ("l3", 3)]
    want = spark.createDataFrame([("IS 10553 (Part II)",), ("IS 60947",), ("IS 404",)], "w string")
    rec = spark.createDataFrame([("IS 10553 (Part 2)",), ("IS/IEC 60947",)], "number string")
    assert dict(rows(merge.gap_filled(want, "w", rec, "number"))) == {"IS 10553 (Part II)": "IS 10553 (Part 2)", "IS 60947": "IS/IEC 60947", "IS 404": None}
    assert {r.field: r.changed for r in merge.field_changes(m, merge.refreshed(m, f, "n", ["y"]), "n", ["y", "p"]).collect()} == {"y": 1, "p": 0}


def test_audit_and_repair(spark):
    per = spark.createDataFrame([(1, 2, 1, 0, 1, 0, 1), (2, 0, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0, 0)], "doc int, cited int, dispute int, omission int, missing int, unknown int, high int")
    said = {r.doc: r.summary for r in audit.summary(per, "cited").collect()}
    assert said[1] == "Blocking issues found. 2 citations checked: 1 citation no longer current; 1 entry usually cited with these."
    assert said[2] == "No citations found." and said[3] == "1 citation checked. Nothing flagged."
    dead = spark.createDataFrame([(1, "IS 303", "IS 8130"), (1, "IS 5", None)], "doc int, cite string, successor string")
    missing = spark.createDataFrame([(1, "IS 8130"), (1, "IS 99")], "doc int, cite string")
    keep = spark.createDataFrame([(1, "IS 1")], "doc int, cite string")
    duties = spark.createDataFrame([("IS 8130",)], "cite string")
    demands = spark.createDataFrame([(1, False)], "doc int, demands boolean")
    changes = repair.plan(dead, missing, keep, duties, demands)
    assert {(r.action, r.old, r.new) for r in changes.collect()} == {("replace", "IS 303", "IS 8130"), ("flag", "IS 5", None), ("add", None, "IS 99"), ("clause", None, None)}
    docs = spark.createDataFrame([(1, "Use IS:303 : 1989 and IS 5.")], "doc int, text string")
    fixed = repair.substituted(docs, "doc", "text", changes)
    assert fixed.first().fixed == "Use IS 8130 and IS 5."
    allowed = spark.createDataFrame([(1, "IS 8130"), (1, "IS 9")], "doc int, cite string")
    assert repair.intruders(spark.createDataFrame([(1, "Use IS 8130 and IS 55")], "doc int, fixed string"), "doc", "fixed", allowed).first().cite == "IS 55"


def test_evaluation(spark):
    df = spark.createDataFrame([(True, False)] * 20 + [(False, True)] * 13 + [(True, True)] * 5, "a boolean, b boolean")
    m = evaluate.mcnemar(df, F.col("a"), F.col("b")).first()
    assert (m.discordant, round(m.p, 3)) == (33, 0.296)
    none = evaluate.mcnemar(df.limit(0), F.col("a"), F.col("b")).first()
    assert (none.discordant, none.p) == (0, 1.0)
    big = spark.range(4000).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 2 == 1).alias("b"))
    assert evaluate.mcnemar(big, F.col("a"), F.col("b")).first().p == 1.0


def brute_jaccard(docs, t):
    sets = {k: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, x.split()) for k, x in docs)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_near_pairs_link_what_brute_force_links(spark, monkeypatch):
    rng = random.Random(4)
    docs = []
    for i in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for j in range(5):
            copy = list(words)
            if j:
                copy[rng.randrange(150)] = f"c{i}{j}"
            docs.append((len(docs), " ".join(copy if j < 4 else words)))
    df = spark.createDataFrame(docs, "k long, t string")
    want = brute_jaccard(docs, 0.8)

    def groups(pairs):
        label = {}
        for a, b in sorted(pairs):
            x, y = label.get(a, a), label.get(b, b)
            low = min(x, y)
            for k in [k for k in label if label[k] in (x, y)] + [a, b]:
                label[k] = low
        return label

    pairs = lineage.near_pairs(df, "k", "t")
    assert {(a, b) for a, b, _ in rows(pairs)} <= want
    assert groups({(a, b) for a, b, _ in rows(pairs)}) == groups(want)
    assert dict(rows(lineage.clusters(pairs))) == groups(want)


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿number,product\n"IS 1","two\nlines"\n"IS 2","a ""q"""\n'.encode())
    got = tables.csv(spark, str(path), "`number` string, product string")
    assert rows(got) == [("IS 1", "two\nlines"), ("IS 2", 'a "q"')]
    with pytest.raises(ValueError):
        tables.guarded(got, 10)
    assert tables.guarded(got, 2).count() == 2 and tables.guarded(got, 10, allow_shrink=True) is got
    with pytest.raises(ValueError):
        tables.guarded(got.limit(0), None)
    assert sinks.table(got, str(tmp_path / "t")) == 2
    with pytest.raises(ValueError):
        sinks.export_csv(got, str(tmp_path / "x"), "secret", ["register"])
    sinks.export_csv(got, str(tmp_path / "x"), "register", ["register"], quote_all=True)
    assert rows(tables.csv(spark, str(tmp_path / "x"), "`number` string, product string")) == rows(got)
    log = str(tmp_path / "log")
    sinks.decision(spark, log, "accepted", " ")
    sinks.decision(spark, log, "rejected", "me", "wrong")
    for bad in (("maybe", "x"), ("overridden", " ")):
        with pytest.raises(ValueError):
            sinks.decision(spark, log, bad[0], "me", bad[1])
    assert {(r.officer, r.decision) for r in spark.read.parquet(log).collect()} == {("unattributed", "accepted"), ("me", "rejected")}
    lines = tmp_path / "runs.jsonl"
    lines.write_text('{"started":"a","changed":1}\nnot json\n{"started":"b"}\n')
    assert [r.started for r in tables.json_lines(spark, str(lines), "started string, changed long").orderBy("started").collect()] == ["a", "b"]
    told = sinks.html_report(spark.createDataFrame([("s", "<b>", 2), ("s", "a", 1), ("s", None, 3), ("t", "x", 1)], "s string, c string, n int"), "s", ["c"], ["n"], 2)
    assert {r.section: r.html for r in told.collect()} == {"s": "<h2>s</h2>\n<table><tr><th>c</th></tr>\n<tr><td>a</td></tr>\n<tr><td>&lt;b&gt;</td></tr>\n</table>\n<p>and 1 more</p>", "t": "<h2>t</h2>\n<table><tr><th>c</th></tr>\n<tr><td>x</td></tr>\n</table>"}
    kinds = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"PK\x03\x04z"),), (bytearray(b"x"),)], "c binary")
    assert [r[0] for r in kinds.select(tables.container(F.col("c"))).collect()] == ["pdf", "docx", None]


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(checks.sets_agree(a, b, "k")) == [(1, "right"), (3, "left")]
    assert rows(checks.accounted(a, [a, b], "k")) == [(2, 2)]
    assert {"sets_agree", "answerable", "thresholds_hold", "reproduced"} <= set(checks.CHECKS)
    got = {r.check_name: r.passed for r in checks.report({"x": a, "y": a.limit(0)}).collect()}
    assert got == {"x": False, "y": True}


def test_registered_pipelines(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, "red bolt")], "k long, t string")
    q = spark.createDataFrame([("q", "red red ring")], "k string, t string")
    got = retrieve.search(q, "k", "t", docs, "k", "t", "bm25").orderBy("rank").collect()
    assert got[0].doc == 1
    with pytest.raises(ValueError):
        retrieve.search(q, "k", "t", docs, "k", "t", "llm_only")


def test_nothing_outside_names_the_corpus_operators():
    root = Path(graph.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tessera.llm" not in p.read_text() and "from .llm" not in p.read_text()
