"""Operators and queries over whole tables, against brute force."""

import random
import re
from collections import Counter

from tessera.operators import graph, lineage
from tessera.plans import registry


def family(n, seed=3):
    """Copies of one text with up to three words changed."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        copy = list(words)
        for at in rng.sample(range(120), rng.randrange(4)):
            copy[at] = f"x{rng.randrange(9999)}"
        out.append((i, " ".join(copy) + f" end{i}"))
    return out


def test_pairs_of_a_family_above_the_limit(spark):
    rows = family(230)
    sets = []
    for _, t in rows:
        w = re.findall("[a-z0-9]+", t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = {(a, b) for b in range(230) for a in range(b) if round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.8}
    got = {(r.a, r.b) for r in lineage.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 10000


def test_tiles_lose_and_repeat_no_pair(spark):
    signed = spark.createDataFrame([(i, [1, 2, 3, 4] if i < 40 else [5, 6, i, i]) for i in range(50)], "doc long, sig array<bigint>")
    pairs = [(r.a, r.b) for r in lineage.candidate_pairs(signed, 2, 4, 7).collect()]
    assert sorted(pairs) == sorted((a, b) for b in range(50) for a in range(b) if b < 40 or a >= 40)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return len(at) == 1 or len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]


def test_typos_of_all_parts(spark, tmp_path):
    rng = random.Random(2)
    parts = [*range(1, 40), *range(95, 130), *range(980, 1300, 3)]
    lines = [(d, p) for d in range(400) for p in rng.sample(parts, 6)]
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    close = lambda unknown: [(u, k) for u in unknown for k in map(str, parts) if len(u) > 2 and len(k) > 2 and one_edit(u, k)]
    got = [(r.unknown, r.known) for r in registry.QUERIES["typo_candidates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(close([str(p * 10 + 1) for p in parts]))
    by_doc, tie = {}, {}
    for d, p in lines:
        by_doc.setdefault(d, set()).add(p)
    co = {}
    for items in by_doc.values():
        for x in items:
            for y in items - {x}:
                co[x, y] = co.get((x, y), 0) + 1
    for (x, _), n in co.items():
        tie[str(x)] = tie.get(str(x), 0) + (n if n >= 2 else 0)
    best = {}
    for u, k in close([str(p * 10) for p in parts]):
        if tie.get(k):
            best[u] = max(best.get(u, (0, 0, "")), (tie[k], -int(k), k))
    got = {r.unknown: (r.suggestion, r.strength) for r in registry.QUERIES["typo_suggestion"](spark, str(tmp_path)).collect()}
    assert got == {u: (k, n) for u, (n, _, k) in best.items()} and any(u != k + "0" for u, (k, _) in got.items())


def test_citations_anywhere_in_a_text_count(spark, tmp_path):
    long = "plain words go on and on for more than forty characters " * 3
    rows = [(i, long + ("then IS 8130 applies" if i < 8 else "and nothing is cited")) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.found for r in registry.QUERIES["citation_extraction"](spark, str(tmp_path)).collect()}
    assert all("IS 8130" in found[i] for i in range(8)) and found[0] == "IS 694; IS 1000; IS 8130" and found[15] == "" and found[14] == "IS 24 (Part 5); IS 24; IS 142001"
    route = {r.doc_id: r.route for r in registry.QUERIES["query_router"](spark, str(tmp_path)).collect()}
    assert route[1] == route[5] == "audit" and route[9] == "draft" and route[8] == "audit"


def test_whole_texts_are_expanded(spark, tmp_path):
    from tessera.functions import fixed

    texts = ["far behind the first twenty characters stand GI pipes", "xlpe, ms and MS near potable water", "nothing here", None, "ABC abc street lights\nearthing", "glt lt2 HT", "galvanised iron"]
    rows = [(i, t) for i, t in enumerate(texts * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cases = ["XLPE cable", "MS and ms pipe", "street lighting", "gi GI galvanized iron", ""]
    fence = lambda k: rf"(?<![A-Za-z0-9]){re.escape(k)}(?![A-Za-z0-9])"

    def brute(i, text):
        q = "\n".join(x for x in (text, cases[i % 5]) if x is not None)
        found = [v for k, v in fixed.EXPANSIONS.items() if re.search(fence(k), q, re.I)] + [v for k, v in fixed.STRICT_EXPANSIONS.items() if re.search(fence(k), q)] + [v for k, v in fixed.PHRASES.items() if re.search(k, q, re.I)]
        return " ".join([q, *dict.fromkeys(found)]) if found else q

    got = {r.doc_id: r.expanded for r in registry.QUERIES["query_expansion"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(i, t) for i, t in rows}


def test_typed_sort_places_every_row(spark, tmp_path):
    rng = random.Random(4)
    parts = [(i, f"Brand#{rng.randrange(30)}", rng.randrange(60)) for i in range(3000)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    order = sorted(parts, key=lambda p: (True, p[1], p[0]) if p[0] % 4 == 0 else (False, p[2], p[0]))
    got = {r.k: r.place for r in registry.QUERIES["typed_sort"](spark, str(tmp_path)).collect()}
    assert got == {p[0]: i + 1 for i, p in enumerate(order)}


def test_long_paths_and_none(spark):
    from tessera.operators import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(100, 101)], "a long, b long")
    r = graph.shortest_path(chain, 0, 11).first()
    assert r.hops == 11 and r.path == list(range(12))
    assert graph.shortest_path(chain, 0, 101).first().hops is None and graph.shortest_path(chain, 3, 3).first().hops == 0


def test_bands_meet_at_low_thresholds():
    assert [lineage.band_rows(t) for t in (0.95, 0.8, 0.65, 0.5, 0.35)] == [4, 4, 3, 2, 2]
    for t in (0.8, 0.65, 0.5, 0.35):
        rows = lineage.band_rows(t)
        assert (1 - t**rows) ** (128 // rows) < 3e-4


def test_text_keys_break_ties_by_the_least(spark):
    from tessera.operators import resolve, rollup

    b = spark.createDataFrame([("x", d, i, True) for d in range(10) for i in ("b", "a")], "buyer string, doc long, item string, dead boolean")
    assert rollup.buyers(b, ["buyer"], "doc", "item", 10, 5).first().top_dead == "a"
    members = spark.createDataFrame([(1, "q"), (2, "q"), (3, "p"), (4, "p")], "doc long, cluster string")
    r = lineage.travelling(members, spark.createDataFrame([(d, "i") for d in range(1, 5)], "doc long, item string"), "doc", "item").first()
    assert (r.shared, r.cluster, r.cluster_size) == (2, "p", 2)
    c = spark.createDataFrame([("u", "kb"), ("u", "ka")], "unknown string, known string")
    edges = spark.createDataFrame([("ka", "z", 3), ("kb", "z", 3)], "a string, b string, n long")
    assert resolve.typo_choice(c, spark.createDataFrame([("u", "z")], "unknown string, beside string"), edges).first().suggestion == "ka"


def test_many_query_vectors_go_in_blocks(spark, monkeypatch):
    from tessera.operators import retrieve

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<double>")
    whole = sorted(tuple(r) for r in retrieve.nearest(v.filter("id < 9"), "id", v, "id", "v", 4, 9).collect())
    monkeypatch.setattr(retrieve, "VECTOR_BYTES", 3 * 1024 * 4)
    assert sorted(tuple(r) for r in retrieve.nearest(v.filter("id < 9"), "id", v, "id", "v", 4).collect()) == whole and len(whole) == 36


def test_layouts_of_too_many_nodes_are_refused(spark):
    import pytest

    from tessera.operators import graph

    pairs = spark.createDataFrame([(i, i + 1, 0.5) for i in range(30)], "a long, b long, confidence double")
    with pytest.raises(ValueError):
        graph.layout(pairs, most=10)
    at = {r.node: (r.x, r.y) for r in graph.layout(pairs).collect()}
    assert len(at) == 31 and at == {r.node: (r.x, r.y) for r in graph.layout(pairs.repartition(3)).collect()}


def test_baskets_cut_into_tiles_give_the_same_edges(spark):
    rng = random.Random(8)
    rows = [(d, rng.randrange(40)) for d in range(12) for _ in range(3 + 9 * (d % 4))] + [(None, 1), (None, 2), (3, None)]
    bridge = spark.createDataFrame(rows, "doc int, item int")
    whole, cut = (sorted(map(tuple, graph.co_citation(bridge, "doc", "item", large=n).collect())) for n in (4096, 5))
    held = {}
    for d, i in rows:
        if d is not None and i is not None:
            held.setdefault(d, set()).add(i)
    want = Counter((a, b) for items in held.values() for a in items for b in items if a != b)
    assert whole == cut and {(r[0], r[1]): r[4] for r in cut} == want


def test_shingle_sets_against_plain_sets(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d", "a b c d e", "x " * 300, "Ä a-b C.d e f"] + [" ".join(rng.choice("pqr") for _ in range(rng.randrange(60))) for _ in range(80)]
    got = {r.doc: r.s for r in lineage.shingled(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}
    plain = {}
    for k, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        plain[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert set(got) == {k for k, s in plain.items() if s}
    assert all(list(s) == sorted(set(s)) and len(s) == len(plain[k]) for k, s in got.items())
    assert all(len(set(got[a]) & set(got[b])) == len(plain[a] & plain[b]) for a in got for b in got)
