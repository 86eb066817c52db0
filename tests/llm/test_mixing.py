import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing as M

DOCS = "doc_id long, text string, source string, lang string, size string, block int, p int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "clash", 1, 2) for i, t, s in rows], DOCS)


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if level * weight[s] > 2 * size[s]}
        if not new:
            return {s: 2.0 * size[s] if s in full else level * weight[s] for s in order}
        full |= new


def random_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "é", "z", None, "tiny"]
    return [(i, " ".join("w" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 60)))) or None, sources[int(rng.choice(6, p=[0.5, 0.2, 0.15, 0.1, 0.04, 0.01]))]) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 16])
def test_targets_are_met(spark, block):
    rows = random_rows(3000)
    got = M.mix(docs(spark, rows), block=block, fan_in=4).collect()
    want = brute_targets(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60  # one document
    again = M.mix(docs(spark, rows).repartition(7), block=block, fan_in=4).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_copies_keep_their_expectation(spark):
    rows = [(100 * k + i, "w " * (1 + i % 5), s) for k, s in enumerate("abc") for i in range(40)]
    total = Counter()
    for seed in range(8):
        for r in M.mix(docs(spark, rows), seed=seed, block=8, fan_in=2).collect():
            total[r.doc_id] += r.copies
    r = brute_targets(rows)["b"] / 120
    mean = sum(total[100 + i] for i in range(40)) / 8 / 40
    assert 0 < r < 1 and abs(mean - r) < 0.1
    assert all(0 < total[100 + i] <= 8 for i in range(40)) and len({total[100 + i] for i in range(40)}) > 1


def test_odd_tables(spark):
    assert M.mix(docs(spark, [])).collect() == []
    assert [(r.size, r.taken, r.target) for r in M.mix(docs(spark, [(1, None, "a"), (2, " \n", None)])).collect()] == [(0, 0, 0.0)] * 2
    rows = [(1, "a b", "s")] * 5 + [(None, "c d e", None), (7, "x " * 70_000, "t")]
    got = M.mix(docs(spark, rows)).collect()
    assert len(got) == 7 and max(r.size for r in got) == 70_000


def test_mixed_repeats_rows(spark):
    rows = random_rows(500) + [(3, "same row", "a")] * 4
    df = docs(spark, rows)
    out = M.mixed(df)
    assert out.columns == df.columns
    want = sum(r.taken for r in M.mix(df).collect())
    assert sum(len((r.text or "").split()) for r in out.collect()) == want
    assert max(Counter((r.doc_id, r.text) for r in out.collect() if r.text != "same row").values()) <= 2


def test_columns_of_the_caller_stay_and_equal_rows_share(spark):
    rows = [(i % 5 if i % 7 else None, "a b c " * (i % 3), f"s{i % 2}", f"id{i}", i, i, i, i, f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _hash long, _n long, _copies long, _rows long, _place string")
    out = M.mixed(df)
    assert out.columns == df.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows)
    want, mine = Counter(), Counter()
    for r in M.mix(df).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    for r, n in got.items():
        mine[r[0], r[2], len(r[1].split())] += n
    assert mine == +want
    by = defaultdict(list)  # rows equal in doc_id, source and text differ by one copy at most
    for r in rows:
        by[r[:3]].append(got[r])
    assert all(max(x) - min(x) <= 1 for x in by.values())


def test_a_hot_row(spark):
    df = spark.range(150_000).selectExpr("1L as doc_id", "'a b' as text", "'s' as source", "id as _id").unionByName(spark.createDataFrame([(2, "c " * 400, "t", 7)], "doc_id long, text string, source string, _id long"))
    out = M.mixed(df)
    assert out.filter("doc_id = 1").count() * 2 == sum(r.taken for r in M.mix(df).filter("doc_id = 1").selectExpr("sum(taken) as taken").collect())
    assert out.filter("doc_id = 1").groupBy("_id").count().agg({"count": "max"}).first()[0] <= 2
