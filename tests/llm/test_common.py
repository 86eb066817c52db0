from collections import Counter, defaultdict

import numpy as np
import pytest
import pyspark.sql.functions as F

from tessera.llm import common as K
from tessera.operators import plumbing
from tessera.operators.components import components


def test_exploded(spark, monkeypatch):
    monkeypatch.setattr(K, "ARRAY", 4)
    df = spark.createDataFrame([(1, 0, "x"), (2, 1, "y"), (3, 4, "z"), (4, 11, "w"), (5, None, "v")], "id long, n long, _top string")
    out = K.exploded(df, F.col("n"), "c")
    assert out.columns == ["id", "n", "_top", "c"]
    assert sorted((r.id, r._top, r.c) for r in out.collect()) == [(2, "y", 1), *((3, "z", i) for i in range(1, 5)), *((4, "w", i) for i in range(1, 12))]
    assert K.exploded(df.limit(0), F.col("n"), "c").collect() == []


def test_ranked_hot_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED", 10)
    df = spark.range(700).select(F.col("id").alias("_row"), F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("s").alias("_salt"))
    got = defaultdict(list)
    out = K.ranked(df, ["k"], "_row", "_m")
    assert out.columns[:3] == ["k", "_row", "_salt"] or set(out.columns) == {"k", "_row", "_salt", "_m"}
    for r in out.collect():
        assert r._salt == "s"
        got[r.k].append(r._m)
    assert sorted(got.pop("hot")) == list(range(1, 601)) and all(v == [1] for v in got.values()) and len(got) == 100


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_by_rounds_and_in_one_task(spark, few):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (260, 2))] + [(10_000 + i, 10_001 + i) for i in range(25)] + [(-500, i) for i in range(20_000, 20_050)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", few=few).collect()}
    assert got == {x: root(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", few=few).collect() == []


def test_tables_are_removed(spark):
    df = K.written(spark.range(5), "gone")
    path = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    import os

    assert os.path.isdir(path)
    K.removed(df, spark.range(2))
    assert not os.path.exists(path)


def test_explicit_batch_sizes_are_kept(spark):
    before = spark.conf.get(K.BATCH, None)
    try:
        spark.conf.set(K.BATCH, "10000")
        docs = spark.createDataFrame([("a",)] * 5, "text string")
        assert K.text_pass(docs, [F.col("text")], lambda it: it, "text string").count() == 5
        assert spark.conf.get(K.BATCH) == "10000"
    finally:
        spark.conf.unset(K.BATCH) if before is None else spark.conf.set(K.BATCH, before)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        applicationId = "x"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    monkeypatch.setattr(plumbing, "ship", lambda _: None)
    with pytest.raises(RuntimeError):
        K.shared_dir(Session())


def test_skew_join_counts(spark):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("_hot"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = K.skew_join(rows, groups, ["k"], "n", 3000, F.col("_hot"))
    assert Counter(r.n for r in out.collect()) == Counter({2001: 2001, 1: 999}) and set(out.columns) == {"k", "_hot", "n"}
