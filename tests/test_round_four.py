"""Queries against their SQL, and operators, on inputs that only large tables hold."""

import duckdb
import pytest
from test_queries import SF, TABLES, rows_of

from pyspark.sql import functions as F

from tessera.plans import registry


def tables(folder, **made):
    """The smallest tables, with some made anew from ``src``; the folder, and a connection with views of them."""
    con = duckdb.connect()
    for t in TABLES:
        body = made.get(t, "SELECT * FROM src").replace("src", f"'{SF}/{t}.parquet'")
        con.execute(f"COPY ({body}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def same_as_sql(spark, name, folder, con):
    df = registry.QUERIES[name](spark, folder)
    cur = con.execute(registry.SQL[name])
    columns = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("text", ["- 7951 of it", ": 1987", "it is 19, is 18 and is 17 or is 16"])
def test_what_follows_a_replaced_citation_stays(spark, tmp_path, text):
    folder, con = tables(tmp_path, documents=f"SELECT * REPLACE ('{text}' AS text) FROM src", part="SELECT * REPLACE (CASE WHEN p_partkey % 2 = 0 THEN 45 ELSE 7 END::INT AS p_size) FROM src")
    same_as_sql(spark, "repaired_documents", folder, con)


@pytest.mark.parametrize("name", ["dense_topk", "rrf_fusion"])
def test_vectors_without_a_score(spark, tmp_path, name):
    """Vectors that are missing, equal, empty or shorter than others."""
    odd = "SELECT * REPLACE (CASE WHEN vec_id % 7 = 1 OR vec_id = 100 THEN NULL WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM src WHERE vec_id = 5) ELSE embedding END AS embedding) FROM src WHERE vec_id < 300"
    folder, con = tables(tmp_path, embeddings=odd)
    same_as_sql(spark, name, folder, con)


def test_blocks_give_every_pair(spark, monkeypatch):
    """Blocks smaller than the table, ties, string ids and vectors of two lengths, against a plain sort."""
    import numpy as np

    from tessera.operators import retrieve

    monkeypatch.setattr(retrieve, "VECTOR_BYTES", 1 << 14)
    rng = np.random.default_rng(1)
    v = [(f"d{i:04}", None if i % 11 == 0 else [float(x) for x in rng.integers(-2, 3, 4 if i % 5 else 3)]) for i in range(900)]
    df = spark.createDataFrame(v, "id string, v array<float>")
    got = retrieve.nearest(df.filter("id < 'd0040'"), "id", df, "id", "v", 7).collect()
    want = {}
    for q, a in v[:40]:
        score = [(None if a is None or b is None or len(a) != len(b) else sum(x * y for x, y in zip(a, b)), d) for d, b in v if d != q]
        want[q] = [(d, s) for s, d in sorted(score, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:7]]
    assert {q: [(r.doc, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] for q in want} == want


def test_second_ranking_compares_no_vectors(spark):
    from tessera.plans import retrieval
    from tessera.plans.base import Tables

    plan = retrieval.fused(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and plan.count("MapInArrow") <= 6


def test_words_of_the_mark_patterns(spark):
    """Texts are tested on words that every match has; and what looks behind is tried only where a designation may stand."""
    from tessera.functions import citations, fixed

    asks = ["Standard\nMARK", "an Isi mark", "certification  mark", "bis certified", "CM / L", "Licence  Number", "certified under a scheme of BIS", "shall be certified", "a QCO", "Quality control\torder"]
    assert len(fixed.MARK_WORDS) == len(fixed.MARK) == len(asks)
    df = spark.createDataFrame([(x,) for x in [*asks, "marks of quality, cm, licence, bis", None]], "t string")
    assert [r.d for r in df.select(citations.demands_mark(df.t).alias("d")).collect()] == [True] * len(asks) + [False, False]
    assert citations.CITATION.startswith("(?=IS)")
    df = spark.createDataFrame([("relevant IS 12, THIS 13, IS 14, IS/IEC 15 and ISO 16; IS: 17",)], "t string")
    assert df.select(citations.extract(df.t).alias("c")).first().c == ["IS 14", "IS 15", "IS 17"]


def test_a_second_audit_reads_no_text_again(spark):
    from tessera.operators import repair

    fixed = spark.createDataFrame([(1, "x"), (2, "y")], "doc long, t string")
    allowed = spark.createDataFrame([(1, "IS 12"), (2, "IS 12 (Part 1)")], "doc long, cite string")
    high = spark.createDataFrame([], "doc long, high long")
    found = spark.createDataFrame([(1, "IS 13"), (1, "IS 12"), (2, "IS 12")], "doc long, cite string")
    got = repair.verified(fixed, "doc", "t", allowed, high, found=found)
    assert {r.doc: (r.intruders, r.clean) for r in got.collect()} == {1: (["IS 13"], False), 2: ([], True)}


def test_a_long_text_does_not_fill_the_sketch(spark):
    """Pairs that come once each, many more than the bits of the former sketch have counts to tell apart, leave it closed."""
    import numpy as np

    from tessera.llm import collocations as C

    rng = np.random.default_rng(3)
    rows = [("en", " ".join(f"w{x}" for x in rng.integers(0, 2000, 4000)) + " often seen") for _ in range(50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    small = C.Sizes(slots=1 << 12, parts=4, counters=1 << 20)
    counted = C.text_pass(docs, [F.col("lang"), F.col("text")], C._first_pass(small), "lang string, word string, part int, n long, slots binary")
    bits = np.unpackbits(C.open_slots(counted, 30, small))
    assert 1 <= bits.sum() <= 10  # 200,000 pairs over 4,096 counters came to 48 in each
    got = C.mined(docs, least=30, top=3, sizes=small).collect()
    assert [(r.phrase, r.a) for r in got] == [("often seen", 50)]
