"""Queries against their SQL where part keys have seven digits and brackets follow what a document names."""

import duckdb
import pytest
from test_queries import SF, TABLES, rows_of

from tessera.functions import citations, ids
from tessera.operators import resolve
from tessera.plans import registry

QUERIES = "audit_suggestions audit_summaries designation_keys desk_reports related_or_by_digits repair_intruders repair_plan repair_verified repaired_documents reread_report suggestions_by_cause unmatched_citations".split()
SHIFT = 1_000_000


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """The smallest tables, with the parts of every other order moved above a million, part 10 withdrawn and short texts with brackets."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    made = {
        "part": f"SELECT * REPLACE (CASE p_partkey WHEN 10 THEN 45 ELSE p_size END::INT AS p_size) FROM src UNION ALL SELECT * REPLACE (p_partkey + {SHIFT} AS p_partkey) FROM src",
        "lineitem": f"SELECT * REPLACE (l_partkey + CASE WHEN l_orderkey % 2 = 0 THEN {SHIFT} ELSE 0 END AS l_partkey) FROM src",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id % 5 < 2 THEN '(5)(6)' ELSE text END AS text) FROM src",
    }
    for t in TABLES:
        body = made.get(t, "SELECT * FROM src").replace("src", f"'{SF}/{t}.parquet'")
        con.execute(f"COPY ({body}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_large_keys_and_brackets(spark, large, name):
    folder, con = large
    df = registry.QUERIES[name](spark, folder)
    cur = con.execute(registry.SQL[name])
    columns = [c[0] for c in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_digits_of_the_longest_number(spark):
    text = "IS 1234567 and IS 20622006, IS 77 (587)"
    df = spark.createDataFrame([(text, "IS 1234567")], "t string, d string")
    row = df.select(citations.extract(df.t).alias("six"), citations.extract(df.t, 19).alias("any"), citations.bases(df.t, 19).alias("bases"), ids.number(df.d).alias("n6"), ids.number(df.d, 19).alias("n")).first()
    assert row.six == ["IS 2062", "IS 77 (587)"] and row.any == ["IS 1234567", "IS 20622006", "IS 77 (587)"]
    assert row.bases == ["IS 1234567", "IS 20622006", "IS 77"] and (row.n6, row.n) == ("", "1234567")


def test_empty_keys(spark):
    cited = spark.createDataFrame([("IS 7654321",), ("IS 12",)], "c string")
    held = spark.createDataFrame([("IS 1234567",)], "n string")
    assert sorted(r.c for r in resolve.unmatched(cited, "c", held, "n").collect()) == ["IS 12", "IS 7654321"]
    assert [r.c for r in resolve.unmatched(cited, "c", held, "n", blank=True).collect()] == ["IS 12"]
