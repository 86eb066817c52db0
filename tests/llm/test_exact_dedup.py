import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exact_dedup as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp_a string, kept int"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode().lower()].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, kept = max(known) if known else None, False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text).hexdigest()))
            kept |= i == keep
    return sorted(out, key=str)


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in rows], DOCS)
    return sorted([tuple(r) for r in X.exact_duplicates(docs, **options).drop("n_bytes").collect()], key=str)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999 + "y"), (9, "abc"), (2, "aBC"), (None, "abc"), (None, "lone"), (None, "lone")]


def test_against_brute_force(spark):
    assert rows_of(spark, ROWS) == brute(ROWS)
    assert rows_of(spark, []) == []


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, f"text {i % 37}") for i in range(300)]
    assert rows_of(spark, rows, primes=(3, 2)) == brute(rows)


def test_keep_one(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash", 1) for i, t in ROWS], DOCS)
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").encode().lower() for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").encode().lower() for _, t in ROWS})
    plain = spark.createDataFrame([(i, f"t{i % 3}", "en", "s", None, "c", 1) for i in range(9)], DOCS)
    assert sorted(r.doc_id for r in X.keep_one(plain).collect()) == [6, 7, 8]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=9000), max_size=6), st.integers(0, 9000))
def test_fingerprints_compose(texts, cut):
    got = X.Fingerprints(rows=2).of(texts)
    for t, (a, b) in zip(texts, got):
        for h, p, base in zip((a, b), X.PRIMES, X.BASES):
            slow = 0
            for c in t[:500] if len(t) <= 500 else b"":
                slow = (slow * base + c) % p
            if len(t) <= 500:
                assert h == slow
        left, right = X.Fingerprints().of([t[:cut], t[cut:]])
        assert X.combine((left[0], len(t[:cut])), (right[0], len(t[cut:]))) == (a, len(t))


def test_columns_of_the_caller_stay(spark):
    rows = [(i // 2 if i < 6 else None, f"t{i % 4}", f"sha{i}", f"id{i}", i, f"c{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _id string, _row long, _copy string")
    kept = X.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted([tuple(r) for r in kept.collect()], key=str)
    assert set(got) <= set(rows) and sorted(r[1] for r in got) == ["t0", "t1", "t2", "t3"]
    for r in got:  # the largest doc_id of a text stays
        assert (r[0] is not None, r[0]) == max((x[0] is not None, x[0]) for x in rows if x[1] == r[1] and x[0] is not None)


def test_a_hot_row(spark):
    docs = spark.range(150_000).selectExpr("cast(null as long) as doc_id", "'same' as text").unionByName(spark.createDataFrame([(5, "Same"), (6, "other")], "doc_id long, text string"))
    out = X.exact_duplicates(docs)
    assert [tuple(r) for r in out.groupBy("doc_id", "keep_id", "group_size", "kept").count().orderBy("doc_id").collect()] == [(None, 5, 150_001, False, 150_000), (5, 5, 150_001, True, 1), (6, 6, 1, True, 1)]
    assert sorted(r.text for r in X.keep_one(docs).collect()) == ["Same", "other"]
