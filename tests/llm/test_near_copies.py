import numpy as np
import pyspark.sql.functions as F

from tessera.llm import near_copies as N

DOCS = "doc_id long, text string, lang string"


def grams(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows):
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(root(i), []).append(d)
    return sorted(min(x) for x in out.values())


def texts(families, copies, length=200, seed=9):
    """Copies with so many words changed that similarities lie around 0.8."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(families):
        words = [f"w{x}" for x in rng.integers(5000, size=length)]
        for _ in range(copies):
            copy = list(words)
            for at in rng.choice(length, int(rng.integers(0, 7)), replace=False):
                copy[at] = f"x{rng.integers(10000)}"
            out.append(" ".join(copy))
    return out


def kept(spark, rows):
    return sorted(r.doc_id for r in N.keep_one(spark.createDataFrame([(d, t, "en") for d, t in rows], DOCS)).collect())


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    rows = [(i * 7 % 1000, t) for i, t in enumerate([*texts(40, 4), None, "", " \n", "one", "One", "one two", "a b c d e", "a b c d e f"])]
    want = brute(rows)
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], DOCS)
    assert kept(spark, rows) == want and len(want) < len(rows) - 40
    df = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "")
    left = [(r.doc_id, grams(r.text)) for r in df.collect()]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, (_, a) in enumerate(left) for _, b in left[:i])


def test_large_families_in_tiles(spark, monkeypatch):
    rows = list(enumerate(texts(2, 90, seed=4)))
    want = brute(rows)
    assert kept(spark, rows) == want
    monkeypatch.setattr(N.candidates, "__defaults__", (16,))
    monkeypatch.setattr(N.near_copies, "__defaults__", ("doc_id", 16))
    for leaders in (16, 1, 0):
        monkeypatch.setattr(N, "LEADERS", leaders)
        assert kept(spark, rows) == want


def test_a_large_family_is_not_multiplied(spark):
    """20,000 texts of one family: the rows that meet are a small multiple of them."""
    rows = list(enumerate(texts(1, 200, length=300, seed=6)))
    docs = spark.createDataFrame(rows, "id long, text string").crossJoin(spark.range(100).withColumnRenamed("id", "k"))
    docs = docs.select((F.col("id") * 100 + F.col("k")).alias("id"), F.lit(0).cast("long").alias("component"), F.lit(20_000).cast("long").alias("m"), F.concat("text", F.lit(" z"), F.col("k")).alias("text"))
    seen = []
    met = N._met
    N._met = lambda r: (seen.append(r.count()), met(r))[1]
    try:
        links = N.settled(docs, N.GROUP_TILE)
        joined = N.components(links, "a", "b", few=N.FEW).groupBy("component").count().orderBy(F.desc("count")).first()
    finally:
        N._met = met
    assert joined["count"] > 15_000 and sum(seen) < 3 * 20_000 + 20_000


def test_odd_tables(spark):
    assert kept(spark, []) == []
    rows = [(None, "a b c d e f", "en"), (4, "A b c d e f", "en"), (4, "q r s t u v", "en")]
    assert sorted(r.text.lower() for r in N.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == ["a b c d e f", "q r s t u v"]


def test_columns_of_the_caller_stay(spark):
    rows = [(1, "a b c d e f", "r0"), (1, "A b c d e f", "r1"), (None, "other words that are not alike", "r2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    out = N.keep_one(df)
    assert out.columns == df.columns and len(got := [tuple(r) for r in out.collect()]) == 2 and set(got) <= set(rows)


def test_fingerprint_links_name_ids(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(7, " ".join(words)), (3, " ".join(words[:-1])), (9, "something else altogether, and no more than that"), (5, " ".join(words))]
    sigs = N.signed(spark.createDataFrame([(d, t, "en") for d, t in rows], DOCS), "doc_id").cache()
    got = {frozenset(r) for r in N.closest(sigs).collect()}
    assert got <= {frozenset((3, 5))} and (len({r.fp for r in sigs.collect()}) == 2 or got)
