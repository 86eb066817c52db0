import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

DOCS = "doc_id long, text string, _text string, score double, lang string"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["scoundrel", "blockhead", "nitwit", "rascal"]


def corpus(n, seed=4):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioutrnsl"), int(rng.integers(2, 8)))) for _ in range(400)]
    out = []
    for i in range(n):
        text = [words[int(k)] for k in rng.integers(400, size=int(rng.integers(5, 120)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for k in range(0, len(text), 12):
                text[k] = BAD[int(rng.integers(4))]
        out.append((i, " ".join(text), toxic))
    return out


def test_grams_are_those_of_words():
    x = T.codes("Ab, ábc")
    got = {"".join(map(chr, x[s : s + n])) for n, (at, _) in zip(T.GRAMS, T.grams(x)) for s in at.tolist()}
    assert got == {" ab", "ab ", " áb", "ábc", "bc ", " ab ", " ábc", "ábc ", " ábc "}


def test_odds_of_long_texts_do_not_depend_on_spans(monkeypatch):
    numbers = np.random.default_rng(1).normal(size=T.BUCKETS).astype(np.float32)
    text = "some words and idle talk " * 90
    whole, n = T.odds(text, numbers), len(text) + 2
    for span in (1, 7, 64, n - 4, n):
        monkeypatch.setattr(T, "SPAN", span)
        assert T.odds(text, numbers) == pytest.approx(whole, rel=1e-4)


def test_calibration_is_tame():
    z = np.array([5.0, 6.0, -5.0, -6.0])
    slope, shift = T.calibrated(z, np.array([1, 1, 0, 0]))
    assert 0.5 < slope < 3 and abs(shift) < 2
    slope, shift = T.calibrated(np.linspace(-3, 1, 400), (np.linspace(-3, 1, 400) > -1).astype(int))
    assert abs(1 / (1 + np.exp(-(slope * -1 + shift))) - 0.5) < 0.1
    assert T.calibrated(np.empty(0), np.empty(0, int)) == (1.0, 0.0)


def test_held_out_accuracy_and_unseen_spellings(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "clash", 1.0, "en") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 3], LABELS)
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.scores(docs, model, ["doc_id"]).collect()}
    held = [(got[i] >= T.THRESHOLD) == (y == 1) for i, _, y in rows if i % 3 == 0]
    assert sum(held) / len(held) > 0.95
    clean, spelled = next(t for _, t, y in rows if not y and len(t) > 200), "skoundrell blokhead nitwitt rascall"
    two = spark.createDataFrame([(1, clean, None, None, None), (2, clean + " " + spelled * 3, None, None, None), (3, None, None, None, None), (4, "", None, None, None), (5, "1 . !", None, None, None)], DOCS)
    by = {r.doc_id: r.score for r in T.scores(two, model, ["doc_id"]).collect()}
    assert by[2] > by[1] and by[3] == by[4] and 0 <= by[5] <= 1
    kept = T.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([i in ids for i, _, y in rows if not y]) > 0.95 and np.mean([i in ids for i, _, y in rows if y]) < 0.1


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a text", "c", 1.0, "en"), (None, None, "c", 1.0, "en"), (1, "a text", "c", 1.0, "en")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert T.fit(docs, none) is None
    assert T.fit(docs, spark.createDataFrame([(1, 1, 1), (None, 1, 0), (1, 0, 0)], LABELS)) is None
    assert [r.score for r in T.scores(docs, None, ["doc_id"]).collect()] == [0.0] * 3
    assert T.scores(docs.limit(0), None, ["doc_id"]).collect() == []
    assert T.keep_clean(docs, none).count() == 3


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    embed, soft, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    bags = [([0, 2, 5], [0.2, 0.5, 0.3]), ([2], [1.0]), ([1, 2, 3, 4], [0.1, 0.2, 0.3, 0.4])]
    ids, weights = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    first, onehot = np.array([0, 3, 4]), np.eye(2)[[1, 0, 1]]

    def loss(e, s, b):
        total = 0.0
        for (at, w), y in zip(bags, (1, 0, 1)):
            z = sum(e[i] * x for i, x in zip(at, w)) @ s + b
            total -= z[y] - np.log(np.exp(z).sum())
        return total / 3

    value, *grads = T.gradients(embed, soft, bias, ids, weights, first, onehot)
    assert value == pytest.approx(loss(embed, soft, bias))
    for k, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            up, down = [x.copy() for x in (embed, soft, bias)], [x.copy() for x in (embed, soft, bias)]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(*up) - loss(*down)) / 2e-6, abs=1e-6)


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    numbers = rng.normal(size=T.BUCKETS).astype(np.float32)

    def bucket(gram):
        h = ord(gram[0]) * 2654435761 % 2**32
        for c in gram[1:]:
            h = (h ^ ord(c)) * 16777619 % 2**32
            h ^= h >> 15
        return h % T.BUCKETS

    def plain(text):
        n = {}
        for word in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
            fenced = f" {word} "
            for size in T.GRAMS:
                for i in range(len(fenced) - size + 1):
                    b = bucket(fenced[i : i + size])
                    n[b] = n.get(b, 0) + 1
        whole = sum(x**0.5 for x in n.values())
        return sum(numbers[b] * x**0.5 for b, x in n.items()) / whole if n else 0.0

    texts = ["Some words, some other words", "élan vital 12", "", None, "a b", "one " * 50]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.score for r in T.scores(docs, (numbers, -0.5), ["doc_id"]).collect()}
    assert got == {i: pytest.approx(1 / (1 + np.exp(0.5 - plain(t))), rel=1e-4) for i, t in enumerate(texts)}


def test_chosen_grams():
    toxic, clean = np.array([0, 40, 30, 2, 5]), np.array([0, 1, 60, 0, 10])
    z = lambda a, b: abs(a / 50 - b / 100) / np.sqrt((a + b) / 150 * (1 - (a + b) / 150) * (1 / 50 + 1 / 100))
    assert z(40, 1) > T.LEAST_Z > max(z(30, 60), z(5, 10))
    T.LEAST_GRAMS, kept = 0, T.LEAST_GRAMS
    try:
        assert T.chosen(toxic, clean, 50, 100).tolist() == [1]
    finally:
        T.LEAST_GRAMS = kept


def test_rows_of_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}", "c", 1.0, "en") for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3)], LABELS)
    rows = T.sampled(docs, labels, 50)
    assert rows.count() == 50 and T.sampled(docs.limit(0), labels, 50).count() == 0
    assert T.fit(docs, labels, 50) is not None


def test_equal_rows_count_once(spark):
    docs = spark.range(100_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("text of "), F.col("id") % 20).alias("text"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], LABELS)
    assert T.sampled(docs, labels, 100).count() == 20 and T.sampled(docs, labels, 7).count() == 7
