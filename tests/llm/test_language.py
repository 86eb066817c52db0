import numpy as np
import pytest

from tessera.llm import language as L

DOCS = "doc_id long, text string, lang string, score double, bucket int"
SOUNDS = {"aa": ["ba", "no", "ri", "tu"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["eau", "que", "oui", "les"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang], int(rng.integers(1, 4)))) for _ in range(words))


def rows(n=240, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, sentence(rng, lang := "aa bb cc".split()[i % 3], int(rng.integers(3, 80))), lang) for i in range(n)]


def docs(spark, data):
    return spark.createDataFrame([(i, t, lang, 0.5, 1) for i, t, lang in data], DOCS)


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(docs(spark, rows() + [(900, None, "aa"), (901, "text", None)]))


def test_learns_whole_texts(spark, model):
    langs, logs = model
    assert langs == ["aa", "bb", "cc"]
    counts = np.full(L.BUCKETS, L.SMOOTHING)
    for _, t, lang in rows():
        if lang == "aa":
            ids, n = L.trigrams(t)
            counts[ids] += n
    assert np.allclose(logs[0], np.log(counts / counts.sum()), atol=1e-5)


def test_held_out_accuracy(spark, model):
    held = rows(150, seed=2)
    got = {r.doc_id: r for r in L.identify(docs(spark, held), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.98
    assert np.mean([" " not in got[i].languages for i, _, _ in held]) > 0.9  # one language is chosen for texts in one


def test_mixtures(spark, model):
    rng = np.random.default_rng(3)
    mixed = [(i, sentence(rng, "aa", 140) + ". " + sentence(rng, "cc", 60), None) for i in range(20)]
    for r in L.identify(docs(spark, mixed), model).collect():
        assert r.lang_pred == "aa" and 0.5 < r.score < 0.9 and "cc:" in r.languages and "bb:" not in r.languages


def test_em_against_a_plain_loop(model):
    _, logs = model
    rng = np.random.default_rng(8)
    ids, n = L.trigrams(sentence(rng, "aa", 30) + " " + sentence(rng, "bb", 20))
    p = np.exp(logs[:, ids].astype(float))
    share = np.full(3, 1 / 3)
    for _ in range(L.ROUNDS):
        part = share[:, None] * p
        share = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
    best = max([-np.inf, *((n * logs[k, ids]).sum() for k in range(3))])
    order = np.argsort(-share)
    for k in (2, 3):
        s = share[order[:k]] / share[order[:k]].sum()
        for _ in range(L.REFIT):
            part = s[:, None] * p[order[:k]]
            s = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
        fit = (n * np.log((s[:, None] * p[order[:k]]).sum(axis=0))).sum() - 0.5 * np.log(n.sum()) * (k - 1)
        if fit <= best:
            break
        best, chosen = fit, dict(zip(order[:k].tolist(), s.tolist()))
    got = L.mixtures([(ids, n)], logs)[0]
    assert {i: pytest.approx(x, abs=1e-4) for i, x in chosen.items()} == {i: x for i, x in enumerate(got) if x}


def test_odd_texts(spark, model):
    data = [(1, None, None), (2, "", None), (3, "12 .!", None), (4, "b", None), (None, "riri nono", None), (1, "ungein " * 60_000, "x")]
    got = L.identify(docs(spark, data), model).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3].lang_pred != "und" and got[4].lang_pred == "aa" and got[5].lang_pred == "bb"
    assert L.identify(docs(spark, []), model).collect() == []
    nothing = L.learn(docs(spark, []))
    assert [r.lang_pred for r in L.identify(docs(spark, [(1, "text", None)]), nothing).collect()] == ["und"]
    long = "schver " * 50_000
    a, n = L.trigrams(long)
    assert n.sum() == 6 * 50_000


def test_small_matrices_give_the_same(model):
    langs, logs = model
    bags = [L.trigrams(t) for t in ("some words of one kind", "andere Wörter einer Art", "a", "more words " * 50, "noch mehr Wörter")]
    whole = L.mixtures(bags, logs)
    for cells in (1, 40, 200):
        assert np.allclose(L.mixtures(bags, logs, cells), whole)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGS", 2)
    with pytest.raises(ValueError):
        L.learn(spark.createDataFrame([("text", x) for x in "abc"], "text string, lang string"))
