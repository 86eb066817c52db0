import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_words string, _w int, distance double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "clash", 1, 0.0) for i, t, la, s in rows], DOCS)


def counts(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def distances(rows):
    """Plain concentration steps on each group, with matrix inverses."""
    base = [counts(r[1]) for r in rows]
    x = {}
    for k, (n, chars, symbols, lines, again) in enumerate(base):
        if n >= Q.WORDS and 100 * again <= Q.REPEATED * n:
            x[k] = [math.floor(Q.UNIT * v) for v in (math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(again / n), math.sqrt(lines / n))]
    sizes = Counter(rows[k][2:] for k in x)
    groups = {}
    for k in x:
        key = rows[k][2:]
        groups.setdefault(key if sizes[key] >= Q.LEAST else ("rest", key[0]), []).append(k)
    out = {}
    for members in groups.values():
        if len(members) < Q.LEAST:
            continue
        v = np.array([x[k] for k in members], float)
        floor = np.eye(4) * Q.FLOOR**2
        ranks = np.sort(v, axis=0)
        quarter = [ranks[-(-q * len(v) // 4) - 1] for q in (1, 2, 3)]
        starts = [(v.mean(axis=0), np.cov(v.T, bias=True) + floor), (quarter[1], np.diag(np.maximum((quarter[2] - quarter[0]) / 1.349, Q.FLOOR) ** 2))]
        best = None
        for mean, cov in starts:
            for _ in range(Q.STEPS):
                d = np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)
                bins = np.minimum(np.floor(d * Q.FINE), Q.BINS)
                near = v[bins <= np.sort(bins)[len(v) * Q.QUARTERS // 4]]
                mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
            if best is None or np.linalg.det(cov) < best[0] * (1 - 1e-9):
                best = np.linalg.det(cov), mean, cov
        d = np.einsum("ij,jk,ik->i", v - best[1], np.linalg.inv(best[2]), v - best[1]) / Q.consistency(Q.QUARTERS / 4)
        out |= dict(zip(members, d))
    return out


def corpus(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("fr", "a"), ("fr", None), (None, "a"), ("de", f"s{i % 9}"), ("xx", "one")])
        long = rng.randrange(2, 7)
        words = [rng.choice("abcdefgh") * rng.randrange(1, long + 2) + str(rng.randrange(300)) for _ in range(rng.randrange(30, 160))]
        if rng.random() < 0.3:
            words += words[:5] + ["\n"] + ["x y z", "\n"] * rng.randrange(3)
        if i % 17 == 0:
            words = [w + "###$$" for w in words]
        rows.append((i, " ".join(words), lang, source))
    return [*rows, (1, None, "en", "a"), (None, "", None, None), (2, "a b a b a b " * 30, "en", "a"), (2, "a b a b a b " * 30, "en", "a"), (3, "é |\n\n é |\n é |\n  x y", "en", "b"), (4, "w" * 100_000, "en", "b")]


def test_counts_with_hashes_of_any_width(spark):
    rows = corpus(1, 120)
    for bits in (0, 2, 40):
        got = Q.counted(docs_of(spark, rows), "doc_id", bits=bits).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], *counts(r[1])) for r in rows), key=str)


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_outliers_against_plain_steps(spark, monkeypatch, bound):
    monkeypatch.setattr(Q, "BROADCAST_BYTES", bound)
    rows = [(k, *r[1:]) for k, r in enumerate(corpus(2))]
    far = distances(rows)
    got = {r.doc_id: r for r in Q.judged(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows) and set(far) == {k for k, r in got.items() if r.distance is not None}
    assert all(abs(got[k].distance - d) < 1e-6 * (1 + d) for k, d in far.items())
    for k, r in got.items():
        n, _, _, _, again = counts(rows[k][1])
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert r.kept == (not r.base_failed and far.get(k, 0) < Q.CUTOFF)
    assert {k for k, r in got.items() if not r.base_failed and not r.kept} >= {k for k in far if k % 17 == 0 and rows[k][2:] in (("en", "a"), ("en", "b"))}


def test_empty_table_and_few_rows(spark):
    assert Q.judged(docs_of(spark, corpus(3, 5)).limit(0)).collect() == []
    few = Q.judged(docs_of(spark, corpus(3, 8))).collect()
    assert all(r.kept != r.base_failed for r in few)
