import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import runs as R

DOCS = "doc_id long, text string, lang string, runs int, collapsed string"


def brute(words, length=24, periods=3):
    """All runs, by the definition: every period at every place."""
    n, spans = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, periods * q):
                spans.setdefault((i, j - i + q), q)  # the least period comes first
            i = max(j, i + 1)
    smallest = {}
    for (s, m), q in spans.items():
        if not any(o < q and a <= s and a + b >= s + m for (a, b), o in spans.items()):
            smallest[s, m] = q
    return sorted(((s, m, q) for (s, m), q in smallest.items()), key=lambda x: (x[0], x[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(b" ".join(kept)))


def noisy(rng, letters):
    out = []
    while len(out) < 150:
        out += [rng.choice(letters) for _ in range(rng.randrange(6))]
        out += [rng.choice(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from(["ab", "abc", "abcdefgh"]), st.sampled_from([(24, 3), (9, 3), (2, 3), (30, 4)]))
def test_all_runs(seed, letters, least):
    words = [w.encode() for w in noisy(random.Random(seed), letters)]
    assert R.runs_of([words, [], words[:40]], *least) == [brute(words, *least), [], brute(words[:40], *least)]


def test_words_decide_where_hashes_collide():
    for seed in range(60):
        ids = np.array([ord(w) for w in noisy(random.Random(seed), "ab")])
        assert sorted(R.Section(ids, prime=7).runs()) == sorted(R.Section(ids).runs())


def test_one_word_many_times():
    assert R.runs_of([[b"a"] * 200_000, [b"x", *[b"a", b"b"] * 50_000, b"c"]]) == [[(0, 200_000, 1)], [(1, 100_000, 2)]]


def test_digests_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(noisy(rng, "abcdef")[: rng.randrange(150)])) for i in range(200)]
    rows += [(1000 + i, "\t".join(f"w{rng.randrange(1 << 20)}" for _ in range(rng.randrange(300)))) for i in range(200)]
    rows += [(7, None), (7, ""), (8, " \n\t "), (9, "é " * 40), (10, "b" * 5000), (11, ("x y\x0b" * 400) + "z"), (11, ("x y\x0b" * 400) + "z")]
    docs = spark.createDataFrame([(i, t, None, 1, "clash") for i, t in rows], DOCS).withColumn("text", R.with_period("doc_id", "text"))
    got = sorted((tuple(r) for r in R.digests(R.periodic_runs(docs)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 30, None, 1, "")], DOCS)
    (row,) = R.periodic_runs(docs).collect()
    assert row.doc_id is None and [tuple(r) for r in row.runs] == [(0, 30, 1)] and row.collapsed == "a" and row.n_words == 30
    assert R.digests(R.periodic_runs(docs.limit(0))).collect() == []
