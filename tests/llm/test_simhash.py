import re

import numpy as np
import xxhash

from tessera.llm import simhash as S

DOCS = "doc_id long, text string, lang string, fp string, n int"


def brute_fp(text, k=4):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", " \t", "One", "a b c d", "a  b\nc d e A B c D e", "é ö ü ñ x y z", "w " * 9000, "a b c d e f"):
        assert S.fingerprint(t) == brute_fp(t)


def planted(rng, n, near):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [int(x) for x in base]
    for _ in range(near):
        x = out[int(rng.integers(len(out)))]
        for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(bit)
        out.append(x)
    return out


def test_forest_spans_the_links_of_buckets():
    rng = np.random.default_rng(3)
    fps = np.array(planted(rng, 40, 400), np.uint64)
    bucket = np.sort(rng.integers(0, 3, len(fps)))
    links = S.forest(fps, bucket)
    for b in range(3):
        at = np.flatnonzero(bucket == b)
        own = [int(x) for x in fps[at]]
        want = brute_components(own)
        first = {int(p): i for i, p in enumerate(at)}
        label = list(range(len(own)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        mine = [(first[i], first[j]) for i, j in links if i in first]
        assert all((own[i] ^ own[j]).bit_count() <= 4 for i, j in mine)
        assert len(mine) == len(own) - len(set(want))
        for i, j in mine:
            a, c = sorted((root(i), root(j)))
            label[c] = a
        assert [root(i) for i in range(len(own))] == want


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(5)
    fps = sorted(set(planted(rng, 300, 900)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for n, tile in ((len(fps), 8192), (1 << 20, 8192), (len(fps), 8)):
        pairs = S.links(df, n, tile=tile).collect()
        place = {x: i for i, x in enumerate(signed)}
        label = list(range(len(fps)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
            i, j = sorted((root(place[a]), root(place[b])))
            label[j] = i
        assert [root(i) for i in range(len(fps))] == want


def texts():
    rng = np.random.default_rng(9)
    out = []
    for i in range(30):
        words = [f"w{rng.integers(500)}" for _ in range(300)]
        for _ in range(int(rng.integers(1, 5))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = "changed"
            out.append(" ".join(copy))
    return [*out, None, "", " \n", "one", "One", "one two"]


def test_against_brute_force(spark):
    rows = [(i * 3 % 1000, t, "en", "clash", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [brute_fp(r[1]) for r in rows]
    label = brute_components(fps)
    least = {c: min(r[0] for r, x in zip(rows, label) if x == c) for c in label}
    assert got == {r[0]: (f, least[c]) for r, f, c in zip(rows, fps, label)}
    kept = S.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(empty).collect() == [] and S.keep_one(empty).collect() == []
    rows = [(None, "a b c d e", "x", "y", 1), (4, "a b c d e", "x", "y", 1), (4, "a b c d e", "x", "y", 1), (4, "q r s t u v", "x", "y", 1)]
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(4, 4), (4, 4), (4, 4), (None, 4)]
    assert sorted(r.text for r in S.keep_one(spark.createDataFrame(rows, DOCS)).collect()) == ["a b c d e", "q r s t u v"]


def test_a_skewed_bucket_is_split_by_further_blocks(spark):
    rng = np.random.default_rng(8)
    low = int(rng.integers(1 << 16))
    fps = {(int(x) & ~0xFFFF) | low for x in rng.integers(0, 1 << 63, 3000, dtype=np.uint64)}
    for x in list(fps)[:200]:
        fps.add(x ^ sum(1 << int(b) for b in rng.choice(np.arange(16, 63), int(rng.integers(1, 5)), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    rows = S.buckets(df, len(fps), tile=256)
    assert rows.count() < 12 * len(fps)  # tiles alone: some (3000 / 128) rows for each fingerprint of the bucket
    label, place = list(range(len(fps))), {x: i for i, x in enumerate(fps)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in S.links(df, len(fps), tile=256).collect():
        i, j = sorted((root(place[a]), root(place[b])))
        label[j] = i
    assert [root(i) for i in range(len(fps))] == brute_components(fps)


def test_columns_of_the_caller_stay(spark):
    rows = [(1, "a b c d e f", "r0"), (1, "a b c d e f", "r1"), (None, "other words than those before", "r2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    out = S.keep_one(df)
    assert out.columns == df.columns and len(got := [tuple(r) for r in out.collect()]) == 2 and set(got) <= set(rows)
