import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest

from tessera.llm import collocations as C

DOCS = "doc_id long, text string, lang string, source string, path string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, covered=100, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        rows = []
        for p, a in found.items():
            if any(100 * f >= covered * a for q, f in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, _, l, r = min((1000 * a * sizes[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, l, r, sizes[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(rows[:top])]
    return sorted(out)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", "clash", 3) for i, (la, t) in enumerate(rows)], DOCS)


def texts(seed, n=240):
    rng = random.Random(seed)
    words = ["The", "of", "é", "New", "york", "times", "\x00", "b\x01x", "b", "x-y", *(f"w{i}" for i in range(30))]
    some = lambda: rng.choices(words, weights=[9, 8, 5, 4, 4, 3, 2, 2, *[1] * 32])[0]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(40)):
            text += " ".join(some() for _ in range(rng.randrange(5))) + rng.choice([" ", "\t", ". ", "\n", "; ", " new York times ", " é of the of the "])
        out.append((rng.choice(["en", "en", "fr", None]), text))
    return [*out, *out[:20], ("en", None), (None, ""), ("und", "new york " * 300), ("en", " . ; \x0b")]


def test_against_brute_force(spark):
    rows = texts(1)
    got = sorted(tuple(r) for r in C.mined(docs_of(spark, rows), least=100, top=2000).collect())
    assert got == brute(rows) and len(got) > 30


@pytest.mark.parametrize("options", [{"longest": 2, "least": 3}, {"longest": 5, "least": 4, "covered": 60, "top": 25}, {"longest": 3, "least": 600, "top": 5}, {"longest": 4, "least": 1, "top": 300}])
def test_small_tries_many_ranges_and_a_full_sketch(spark, options):
    rows = texts(2)
    top = options.setdefault("top", 2000)
    got = sorted(tuple(r) for r in C.mined(docs_of(spark, rows).repartition(6), **options, sizes=C.Sizes(block=900, held=35, run=300, slots=64, parts=4, mass=400, ways=3)).collect())
    assert got == brute(rows, **options) and top


def test_no_table_no_phrase_and_no_delimiter(spark):
    assert C.mined(docs_of(spark, [("en", "a b")]).limit(0), least=1, top=3).collect() == []
    assert C.mined(docs_of(spark, [("en", "a b c"), ("en", None)]), least=2).collect() == []
    rows = [("en", "a b c " * 500)]
    assert sorted(tuple(r) for r in C.mined(docs_of(spark, rows), least=2, top=9, sizes=C.Sizes(block=50)).collect()) == brute(rows, least=2, top=9)


def test_products_beyond_64_bits(spark):
    wide = lambda x: F.lit(x).cast("decimal(18,0)")
    for a, n, l, r in [(10**12, 10**16, 10**12, 10**12), (123456789012, 9876543210987654, 123456789013, 223456789012), (7, 10**17, 11, 10**16)]:
        got = spark.range(1).select(C._quotient(wide(a), wide(n), wide(l), wide(r))).first()[0]
        assert got == 1000 * a * n // (l * r)


def test_tries_count_each_path():
    ids = np.array([1, 2, 1, 2, 3, 0, 1, 2, 3])
    go = (ids[:-1] > 0) & (ids[1:] > 0)
    paths, n = C.serialised([b"_", b"a", b"b", b"c"], C.trie(ids, go, 4))
    assert [(" ".join(C.words_of(p)), k) for p, k in zip(paths.to_pylist(), n.to_pylist())] == [("a b", 3), ("a b a", 1), ("a b a b", 1), ("a b c", 2), ("b a", 1), ("b a b", 1), ("b a b c", 1), ("b c", 2)]


def test_paths_in_order_and_in_ranges():
    words = [b"a", b"a\x00", b"a\x01", b"a\x00b", b"b", b"\x00", b"\x01\x01"]
    assert all(C.words_of(C.BETWEEN.join(map(C.escaped, p))) == [w.decode() for w in p] for p in [words, words[::-1]])
    paths = sorted(C.BETWEEN.join(map(C.escaped, p)) for p in [(x,) for x in words] + [(x, y) for x in words for y in words])
    ranges = C.Ranges([("en", C.escaped(b"a")), ("en", b"b"), ("en", b"b" + C.BETWEEN + b"b"), ("fr", b"a")])
    for lang in ("en", "fr", "xx"):
        pieces = list(ranges.pieces(lang, paths))
        assert [x for _, a, b in pieces for x in paths[a:b]] == paths
        assert all(ranges.of(lang, x) == r for r, a, b in pieces for x in paths[a:b])
    assert C.merged([[(b"a", 1), (b"c", 2)], [(b"a", 4)], [], [(b"b", 1), (b"c", 1)]]) == [(b"a", 5), (b"b", 1), (b"c", 3)]
