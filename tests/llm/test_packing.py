import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P
from tessera.llm.tokens import WordEnds, load

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, piece string, shard int, length string"
ODD = ["", None, "Hello, World.", "a\tb c\x1cd", "It's  we'll 'tis. don't,,..", "ÉCOLE Straße ΣΑΣ İstanbul.", "é x", "12.5 ab1 1ab", "<|endoftext|> x<|endoftext|>y", "日本語 \U0001f600!", ".", ",.", "x" * 5000, "a\r\nb"]


def whole(text):
    return load(PATH).encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_encode_as_whole_texts():
    cache = WordEnds(load(PATH), limit=3)
    for t in ODD * 2:
        assert ids_of(cache.text(t)) == whole(t), t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzABZ ',.\n\t'sßéΣİıǅ1²९!? ́  \x1c日<|>")), max_size=40))
def test_any_text_encodes_as_a_whole(t):
    assert ids_of(WordEnds(load(PATH)).text(t)) == whole(t)


def brute_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            b = min(fit)
            bins.remove(b)
            bins.append(b - n)
        else:
            bins.append(size - n)
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(64, 100))
def test_best_fit_against_brute_force(lengths, size):
    place, offset, left = P.best_fit(np.array(lengths, np.int64), size)
    assert sorted(left.tolist()) == brute_best_fit(lengths, size)
    used = defaultdict(list)
    for s, o, n in zip(place, offset, lengths):
        used[s].append((o, n))
    for s, parts in used.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == size - left[s]


def check(rows, got, size=2048):
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t in rows:
        ids = [*whole(t), 0]
        for k, a in enumerate(range(0, len(ids), size)):
            own = ids[a : a + size]
            want[i].append((k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert {i: sorted(x) for i, x in want.items()} == {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for i, x in parts.items()}
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= size
    return len(held)


def test_pack(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(["word"] * int(rng.integers(1, 3000)))) for i in range(120)] + [(7, "again"), (None, "no name")]
    docs = spark.createDataFrame([(i, t, "en", "clash", 1, "x") for i, t in rows], DOCS)
    n = check(rows, P.pack(docs).collect())
    total = sum(len(whole(t)) + 1 for _, t in rows)
    assert n <= total / 2048 * 1.1 + 1
    shards = check(rows, P.pack(docs, shard=10, fan_in=3, back=4).collect())
    assert shards <= n + 3
    assert P.pack(docs.limit(0)).collect() == []


def test_sequences_hold_the_documents(spark):
    rows = [(i, f"text number {i} " * (i * 40)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "c", 1, "x") for i, t in rows], DOCS)
    layout = P.pack(docs).cache()
    full = {r.sequence_id: ids_of(r.ids) for r in P.sequences(docs, layout).collect()}
    back = defaultdict(list)
    for r in sorted(layout.collect(), key=lambda r: r.start):
        back[r.doc_id] += full[r.sequence_id][r.offset : r.offset + r.length]
    assert dict(back) == {i: [*whole(t), 0] for i, t in rows}
