import public_tokenizers
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, edits int"
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def count(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


def edited(text, position, delete, insert):
    position = min(max(position, 0), len(text))
    return text[:position] + insert + text[min(position + max(delete, 0), len(text)) :]


PIECES = st.sampled_from(["a", " b", "word", " ", "  ", "\n", "\n\n ", "'s", "'", "12", "é", "日本", "!", " ?!", "\t", "<|endoftext|>", "x" * 30, "　"])
TEXT = st.lists(PIECES, max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 120), st.integers(0, 40), TEXT | st.just("")), max_size=4), st.sampled_from([1, 2, 5, 64]))
def test_edits_against_whole_encoding(text, edits, leaf):
    C.LEAF, kept = leaf, C.LEAF
    try:
        tree = C.TokenTree(text, C.Counter(PATH, limit=7))
        assert tree.n_tokens == count(text)
        for e in edits:
            text = edited(text, *e)
            assert tree.edit(*e) == count(text)
            assert tree.text == text
    finally:
        C.LEAF = kept


def test_only_the_neighbourhood_is_encoded_again():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = C.TokenTree(text, C.Counter(PATH))
    tree.edit(len(text) // 2, 3, "changed here")
    assert tree.n_tokens == count(edited(text, len(text) // 2, 3, "changed here")) and tree.reencoded < 2000


def test_table(spark):
    rows = [(1, "Some text of a document."), (2, None), (3, ""), (4, "long " * 30_000), (None, "no id"), (1, "Some text of a document.")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    got = C.edited_counts(docs, C.revision(F.col("text"))).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: (str(r.doc_id), r.n_chars))
    for (i, t), r in zip(sorted(rows, key=lambda x: (str(x[0]), len(x[1] or ""))), got):
        t = t or ""
        new, n = t, len(t)
        for e in ((0, 0, "Revised. "), (n // 2 + 9, 5, " [edited]"), (n + 3, 10, "")):
            new = edited(new, *e)
        assert (r.doc_id, r.n_chars, r.n_tokens, r.n_edits, r.chars_after, r.tokens_after) == (i, n, count(t), 3, len(new), count(new))
    assert C.edited_counts(docs.limit(0), C.revision(F.col("text"))).collect() == []
    none = C.edited_counts(docs, F.lit(None)).collect()
    assert all(r.n_edits == 0 and r.tokens_after == r.n_tokens for r in none)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.lists(st.tuples(st.integers(-2, 120), st.integers(0, 40), TEXT | st.just("")), max_size=3), max_size=4), st.sampled_from([1, 2, 5]))
def test_kept_leaves_take_further_edits(text, revisions, leaf):
    C.LEAF, kept = leaf, C.LEAF
    try:
        counter = C.Counter(PATH, limit=7)
        tree = C.TokenTree(text, counter)
        for edits in revisions:
            chars, tokens = tree.leaves
            tree = C.TokenTree(tree.text, counter, chars, tokens)
            for e in edits:
                text = edited(text, *e)
                assert tree.edit(*e) == count(text) and tree.text == text
    finally:
        C.LEAF = kept


def test_large_insertions_split_leaves():
    tree = C.TokenTree("some words", C.Counter(PATH))
    tree.edit(4, 0, " more" * 10_000)
    before, text = tree.reencoded, tree.text
    tree.edit(25_000, 5, " less")
    assert tree.reencoded - before < 2000 and tree.n_tokens == count(edited(text, 25_000, 5, " less"))
    assert max(tree.leaves[1]) <= 4 * C.LEAF


def test_revisions_of_a_stored_table(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "and so on, " * 2000, "c", 1) for i in range(20)] + [(99, None, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    C.token_trees(docs).write.parquet(f"{tmp_path}/0")
    want = {i: t or "" for i, t, *_ in rows}
    for n, edit in enumerate([(100, 3, "new words"), (15_000, 0, " inserted"), (0, 4, "")]):
        trees = spark.read.parquet(f"{tmp_path}/{n}")
        edits = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(edit[0]).alias("position"), F.lit(edit[1]).alias("delete"), F.lit(edit[2]).alias("insert"))))
        C.revised(trees, edits).write.parquet(f"{tmp_path}/{n + 1}")
        want = {i: edited(t, *edit) if i % 2 == 0 else t for i, t in want.items()}
        for r in spark.read.parquet(f"{tmp_path}/{n + 1}").collect():
            assert (r.text, r.n_chars, r.n_tokens) == (want[r.doc_id], len(want[r.doc_id]), count(want[r.doc_id]))
            assert r.n_edits == (r.doc_id % 2 == 0) and r.chars_reencoded <= (r.n_chars // 10 if r.doc_id % 2 == 0 else 0)
