"""Token counts that follow edits: a segment tree over the pre-tokens of each document, kept as a table.

Leaves hold runs of pre-tokens with their characters and token counts; inner nodes hold sums. ``token_trees`` tokenises
each document once and gives a table of texts and leaves. ``revised`` takes that table and edits, re-encodes only what the
edits touch, and gives the table anew, so that a chain of revisions never tokenises a document again. An edit finds its
leaf by descending over character sums, re-encodes from a boundary that the edit can't move to the first old leaf boundary
behind it at which the pre-tokens fall in step again, and updates the sums above the leaves that changed; a leaf that grows
beyond two leaves' pre-tokens is split.

Defined results: null text counts as empty, with 0 tokens. Positions are code points; edits outside of the text are
clipped to it; edits of null do nothing. Strings of special tokens count as ordinary text. Rows are counted one by one,
repeated rows too; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, text_pass, worker_cache, written
from .tokens import byte_level, load, pre_tokens

#: Pre-tokens of a leaf.
LEAF = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Token counts of pre-tokens; two generations of ``limit`` pre-tokens are remembered."""

    def __init__(self, path: str, limit: int = 300_000):
        self.model, self.limit = load(path).model, limit
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        young, out = self.young, []
        for t in tokens:
            n = young.get(t)
            if n is None:
                n = self.old.get(t)
                if n is None:
                    n = len(self.model.tokenize(byte_level(t)))
                if len(young) >= self.limit:
                    self.old, self.young = young, {}
                    young = self.young
                if len(t) <= 64:
                    young[t] = n
            out.append(n)
        return out


class TokenTree:
    """A document as leaves of pre-tokens under a binary tree of character and token sums."""

    def __init__(self, text: str, counter: Counter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None):
        """Of a text alone, which is tokenised, or with the characters and tokens of its leaves as kept before."""
        self.counter, self.reencoded = counter, 0
        if chars is None:
            found = pre_tokens().findall(text)
            self._build(*self._leaves(found))
        else:
            ends = np.cumsum(chars).tolist()
            self._build([text[a:b] for a, b in zip([0, *ends], ends)], list(tokens))

    def _leaves(self, found: list[str]) -> tuple[list[str], list[int]]:
        """Texts and token counts of the leaves of these pre-tokens; one empty leaf of none."""
        starts = list(range(0, len(found), LEAF)) or [0]
        tokens = np.add.reduceat(np.array(self.counter.counts(found), np.int64), starts).tolist() if found else [0]
        return ["".join(found[a : a + LEAF]) for a in starts], tokens

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.texts = texts or [""]
        self.size = 1 << max(0, len(self.texts) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.texts)] = [len(t) for t in self.texts]
        self.tokens[self.size : self.size + len(tokens)] = tokens
        for tree in (self.chars, self.tokens):
            at = self.size
            while at > 1:  # a level from the one below
                tree[at // 2 : at] = tree[at : 2 * at : 2] + tree[at + 1 : 2 * at : 2]
                at //= 2

    @property
    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the leaves that aren't empty."""
        chars, tokens = (t[self.size : self.size + len(self.texts)] for t in (self.chars, self.tokens))
        return chars[chars > 0], tokens[chars > 0]

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf with this character, and where the leaf begins."""
        at, begin = 1, 0
        while at < self.size:
            at *= 2
            if position - begin >= self.chars[at]:
                begin += int(self.chars[at])
                at += 1
        return at - self.size, begin

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        at = leaf + self.size
        more = (len(text) - int(self.chars[at]), tokens - int(self.tokens[at]))
        self.texts[leaf] = text
        while at:
            self.chars[at] += more[0]
            self.tokens[at] += more[1]
            at //= 2

    def edit(self, position: int, delete: int, insert: str) -> int:
        """Replaces ``delete`` characters at ``position``; returns the tokens of the text as it is then."""
        total = int(self.chars[1])
        position = min(max(position, 0), total)
        end = min(position + max(delete, 0), total)
        if end == position and not insert:
            return self.n_tokens
        first, begin = self.leaf_at(max(position - 1, 0))
        # a boundary inside white space moves with what follows: begin where a word stands before the edit
        while first and not (self.texts[first][: position - begin].strip() if position > begin else ""):
            first -= 1
            begin -= len(self.texts[first])
        last, at = self.leaf_at(min(end, total - 1)) if total else (0, 0)
        head = "".join(self.texts[first : last + 1])
        new = head[: position - begin] + insert + head[end - begin :]
        pattern = pre_tokens()
        while True:  # behind the edit, pre-tokens must end where an old leaf ends, seen with a word beyond it
            ahead, look = last + 1, ""
            while ahead < len(self.texts) and not look.strip():
                look += self.texts[ahead]
                ahead += 1
            found, n = [], 0
            for m in pattern.finditer(new + look):
                if m.end() > len(new):
                    break
                found.append(m.group())
                n = m.end()
            if n == len(new) and (look.strip() or ahead >= len(self.texts)):
                break
            last += 1
            new += self.texts[last]
        self.reencoded += len(new)
        texts, counts = self._leaves(found) if len(found) > 2 * LEAF else ([new], [sum(self.counter.counts(found))])
        if len(texts) > last + 1 - first:  # more leaves than there were: the tree over the leaves is laid out anew
            kept = self.tokens[self.size : self.size + len(self.texts)].tolist()
            self._build(self.texts[:first] + texts + self.texts[last + 1 :], kept[:first] + counts + kept[last + 1 :])
        else:
            for leaf in range(first, last + 1):
                n = leaf - first
                self._put(leaf, *((texts[n], counts[n]) if n < len(texts) else ("", 0)))
        return self.n_tokens


TREES = "doc_id long, text string, n_chars long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"
TREE = [("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32()))]
ARROW = pa.schema(TREE)
REVISED = pa.schema([*TREE, ("n_edits", pa.int32()), ("chars_reencoded", pa.int64()), ("chars_before", pa.int64()), ("tokens_before", pa.int64())])


def _row(doc: int | None, tree: TokenTree) -> tuple:
    chars, tokens = tree.leaves
    return doc, tree.text, int(tree.chars[1]), tree.n_tokens, chars.astype(np.int32), tokens.astype(np.int32)


def _batches(schema: pa.Schema, b: pa.RecordBatch, row_of) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(b), 256):
        rows = [row_of(*x) for x in zip(*b.slice(at, 256).columns)]
        yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows)))))


def token_trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, n_chars, n_tokens, and characters and tokens of the tree's leaves."""
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {path}", lambda: Counter(path))
        for b in it:
            yield from _batches(ARROW, b, lambda doc, text: _row(doc.as_py(), TokenTree(text.as_py() or "", counter)))

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, TREES, keeps_cache=True)


def revised(trees: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """The trees of the edited texts; and n_edits, chars_reencoded, chars_before, tokens_before.

    trees: a table of token_trees() or revised(). edits: array of (position long, delete long, insert string), applied in
    order, each to the text as it then is. A document without edits is not tokenised at all.
    """
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {path}", lambda: Counter(path))

        def row_of(doc, text, chars, tokens, changes) -> tuple:
            tree = TokenTree(text.as_py() or "", counter, chars.values.to_numpy(), tokens.values.to_numpy())
            before, n = (int(tree.chars[1]), tree.n_tokens), 0
            for c in changes.as_py() or ():
                if c is not None and c["position"] is not None:
                    tree.edit(c["position"], c["delete"] or 0, c["insert"] or "")
                    n += 1
            return (*_row(doc.as_py(), tree), n, tree.reencoded, *before)

        for b in it:
            yield from _batches(REVISED, b, row_of)

    kind = "array<struct<position:long,delete:long,insert:string>>"
    columns = [F.col("doc_id"), F.col("text"), F.col("leaf_chars"), F.col("leaf_tokens"), edits.cast(kind).alias("edits")]
    return text_pass(trees, columns, run, f"{TREES}, n_edits int, chars_reencoded long, chars_before long, tokens_before long", keeps_cache=True)


def edited_counts(docs: DataFrame, edits: Column, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, n_tokens, n_edits, chars_after, tokens_after, chars_reencoded.

    The trees are a written table; the edits (an expression of the text) work on that table alone.
    """
    trees = written(token_trees(docs, vocabulary), "token-trees")
    out = revised(trees, edits, vocabulary)
    return out.select("doc_id", F.col("chars_before").alias("n_chars"), F.col("tokens_before").alias("n_tokens"), "n_edits", F.col("n_chars").alias("chars_after"), F.col("n_tokens").alias("tokens_after"), "chars_reencoded")


def revision(text: Column) -> Column:
    """The edits of a routine revision: a heading in front, five characters in the middle replaced, ten at the end cut."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    edit = lambda position, delete, insert: F.struct(position.cast("long").alias("position"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    return F.array(edit(F.lit(0), 0, "Revised. "), edit(F.floor(n / 2) + 9, 5, " [edited]"), edit(n + 3, 10, ""))
