"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits, grouped by components.

Candidates come from the pigeonhole principle, which loses no link: if 64 bits are cut into b blocks, fingerprints that
differ in at most r bits agree in at least b - r whole blocks, so that each pair meets in some table keyed by b - r of
them; b grows with the number of fingerprints. Within a bucket, fingerprints are compared bit-sliced: bit planes stand
vertically in 64-lane words, one pass compares each fingerprint with the one d places on for 64 lanes a word, distances
are counted by carry-save adders, and words all of whose lanes exceed the radius are abandoned early. A bucket yields
a spanning forest of its links, not all pairs; buckets above a limit are compared tile by tile in many tasks.

Defined results: A-Z only are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D; null or wordless texts
have fingerprint 0, which links like any other; fewer words than a shingle's are one shingle. Null doc_ids get a result
of their own rows' component (the least doc_id that is not null; null if there is none). Rows are never merged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import FEW, components
from .common import batch, folded, maybe_broadcast, numbered, skew_join, text_pass, written

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket that one task compares; larger buckets are cut into tiles of pairs of parts.
TILE = 8192
#: Fingerprints a pass loads at a time.
LANES = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is 1 if it is 1 in the hashes of over half of the shingles."""
    parts = folded(text).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is 1 in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), in one pass without a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield batch(ARROW, doc_id=b.column(0), fp=fps)

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all fingerprints, 64 lanes a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def _packed(lanes: np.ndarray, words: int) -> np.ndarray:
    p = np.packbits(lanes, bitorder="little")
    return np.pad(p, (0, words * 8 - len(p))).view(np.uint64)


def _later(planes: np.ndarray, d: int, at: np.ndarray) -> np.ndarray:
    """The words ``at`` of the planes moved d lanes down; planes are padded behind."""
    w, r = divmod(d, 64)
    low = planes[:, at + w]
    return low if r == 0 else (low >> np.uint64(r)) | (planes[:, at + w + 1] << np.uint64(64 - r))


def close_at(planes: np.ndarray, d: int, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and masks of their lanes, that are valid and within radius (under 8) of the lane d places on."""
    at = np.flatnonzero(valid)
    mask = valid[at]
    one, two, four, over = (np.zeros(len(at), np.uint64) for _ in range(4))
    for p in range(0, 64, 8):
        near = planes[p : p + 8]
        diff = near[:, at] ^ _later(near, d, at)
        for i in range(0, 8, 2):  # a carry-save adder takes two planes; its carry goes up
            x, y = diff[i], diff[i + 1]
            half = x ^ y
            carry = (x & y) | (half & one)
            one = one ^ half
            up = two & carry
            two = two ^ carry
            over |= four & up
            four = four ^ up
        far = over.copy()  # lanes whose count is above the radius
        for count in range(radius + 1, 8):
            bits = [c if count >> k & 1 else ~c for k, c in enumerate((one, two, four))]
            far |= bits[0] & bits[1] & bits[2]
        mask &= ~far
        live = mask != 0
        if not live.all():  # abandon words in which all lanes are too far
            at, mask = at[live], mask[live]
            one, two, four, over = one[live], two[live], four[live], over[live]
            if not len(at):
                break
    return at, mask


class Forest:
    """Union-find over places, with flat labels for comparing many at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Links those of the pairs (a, b) that are apart; returns the links used."""
        apart = self.label[a] != self.label[b]
        used = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        for i, j, la, lb in zip(*(x[apart].tolist() for x in (a, b, self.label[a], self.label[b]))):
            ra, rb = root(la), root(lb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                used.append((i, j))
        if parent:
            moved = np.array([(x, root(x)) for x in parent])
            new = np.arange(len(self.label))
            new[moved[:, 0]] = moved[:, 1]
            self.label = new[self.label]
        return used


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places of links that span the components of each bucket; equal buckets stand together."""
    n = len(fps)
    if n < 2:
        return []
    last = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True))
    room = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n)  # places after this one in its bucket
    planes = planes_of(fps)
    words = planes.shape[1]
    planes = np.pad(planes, ((0, 0), (0, int(room.max()) // 64 + 2)))
    found, links = Forest(n), []
    for d in range(1, int(room.max()) + 1):
        at, mask = close_at(planes, d, _packed(room >= d, words), radius)
        if len(at):
            lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(lanes)
            a = at[w] * 64 + lane
            links += found.join(a, a + d)
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _blocks(n: int, radius: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """Tables (the blocks each is keyed by) and blocks (first bit, bits) for n fingerprints: some 64 to a bucket at most."""
    b = radius + 1
    while b < radius + 5 and n > 64 << (64 // b * (b - radius)):
        b += 1
    cuts = [round(64 * i / b) for i in range(b + 1)]
    return list(itertools.combinations(range(b), b - radius)), [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def buckets(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, t, k, i, j: the buckets (t, k, i, j) in which each pair within radius of n distinct fingerprints meets.

    A bucket of more than ``tile`` fingerprints is split once more by the pigeonhole: of the bits that its key leaves free,
    cut into radius + 1 blocks, a pair agrees in one whole block. What is still above the limit is cut into parts, and each
    pair of parts is a bucket.
    """
    tables, blocks = _blocks(n, radius)
    bits_of = [list(range(first, first + size)) for first, size in blocks]
    fixed = [[x for i in t for x in bits_of[i]] for t in tables]
    free = [[x for i in range(len(blocks)) if i not in t for x in bits_of[i]] for t in tables]
    cuts = [[f[round(len(f) * s / (radius + 1)) : round(len(f) * (s + 1) / (radius + 1))] for s in range(radius + 1)] for f in free]
    at = lambda masks: F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    sizes = lambda rows, keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > tile)

    rows = distinct.select("fp", F.posexplode(at([_mask(b) for b in fixed])).alias("t", "k"))
    large = written(sizes(rows, ["t", "k"]), "simhash-large")
    plain = ["fp", F.col("t").cast("long").alias("t"), "k", F.lit(0).alias("i"), F.lit(0).alias("j")]
    if large.isEmpty():
        return rows.select(*plain)
    mark = maybe_broadcast(large, large.count(), 32)
    small = rows.join(mark, ["t", "k"], "left_anti").select(*plain)
    again = F.array(*[at([_mask(fixed[t] + c) for c in cuts[t]]) for t in range(len(tables))])
    inner = rows.join(mark, ["t", "k"], "left_semi").select("fp", "t", F.posexplode(F.element_at(again, F.col("t") + 1)).alias("s", "k"))
    inner = inner.select("fp", ((F.col("t") + 1) * 16 + F.col("s") + len(tables)).cast("long").alias("t"), "k")
    still = written(sizes(inner, ["t", "k"]), "simhash-large")
    inner = inner.join(maybe_broadcast(still, still.count(), 32), ["t", "k"], "left")
    parts = F.coalesce(F.ceil(F.col("m") / (tile // 2)), F.lit(1)).cast("int")
    inner = inner.withColumns({"_part": F.pmod(F.xxhash64("fp"), parts).cast("int"), "_other": F.explode(F.sequence(F.lit(0), parts - 1))})
    return small.unionByName(inner.select("fp", "t", "k", F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j")))


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links that span the components of n distinct fingerprints (column fp). Exact: no pair within radius is lost."""
    rows = buckets(distinct, n, radius, tile)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray) -> pa.RecordBatch:
            change = np.append(True, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))
            fps = np.ascontiguousarray(rows[:, 0])
            pairs = np.array(forest(fps.view(np.uint64), np.cumsum(change), radius), np.int64).reshape(-1, 2)
            return batch(LINKS, a=fps[pairs[:, 0]], b=fps[pairs[:, 1]])

        held: list[np.ndarray] = []
        for b in it:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.int64))
            if sum(map(len, held)) >= LANES:
                rows = np.concatenate(held)
                same = (rows[:, 1:] == rows[-1, 1:]).all(axis=1)  # the last bucket may go on
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                held = [rows[cut:]]
                if cut:
                    yield linked(rows[:cut])
        if held:
            yield linked(np.concatenate(held))

    return rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    rows = written(fingerprints(docs, words), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    joined = components(links(distinct, n or 0, radius), "a", "b", few=FEW)
    # components are named by a fingerprint; documents by the least doc_id of the component
    member = written(distinct.join(joined.withColumnRenamed("node", "fp"), "fp"), "simhash-members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = skew_join(member.select("fp", "component", "least"), least, ["component"], "m", member.count(), F.col("fp")).select("fp", "component_id")
    group = distinct.join(named, "fp", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    return skew_join(rows, group.select("fp", "n", "component_id"), ["fp"], "n", total or 0, F.col("doc_id")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the least of their component, with all their columns.

    Where doc_ids repeat or are null, rows get numbers, and the first of a component stays.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():  # each doc_id names one row
        drops = written(near_duplicates(docs, words, radius).filter("doc_id != component_id").select("doc_id"), "simhash-drops")
        return docs.join(maybe_broadcast(drops, drops.count(), 16), "doc_id", "left_anti").select(docs.columns)
    rows, row = numbered(docs, "simhash-numbered")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, radius)
    drops = written(found.filter("doc_id != component_id").select(F.col("doc_id").alias(row)), "simhash-drops")
    return rows.join(maybe_broadcast(drops, drops.count(), 16), row, "left_anti").select(docs.columns)
