"""The pipeline's SimHash stage: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are the links of SimHash fingerprints of the shingles, found and compared bit-sliced as in ``simhash``. Those
are the closest copies only: at 0.8 fingerprints differ in some 10 of 64 bits, too many for pigeonhole blocks. The other
candidates come from seeded minima of the shingles: BANDS groups of ROWS minima each are keys; a pair at 0.8 shares none
of them with probability (1 - 0.8^5)^24 = 7e-5, and less above. Of those, pairs that agree in LEAST of the 120 minima (at
0.8, 96 agree on average, fewer than 72 in one pair of some ten million) are joined with the links to groups; each group's texts then
meet once, and near copies are pairs whose similarity, counted on the sets themselves, is 0.8 or more. Nothing is left out
of a large bucket or group: above a limit it is compared tile by tile in many tasks. A task yields a spanning forest.

Words are those of op9. Fewer words than a shingle's are one shingle; wordless and null texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import FEW, components
from . import simhash
from .common import batch, folded, maybe_broadcast, numbered, removed, skew_join, text_pass, written
from .simhash import Forest, majority

WORDS = 5
BANDS, ROWS = 24, 5
LEAST = 72
SEED = 42
#: Members of a bucket, and texts of a group, that one task compares; larger buckets are cut into tiles of pairs of parts.
BUCKET_TILE, GROUP_TILE = 4096, 512
#: Texts of a larger group that meet all of its texts, and texts that they meet at a time.
LEADERS, ROOM = 16, 1024
#: Rows a pass over buckets loads at a time.
LANES = 1 << 16

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes; never empty."""
    parts = folded(text).split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    out = h[:n].copy()
    for i in range(1, words):
        out = _mixed(out) + h[i : i + n]
    return np.unique(_mixed(out))


def minima(x: np.ndarray) -> bytes:
    """A byte of each seeded minimum."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1024):  # blocks bound the product of a long text
        out = np.minimum(out, (x[at : at + 1024, None] * _A + _B).min(axis=0))
    return (_mixed(out) & np.uint64(255)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether |a and b| / |a or b| >= 0.8, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


SIGNED = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("sig", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signed(docs: DataFrame, key: str) -> DataFrame:
    """id, fp (the SimHash of the shingles), sig (a byte for each minimum), in one pass without a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield batch(SIGNED, id=b.column(0), fp=np.array([majority(x) for x in sets], np.uint64).view(np.int64), sig=[minima(x) for x in sets])

    return text_pass(docs, [F.col(key).cast("long").alias("id"), F.col("text").cast("string")], run, "id long, fp long, sig binary")


def closest(sigs: DataFrame) -> DataFrame:
    """a, b: the least ids of fingerprints that SimHash links. Equal fingerprints have their ids linked by their minima."""
    distinct = written(sigs.groupBy("fp").agg(F.min("id").alias("id")), "near-prints")
    found = simhash.links(distinct.select("fp"), distinct.count())
    side = lambda name: distinct.select(F.col("fp").alias(name), F.col("id").alias(f"{name}_id"))
    return found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def tiled(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """rows (id, m: the size of their key) with i, j: keys above ``tile`` are cut into parts, and each pair of parts is a tile."""
    parts = F.when(F.col("m") > tile, F.ceil(F.col("m") / (tile // 2)).cast("int")).otherwise(1)
    rows = rows.withColumns({"_part": F.pmod(F.xxhash64("id"), parts).cast("int"), "_other": F.explode(F.sequence(F.lit(0), parts - 1))})
    rows = rows.withColumns({"i": F.least("_part", "_other"), "j": F.greatest("_part", "_other")}).drop("_part", "_other", "m")
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _rooms(change: np.ndarray) -> np.ndarray:
    """Places after each one in its run; a run starts where change is true."""
    ends = np.append(np.flatnonzero(change)[1:], len(change))
    return np.repeat(ends, np.diff(np.append(np.flatnonzero(change)[0], ends))) - np.arange(len(change)) - 1


def candidates(sigs: DataFrame, tile: int = BUCKET_TILE) -> DataFrame:
    """a, b: links that span the components of the pairs that share a key and agree in LEAST minima."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))))
    rows = sigs.select("id", F.explode(key).alias("k"))
    total = BANDS * sigs.count()
    shared = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-shared")
    found = written(skew_join(rows, shared, ["k"], "m", total, F.col("id"), "inner"), "near-buckets")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(ids: np.ndarray, keys: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            room = _rooms(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            forest, out = Forest(len(ids)), []
            for d in range(1, int(room.max()) + 1):
                at = np.flatnonzero(room >= d)
                at = at[forest.label[at] != forest.label[at + d]]
                at = at[(sig[at] == sig[at + d]).sum(axis=1) >= LEAST]
                out += forest.join(at, at + d)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return batch(LINKS, a=ids[pairs[:, 0]], b=ids[pairs[:, 1]])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)], axis=1).astype(np.int64)
            held.append((ids, keys, np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)))
            if sum(len(x[0]) for x in held) >= LANES:
                ids, keys, sig = (np.concatenate(x) for x in zip(*held))
                same = (keys == keys[-1]).all(axis=1)  # the last bucket may go on
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                held = [(ids[cut:], keys[cut:], sig[cut:])]
                if cut:
                    yield linked(ids[:cut], keys[:cut], sig[:cut])
        if held and sum(len(x[0]) for x in held):
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return tiled(found.join(sigs, "id"), ["k"], tile).select("id", "k", "i", "j", "sig").mapInArrow(run, "a long, b long")


def _joined(ids: list[int], sets: list[np.ndarray], label: np.ndarray, firsts: int | None = None) -> list[tuple[int, int]]:
    """Links between similar sets of different labels, which they join; with ``firsts``, only between those in front and the rest."""
    out = []
    for a in range(len(ids) if firsts is None else firsts):
        at = a + 1 if firsts is None else firsts
        for b in (np.flatnonzero(label[at:] != label[a]) + at).tolist():
            if label[a] != label[b] and similar(sets[a], sets[b]):
                label[label == label[b]] = label[a]
                out.append((ids[a], ids[b]))
    return out


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch(LINKS, a=[x[0] for x in found], b=[x[1] for x in found])


def verified(groups: DataFrame) -> DataFrame:
    """a, b: links that span the components of the similar pairs within each group (id, component, text), one task a group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for rows in it:
            out = []
            for n, c, text in zip(*(x.to_pylist() for x in rows.columns)):
                if c != at:
                    out += _joined(ids, sets, np.arange(len(ids)))
                    at, ids, sets = c, [], []
                ids.append(n)
                sets.append(shingles(text))
            yield _links(out)
        yield _links(_joined(ids, sets, np.arange(len(ids))))

    return groups.repartition("component").sortWithinPartitions("component").select("id", "component", "text").mapInArrow(run, "a long, b long")


SETS = pa.schema([("id", pa.int64()), ("component", pa.int64()), ("m", pa.int64()), ("hashes", pa.binary())])


def _sets(groups: DataFrame) -> DataFrame:
    """id, component, m and the set of shingles of each text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t.as_py()).tobytes() for t in b.column(3)], pa.binary())], schema=SETS)

    return groups.select("id", "component", "m", "text").mapInArrow(run, "id long, component long, m long, hashes binary")


def _met(rows: DataFrame) -> DataFrame:
    """a, b: links between the firsts and the others of each room (id, component, room, first, label, hashes) that join labels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, labels, firsts = None, [], [], [], 0

        def met() -> list[tuple[int, int]]:
            return _joined(ids, sets, np.unique(labels, return_inverse=True)[1], firsts) if ids else []

        for b in it:
            out = []
            for n, c, r, first, label, hashes in zip(*(x.to_pylist() for x in b.columns)):
                if (c, r) != at:
                    out += met()
                    at, ids, sets, labels, firsts = (c, r), [], [], [], 0
                if not first and len(ids) >= firsts + ROOM:
                    out += met()  # the firsts stay, with what was joined
                    ids, sets, labels = ids[:firsts], sets[:firsts], labels[:firsts]
                ids.append(n)
                sets.append(np.frombuffer(hashes, np.uint64))
                labels.append(label)
                firsts += first
            yield _links(out)
        yield _links(met())

    dealt = rows.repartition("component", "room").sortWithinPartitions("component", "room", F.desc("first"))
    return dealt.select("id", "component", "room", "first", "label", "hashes").mapInArrow(run, "a long, b long")


def settled(groups: DataFrame, tile: int) -> DataFrame:
    """a, b: the same links of groups (id, component, m, text) of more than ``tile`` texts each.

    LEADERS texts of a group meet all others, which are dealt over rooms. Where that leaves the group in several parts, the
    texts outside of its largest part are cut into tiles that meet the whole group once more, room by room. So a text is
    copied for each ``tile`` of the texts left apart, and not for each tile of its group.
    """
    sets = written(_sets(groups), "near-sets")
    order = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("id"), "id"))
    leaders = sets.select("component", "id").withColumn("_r", order).filter(F.col("_r") <= LEADERS).drop("_r")
    rooms = F.ceil(F.col("m") / tile).cast("int")
    room = F.pmod(F.xxhash64("id"), rooms).cast("int")
    every = F.explode(F.sequence(F.lit(0), rooms - 1))
    named = sets.withColumn("label", F.col("id"))
    fore = named.join(written(leaders, "near-leaders"), ["component", "id"], "left_semi").withColumns({"room": every, "first": F.lit(1)})
    links = written(_met(named.withColumns({"room": room, "first": F.lit(0)}).unionByName(fore)), "near-links")
    parts = components(links, "a", "b", few=FEW).select(F.col("node").alias("id"), F.col("component").alias("label"))
    labelled = written(sets.join(parts, "id", "left").withColumn("label", F.coalesce("label", "id")), "near-labelled")
    sizes = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.filter(F.col("all") > F.col("most")).select("component", "main", F.ceil((F.col("all") - F.col("most")) / tile).cast("int").alias("tiles"))
    rest = written(skew_join(labelled, main.join(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("_n")), "component"), ["component"], "_n", labelled.count(), F.col("id"), "inner"), "near-rest")
    removed(sets)
    # tile k of those apart is first in the rooms k * rooms .. k * rooms + rooms - 1, which all others are dealt over
    mine = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    fore = rest.filter(F.col("label") != F.col("main")).withColumn("_each", every).select("id", "component", (mine * rooms + F.col("_each")).alias("room"), F.lit(1).alias("first"), "label", "hashes")
    back = rest.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("id", "component", (F.col("_tile") * rooms + room).alias("room"), F.lit(0).alias("first"), "label", "hashes")
    return links.unionByName(_met(fore.unionByName(back)))


def near_copies(docs: DataFrame, key: str = "doc_id", tile: int = GROUP_TILE) -> DataFrame:
    """node, component (its least key) of the rows of docs that are similar to another; keys are whole numbers of one row each."""
    sigs = written(signed(docs, key), "near-sigs")
    near = components(candidates(sigs.select("id", "sig")).unionByName(closest(sigs)), "a", "b", few=FEW)
    near = written(near.select(F.col("node").alias("id"), "component"), "near-groups")
    removed(sigs)
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    n = near.count()
    member = written(skew_join(near, sizes, ["component"], "m", n, F.col("id"), "inner"), "near-members")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(maybe_broadcast(member, n, 32), "id")
    links = verified(found.filter(F.col("m") <= tile))
    if not member.filter(F.col("m") > tile).isEmpty():
        links = links.unionByName(settled(found.filter(F.col("m") > tile), tile))
    return components(links, "a", "b", few=FEW)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that have the least doc_id of their component, with all their columns.

    Where doc_ids repeat or are null, rows get numbers, and the first of a component stays.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():  # each doc_id names one row
        rows, key = docs, "doc_id"
    else:
        rows, key = numbered(docs, "near-numbered")
    drops = written(near_copies(rows, key).filter("node != component").select(F.col("node").alias(key)), "near-drops")
    return rows.join(maybe_broadcast(drops, drops.count(), 16), key, "left_anti").select(docs.columns)
