"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pieces go from long to short, each into the open sequence with the least room that still takes it; a segment tree over
remaining capacities finds it in logarithmic time. Shards of pieces are packed side by side; each shard gives its
least-filled sequences back, and those are packed again by shards of shards, up to one, so that the shards' tails are
shared. No piece is left out and none moves beyond its shard's task.

Defined results: null and empty texts are one piece of one end token. Only documents longer than a sequence are cut.
Rows that agree are packed as separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, text_pass, written
from .tokens import word_ends

LENGTH = 2048
END = 0
#: Pieces of a shard, shards that meet at each level above, and sequences that a shard gives back.
SHARD, FAN_IN, BACK = 8192, 32, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids and the end id, cut at ``length``; ids (little-endian 32-bit) only if asked for."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ends(vocabulary)
        tail, step = int(end).to_bytes(4, "little"), 4 * length
        for b in it:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                out: dict[str, list] = {n: [] for n in ARROW.names}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = cache.text(text.as_py()) + tail
                    for n, a in enumerate(range(0, len(ids), step)):
                        own = ids[a : a + step]
                        for k, v in zip(ARROW.names, (doc, n, a // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None)):
                            out[k].append(v)
                yield batch(ARROW, **out)

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, PIECES, keeps_cache=True)


class Rooms:
    """A segment tree over remaining capacities 0..length: each leaf has the open sequences with that much room."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def tightest(self, need: int) -> int:
        """Takes out a sequence with the least room of at least ``need``, as (room, sequence) packed; -1 if there is none."""
        has, at = self.any, need + self.size
        if not has[at]:
            while at > 1 and (at & 1 or not has[at + 1]):  # up until a sibling on the right has something
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.size:  # down to its leftmost leaf
                at <<= 1
                at += not has[at]
        room = at - self.size
        sequence = self.open[room].pop()
        if not self.open[room]:
            has[at] = 0
            at >>= 1
            while at and not (has[2 * at] or has[2 * at + 1]):
                has[at] = 0
                at >>= 1
        return room << 40 | sequence


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the room left in each sequence; pieces go from long to short."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, left = Rooms(length), []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        got = rooms.tightest(n)
        room, sequence = (length, len(left)) if got < 0 else (got >> 40, got & (1 << 40) - 1)
        if got < 0:
            left.append(length)
        place[i], offset[i] = sequence, length - room
        left[sequence] = room - n
        if room > n:
            rooms.put(room - n, sequence)
    return place, offset, np.array(left, np.int64)


def _pack(rows: DataFrame, level: int, length: int, back: int) -> DataFrame:
    """Packs each shard; pieces in its ``back`` least-filled sequences are marked ``again``."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        place, offset, left = best_fit(t.column("length").to_numpy(), length)
        worst = np.zeros(len(left), bool)
        worst[np.argsort(-left, kind="stable")[:back]] = True
        worst &= left > 0
        shard = t.column("shard")[0].as_py()
        # a number for each level, shard and sequence
        ids = (np.int64(level) << 56) + (np.int64(shard) << 24) + place
        for name, values in (("sequence_id", ids), ("offset", offset), ("again", worst[place])):
            t = t.set_column(t.schema.get_field_index(name), name, pa.array(values))
        return t

    return rows.groupBy("shard").applyInArrow(run, rows.schema)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, shard: int = SHARD, fan_in: int = FAN_IN, back: int = BACK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, vocabulary or default_vocabulary(), length, end).drop("ids"), "pack-pieces")
    shards = max(1, -(-cut.count() // shard))
    # numbers of the written table's rows deal the pieces evenly, whatever their documents
    rows = cut.withColumns({"shard": F.pmod(F.monotonically_increasing_id(), F.lit(shards)), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "again": F.lit(True)})
    level, done = 0, None
    while True:
        packed = written(_pack(rows, level, length, back if shards > 1 else 0), "pack-level")
        part = packed.filter("not again")
        done = part if done is None else done.unionByName(part)
        if shards == 1:
            return done.drop("shard", "again")
        level, shards = level + 1, -(-shards // fan_in)
        rows = packed.filter("again").withColumn("shard", F.floor(F.col("shard") / fan_in))


def sequences(docs: DataFrame, layout: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """sequence_id, ids: the token ids of each packed sequence in order, for writing out; layout is pack(docs).

    A sequence holds ``length`` ids at most. Needs one row for each doc_id.
    """
    ids = pieces(docs, vocabulary or default_vocabulary(), length, end, with_ids=True).select("doc_id", "piece", "ids")
    parts = layout.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
