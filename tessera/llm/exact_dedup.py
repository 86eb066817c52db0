"""Exact deduplication by composable polynomial fingerprints.

A text's bytes c_0..c_{n-1} have the fingerprint sum(c_i * B^(n-1-i)) mod P, for two primes P under 2^31. Texts are cut
into chunks whose hashes are computed side by side (rows of one matrix product) and combined by length-shifted
arithmetic: H(xy) = H(x) * B^len(y) + H(y). Texts of equal length and fingerprints are then compared chunk by chunk with
the group's representative; a group in which any chunk differs is split by SHA-256.

Defined results: null text counts as empty, and empty texts are one group. A null doc_id ranks below all others. Of rows
that agree in doc_id and text, exactly one is kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, exploded, folded, maybe_broadcast, numbered, skew_join, text_pass, written

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1977012337)
#: Bytes of a hashed row: 255 * 2^31 * 4096 < 2^53, so that float64 products and sums are exact.
ROW = 4096
#: Bytes of a chunk in the comparison of texts.
CHUNK = 1 << 16
KEY = ["fp_a", "fp_b", "n_bytes"]


def combine(a: tuple[int, int], b: tuple[int, int], prime: int = PRIMES[0], base: int = BASES[0]) -> tuple[int, int]:
    """(hash, length) of the concatenation of two pieces of which the (hash, length) are known."""
    return (a[0] * pow(base, b[1], prime) + b[0]) % prime, a[1] + b[1]


class Fingerprints:
    """Fingerprints of many texts at a time; the matrix of chunk rows never holds more than ``rows`` rows."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, rows: int = 256):
        self.primes, self.bases, self.rows = primes, bases, rows
        self.powers = np.array([[pow(b, ROW - 1 - i, p) for b, p in zip(bases, primes)] for i in range(ROW)], dtype=np.float64)
        self.shift = [pow(b, ROW, p) for b, p in zip(bases, primes)]

    def _hashed(self, parts: list[bytes]) -> np.ndarray:
        m = np.zeros((len(parts), ROW), dtype=np.uint8)
        for i, x in enumerate(parts):
            m[i, ROW - len(x) :] = np.frombuffer(x, np.uint8)  # zeros in front add nothing
        return (m.astype(np.float64) @ self.powers).astype(np.int64) % np.array(self.primes)

    def of(self, texts: list[bytes]) -> list[tuple[int, int]]:
        out = [[0, 0] for _ in texts]
        parts: list[bytes] = []
        owners: list[int] = []

        def flush() -> None:
            if parts:
                for k, row in zip(owners, self._hashed(parts).tolist()):
                    h = out[k]
                    for j in (0, 1):  # each part after the first is ROW bytes long
                        h[j] = (h[j] * self.shift[j] + row[j]) % self.primes[j]
                parts.clear()
                owners.clear()

        for k, t in enumerate(texts):
            first = len(t) % ROW
            for a, b in [(0, first)] * (first > 0) + [(x, x + ROW) for x in range(first, len(t), ROW)]:
                parts.append(t[a:b])
                owners.append(k)
                if len(parts) >= self.rows:
                    flush()
        flush()
        return [(a, b) for a, b in out]


SCHEMA = "doc_id long, fp_a long, fp_b long, n_bytes long, text_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, fingerprints, length in bytes and SHA-256 of each normalised text, in one pass without a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(primes)
        for b in it:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                texts = [folded(t) for t in part.column(1).to_pylist()]
                fps = made.of(texts)
                yield batch(ARROW, doc_id=part.column(0).to_pylist(), fp_a=[x[0] for x in fps], fp_b=[x[1] for x in fps], n_bytes=[len(t) for t in texts], text_sha256=[hashlib.sha256(t).hexdigest() for t in texts])

    return text_pass(docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], run, SCHEMA)


CHUNKS = pa.schema([("doc_id", pa.int64()), ("is_rep", pa.bool_()), *[(k, pa.int64()) for k in KEY], ("chunk_no", pa.int64()), ("chunk", pa.binary())])


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for each CHUNK bytes of each text (doc_id, is_rep, KEY, text), in batches of some 64 chunks' bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in it:
            for *row, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "is_rep", *KEY)], b.column("text")):
                text = folded(text.as_py())
                for n in range(max(1, -(-len(text) // CHUNK))):
                    held.append((*row, n, text[n * CHUNK : (n + 1) * CHUNK]))
                    size += 100 + len(held[-1][-1])
                    if size >= 64 * CHUNK:
                        yield batch(CHUNKS, **dict(zip(CHUNKS.names, map(list, zip(*held)))))
                        held, size = [], 0
        if held:
            yield batch(CHUNKS, **dict(zip(CHUNKS.names, map(list, zip(*held)))))

    return docs.mapInArrow(run, "doc_id long, is_rep boolean, fp_a long, fp_b long, n_bytes long, chunk_no long, chunk binary")


def differing(docs: DataFrame, groups: DataFrame, prints: DataFrame, total: int) -> DataFrame:
    """Keys of the groups in which a member's chunk is not that of the representative (its largest doc_id).

    Only texts whose fingerprint occurs more than once are read again. A hot group's chunks are dealt over many tasks.
    """
    multi = groups.filter("n > 1")
    members = prints.join(multi.select(*KEY), KEY, "left_semi").select("doc_id", *KEY).distinct()
    n = multi.agg(F.sum("ids")).first()[0] or 0
    members = maybe_broadcast(members.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), *KEY), n, 48)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_id": F.coalesce("doc_id", F.lit(-1)), "_null": F.col("doc_id").isNull()}).join(members, ["_id", "_null"])
    rows = _chunks(skew_join(texts, multi, KEY, "n", total, F.col("doc_id")).withColumn("is_rep", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "is_rep", *KEY, "text"))
    rows = written(rows, "dedup-chunks")
    reps = rows.filter("is_rep").groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("rep_chunk")).join(multi.select(*KEY, "n"), KEY)
    pairs = skew_join(rows, reps, [*KEY, "chunk_no"], "n", total, F.col("doc_id"))
    return pairs.filter(~F.col("chunk").eqNullSafe(F.col("rep_chunk"))).select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    prints = written(fingerprints(docs, primes), "dedup-prints")
    total = prints.count()
    once = prints.groupBy(*KEY, "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    groups = lambda keys: once.groupBy(*keys).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("ids"), F.max("doc_id").alias("keep_id"))
    found = written(groups(KEY).filter("n > 1"), "dedup-groups")
    bad = written(differing(docs, found, prints, total), "dedup-differing")
    keys = KEY
    n_bad = bad.count()
    if n_bad:  # unequal texts under one fingerprint: their SHA-256 tells them apart
        once = once.join(maybe_broadcast(bad.withColumn("_bad", F.lit(True)), n_bad, 32), KEY, "left").withColumn("split", F.when(F.col("_bad"), F.col("text_sha256")).otherwise("")).drop("_bad")
        keys = [*KEY, "split"]
        found = written(groups(keys).filter("n > 1"), "dedup-groups")
    out = skew_join(once, found.drop("ids"), keys, "n", total, F.col("doc_id"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", "m").alias("group_size"), "text_sha256", "n_bytes", "m")
    if once.agg(F.max("m")).first()[0] not in (None, 1):  # rows that agree in doc_id and text
        out = exploded(written(out, "dedup-rows"), F.col("m"), "_copy")
    else:
        out = out.withColumn("_copy", F.lit(1))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256", "n_bytes")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Up to BROADCAST_BYTES of dropped ids no text is shuffled.

    Where doc_ids repeat or are null, rows get numbers, and a group's row of the largest doc_id with the least number stays.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.filter("count > 1 or doc_id is null").isEmpty():  # each doc_id names one row
        drops = written(exact_duplicates(docs).filter("not kept").select("doc_id"), "dedup-drops")
        return docs.join(maybe_broadcast(drops, drops.count(), 16), "doc_id", "left_anti").select(docs.columns)
    rows, row = numbered(docs, "dedup-numbered")
    found = exact_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))  # equal texts by row number
    group = found.select(F.col("doc_id").alias(row), F.col("keep_id").alias("_group"))
    group = written(group.join(rows.select(row, F.col("doc_id").cast("long").alias("_id")), row), "dedup-grouped")
    best = group.groupBy("_group").agg(F.max_by(row, F.struct(F.coalesce("_id", F.lit(-(1 << 63))), F.col("_id").isNotNull(), -F.col(row))).alias(row))
    keep = written(best.select(row), "dedup-kept")
    return rows.join(maybe_broadcast(keep, keep.count(), 16), row, "left_semi").select(docs.columns)
