"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document of the source should be copied r = target / source size times. The whole
part of r is certain; the fraction is a copy probability, and probabilities are rounded in pairs: of two documents with
fractional probabilities, words are moved from one to the other, by a random direction that leaves each expectation as
it is, until one probability is 0 or 1. The words taken stay the same in every step, so that a source ends within one
document of its target. Blocks of documents are rounded side by side and leave one fractional document each; those meet
in a tree of blocks of blocks, up to one document a source, which is rounded on its own.

Defined results: a null or wordless text has size 0, takes 0 words and changes nothing. Null source is a source of its
own, last in order. Rows that agree in all columns are rounded as separate documents. Reruns agree: blocks and random
numbers come from the rows and ``seed`` alone, not from partitions. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, batch, exploded, fresh, numbered, ranked, skew_join, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents of a block at the lowest level, and blocks that meet at each level above.
BLOCK, FAN_IN = 4096, 64


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the row that decides its block."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n, target; sources in order of code points, null last, take the weights in turn.

    Sources are ranked by range partitions whose counts (one row for each partition) are summed up. Water is then
    filled in: each round reshares among the sources that aren't full; a round is one small aggregate.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ordered = written(total.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = ordered.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written(ordered.join(F.broadcast(before.drop("count")), "_part").withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights))).cast("int"))).drop("_part", "_before"), "mix-ranked")
    whole = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") >= most * F.col("source_size")
        got = ranked.agg(F.sum(F.when(capped, 1).otherwise(0)), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if got[0] is None or got[0] == full or not got[2]:
            break
        full, level = got[0], (whole - got[1]) / got[2]
    target = F.least(F.lit(level) * F.col("weight"), most * F.col("source_size"))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _uniform(seed: int, *key: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=7).digest(), "big") / (1 << 56)


STATE = "doc_id long, row_hash long, source string, size long, whole long, p double, block long, open boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("whole", pa.int64()), ("p", pa.float64()), ("block", pa.int64()), ("open", pa.bool_())])
ENDS = 1e-9


def round_blocks(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Pivotal rounding within each (source, block); the one document of each that may stay fractional is ``open``.

    A partition holds whole blocks in order, and the pass keeps one pending document: memory does not grow with a block.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = None, None
        for b in it:
            out: list[tuple] = []
            for doc, name, source, size, whole, p, block, _ in zip(*[c.to_pylist() for c in b.columns]):
                if (source, block) != where:
                    if held:
                        out.append((*held, True))
                    held, where = None, (source, block)
                if size == 0 or p < ENDS or p > 1 - ENDS:
                    out.append((doc, name, source, size, whole, float(round(p)), block, False))
                    continue
                if held is None:
                    held = (doc, name, source, size, whole, p, block)
                    continue
                d2, n2, _, s2, w2, p2, _ = held
                up, down = min((1 - p) * size, p2 * s2), min(p * size, (1 - p2) * s2)  # words that can move to this one, and from it
                if _uniform(seed, level, source, block, name, n2, size, s2) * (up + down) < down:
                    p, p2 = p + up / size, p2 - up / s2
                else:
                    p, p2 = p - down / size, p2 + down / s2
                one, two = (doc, name, source, size, whole, p, block), (d2, n2, source, s2, w2, p2, block)
                held = None
                for x in (two, one):
                    if ENDS < x[5] < 1 - ENDS:
                        held = x
                    else:
                        out.append((*x[:5], float(round(x[5])), block, False))
            if out:
                yield batch(ARROW, **dict(zip(ARROW.names, map(list, zip(*out)))))
        if held:
            yield batch(ARROW, **{n: [v] for n, v in zip(ARROW.names, (*held, True))})

    # a block's documents go from large to small, so that the one left over is a small one
    dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", F.col("size").desc(), "doc_id", "row_hash")
    return dealt.select(*ARROW.names).mapInArrow(run, STATE)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, row_hash, source, size, source_size, target, copies, taken."""
    rows = written(sizes(docs), "mix-rows")
    goals = written(targets(rows, weights, share, most), "mix-targets")
    held, largest, total = goals.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    keyed = goals.withColumn("_s", F.struct("source")).drop("source")  # a struct of null is not null: it joins

    def with_goals(df: DataFrame) -> DataFrame:
        named = df.withColumn("_s", F.struct("source"))
        if held * 64 <= BROADCAST_BYTES:
            return named.join(F.broadcast(keyed), "_s")
        return skew_join(named, keyed, ["_s"], "n", total, F.col("row_hash"), "inner")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    start = with_goals(rows).withColumn("r", ratio)
    start = start.select("doc_id", "row_hash", "source", "size", F.floor("r").alias("whole"), (F.col("r") - F.floor("r")).alias("p"), F.pmod("row_hash", blocks).alias("block"), F.lit(True).alias("open"))
    level = written(round_blocks(start, seed, 0), "mix-level")
    done, left, depth = level.filter("not open"), -(-int(largest or 0) // block), 0
    while left > 1:
        depth, left = depth + 1, -(-left // fan_in)
        up = level.filter("open").withColumn("block", F.floor(F.col("block") / fan_in))
        level = written(round_blocks(up, seed, depth), "mix-level")
        done = done.unionByName(level.filter("not open"))
    last = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    rounded = done.unionByName(level.filter("open").withColumn("p", last.cast("double")))
    out = with_goals(rounded)
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return out.select("doc_id", "row_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows equal in doc_id, source and text share their copies."""
    key, hashed, copies, m = (fresh(n, docs.columns) for n in ("_id", "_hash", "_copies", "_rows"))
    named = lambda df: df.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    taken = named(mix(docs, **options)).withColumnRenamed("row_hash", hashed).groupBy(key, hashed).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(m))
    taken = written(taken.filter(F.col(copies) > 0), "mix-taken")
    rows = named(docs).withColumn(hashed, F.xxhash64("doc_id", "source", "text"))
    if taken.filter(F.col(m) > 1).isEmpty():
        out = rows.join(taken, [key, hashed])
    else:  # equal rows get numbers; a key's copies are shared out by place
        rows, row = numbered(rows, "mix-numbered")
        place = fresh("_place", rows.columns)
        each = written(skew_join(rows.select(row, key, hashed), taken, [key, hashed], m, rows.count(), F.col(row), "inner"), "mix-each")
        more = F.floor(F.col(copies) / F.col(m)) + F.when(F.col(place) <= F.col(copies) % F.col(m), 1).otherwise(0)
        shared = ranked(each.filter(F.col(m) > 1), [key, hashed], row, place).select(row, more.cast("long").alias(copies))
        out = rows.join(written(each.filter(F.col(m) == 1).select(row, copies).unionByName(shared), "mix-shares"), row)
    return exploded(out, F.col(copies), fresh("_n", out.columns)).select(docs.columns)
