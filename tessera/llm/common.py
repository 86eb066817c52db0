"""What the corpus operators share beyond the library's plumbing: Arrow passes over texts, worker caches, ranks and copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.plumbing import BROADCAST_BYTES, HOT_SHARE, SALTS, fresh, maybe_broadcast, new_path, removed, shared_dir, ship, skew_join, written  # noqa: F401 - for the operators

#: White space of the word rules: space and 0x09-0x0D, which is what bytes.split() splits at.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of texts that a pass works on at a time; also the session's Arrow batch size where the session sets none itself.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_held: tuple[str, object] | None = None


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, made when first asked for."""
    global _held
    if _held is None or _held[0] != name:
        _held = None  # frees the former before the next is made
        _held = (name, make())
    return _held[1]


def release_cache() -> None:
    global _held
    _held = None


def text_pass(docs: DataFrame, columns: list[Column], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps_cache: bool = False) -> DataFrame:
    """One Arrow pass over the named columns only; fn gets slices of BATCH_ROWS rows at most, as texts may be long.

    Workers serve one operator after another: a pass that has no use for what a former one kept lets it go.
    """
    ship(docs.sparkSession)
    conf = docs.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, str(BATCH_ROWS))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_cache:
            release_cache()
        yield from fn(part.slice(at, BATCH_ROWS) for part in it for at in range(0, max(1, part.num_rows), BATCH_ROWS))

    return docs.select(*columns).mapInArrow(run, schema)


def batch(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def folded(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z, and no other letter, lower-cased; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs as a written table whose rows have numbers of their own, and the name of that column, which docs lacks."""
    name = fresh("_row", docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), label), name


#: Rows of a key that one task ranks, and copies that one array of exploded() holds.
RANKED, ARRAY = 1 << 16, 1 << 12


def ranked(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the place of each row among those of its key, from 1, in no stated order; ``order`` tells the rows of a key apart.

    A key of many rows is ranked in parts of some RANKED rows, and each part starts behind those before it.
    """
    m, part, start, total = (fresh(n, [*rows.columns, name]) for n in ("_m", "_part", "_start", "_total"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(m))
    n = rows.count()
    dealt = skew_join(rows, sizes, keys, m, n, F.col(order), "inner").withColumn(part, F.pmod(F.xxhash64(order), F.ceil(F.col(m) / RANKED)))
    place = F.row_number().over(Window.partitionBy(*keys, part).orderBy(order))
    parts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(total))
    before = F.coalesce(F.sum(total).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*keys, part, before.alias(start))
    return dealt.withColumn(name, place).join(starts, [*keys, part]).withColumn(name, F.col(name) + F.col(start)).drop(m, part, start)


def exploded(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered from 1 in a new column; none for n under 1. No array holds more than ARRAY copies, and
    where a row has more, its arrays are dealt over the tasks."""
    top, at = fresh("_top", rows.columns), fresh("_at", rows.columns)
    rows = rows.withColumn(top, n.cast("long")).filter(F.col(top) > 0)
    many = rows.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(top) - 1) / ARRAY))))
    if (rows.agg(F.max(top)).first()[0] or 0) > ARRAY:
        many = many.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2)
    first = F.col(at) * ARRAY + 1
    return many.withColumn(name, F.explode(F.sequence(first, F.least(F.col(top), first + (ARRAY - 1))))).drop(top, at)
