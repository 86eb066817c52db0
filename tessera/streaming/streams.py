"""Structured Streaming counterparts: windowed counts, deduplication, sessions and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Store


def events(spark: SparkSession, path: str, schema, time: str = "ts") -> DataFrame:
    """Files as a stream; time zone-less times become instants, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, time: str, every: str, late: str, by: list[str], value: str) -> DataFrame:
    w = F.window(F.col(time), every)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(stream: DataFrame, time: str, length: str, every: str, late: str, value: str) -> DataFrame:
    w = F.window(F.col(time), length, every)
    return stream.withWatermark(time, late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    w = F.session_window(F.col(time), gap)
    return stream.withWatermark(time, late).groupBy(by, w).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet table, and reads that; a second run takes up where this ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def drained_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream batch by batch through a function that may be called again with the same number."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_into(path: str, key: str, version: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the newest row of each key in the table ``rows`` of a store.

    A batch rewrites the buckets that its keys fall in, and takes effect with a pointer that carries its number: one that is
    repeated after a failure changes nothing. Files of former versions go.
    """

    def each(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, path, buckets)
        at = store.pointer()
        if at.batch >= n:
            return
        touched = store.touched(batch, [key])
        held = store.read("rows", touched, at)
        rows = batch if held is None else held.unionByName(batch)
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, F.to_json(F.struct(*rows.columns)))).alias("r")).select("r.*")
        store.commit({"rows": store.stage("rows", newest, [key], touched)}, batch=n)
        store.vacuum()

    return each
