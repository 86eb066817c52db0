"""Queries: streams over the events table, each run to its end; in SQL, the same over the table at rest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.storage import Store
from ..streaming import cache
from ..streaming import graph as citations
from ..streaming import streams
from .base import Tables, query
from .graphs import PARTS


def _folder(t: Tables, label: str) -> str:
    """A new folder in the store that driver and executors share."""
    from ..operators.graph import settled_folder

    return f"{settled_folder(t.spark)}/stream-{label}-{uuid.uuid4().hex}"


def _events(t: Tables):
    """The file of events as a stream, with times as instants."""
    # a pattern, so that a table of one file is taken as well as a folder of files
    return streams.events(t.spark, f"{t.sf_dir}/events.parque[t]", t.events.schema)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables):
    folder = _folder(t, "tumbling")
    # complete results come from update batches: the last state of a window is its largest count
    out = streams.tumbling(_events(t), "ts", "1 day", "1 hour", ["event_type"], "value")
    streams.drained_batches(out, f"{folder}/checkpoint", lambda df, n: df.withColumn("_n", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/{n:06d}"))
    rows = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    newest = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "_n").alias("r"))
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", "r.total")


@query("""WITH w AS (SELECT unnest([date_trunc('hour', ts) - INTERVAL (hour(ts) % 12) HOUR, date_trunc('hour', ts) - INTERVAL (hour(ts) % 12 + 12) HOUR]) AS start, value FROM events) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def stream_sliding(t: Tables):
    folder = _folder(t, "sliding")
    out = streams.sliding(_events(t), "ts", "24 hours", "12 hours", "1 hour", "value")
    streams.drained_batches(out, f"{folder}/checkpoint", lambda df, n: df.withColumn("_n", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/{n:06d}"))
    rows = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    newest = rows.groupBy("start").agg(F.max_by(F.struct("n", "total"), "_n").alias("r"))
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "r.n", "r.total")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_sessions(t: Tables):
    folder = _folder(t, "sessions")
    # a long watermark keeps every session open to the end, where complete mode writes all of them
    out = streams.sessions(_events(t), "ts", "6 hours", "365 days", "user_id")
    streams.drained_batches(out, f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out"), mode="complete")
    return t.spark.read.parquet(f"{folder}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables):
    folder = _folder(t, "dedup")
    out = streams.deduplicated(_events(t), "ts", "365 days", ["user_id", "event_type"]).select("user_id", "event_type")
    return streams.drained(out, f"{folder}/out", f"{folder}/checkpoint")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(t: Tables):
    folder = _folder(t, "upsert")
    each = streams.upsert_into(f"{folder}/table", "user_id", "event_id")
    streams.drained_batches(_events(t).select("user_id", "event_id"), f"{folder}/checkpoint", each, mode="append")
    return Store(t.spark, f"{folder}/table").read("rows")


@query(f"WITH {PARTS} SELECT * FROM edges")
def stream_co_citation(t: Tables):
    """The bridge comes in three batches that cut through its baskets; the last is sent once more."""
    folder = _folder(t, "graph")
    bridge = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"))
    bridge.repartition(F.xxhash64("doc", "item")).write.parquet(f"{folder}/bridge")
    files = len(t.spark.read.parquet(f"{folder}/bridge").inputFiles())
    stream = t.spark.readStream.schema(bridge.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{folder}/bridge")
    each = citations.co_citations_into(f"{folder}/graph", buckets=t.spark.sparkContext.defaultParallelism)
    streams.drained_batches(stream, f"{folder}/checkpoint", each, mode="append")
    store = Store(t.spark, f"{folder}/graph")
    each(bridge, store.pointer().batch)
    return citations.edges(store, least_co=2, places=6)


@query("""WITH RECURSIVE asked AS (SELECT event_id, user_id, user_id % 2 AS shelf, epoch_ms(ts) AS at_ms, row_number() OVER (PARTITION BY user_id % 2 ORDER BY epoch_ms(ts), event_id) AS step FROM events),
    served AS (SELECT DISTINCT shelf, 0::BIGINT AS step, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, false AS hit, 0 AS evicted, []::STRUCT(k BIGINT, put BIGINT)[] AS held FROM asked
        UNION ALL SELECT shelf, step, event_id, user_id, hit, CASE WHEN NOT hit AND len(live) >= 24 THEN 1 ELSE 0 END, CASE WHEN hit THEN live ELSE list_append(CASE WHEN len(live) >= 24 THEN live[2:] ELSE live END, {'k': user_id, 'put': at_ms}) END
        FROM (SELECT *, len(list_filter(live, lambda h: h.k = user_id)) > 0 AS hit FROM (SELECT a.shelf, a.step, a.event_id, a.user_id, a.at_ms, list_filter(s.held, lambda h: a.at_ms - h.put <= 28800000) AS live FROM served s JOIN asked a ON a.shelf = s.shelf AND a.step = s.step + 1)))
    SELECT shelf::VARCHAR AS shelf, event_id AS id, user_id::VARCHAR AS key, hit, evicted::BIGINT AS evicted FROM served WHERE step > 0""")
def stream_cache(t: Tables):
    """Users asked for in two caches of 24 entries that live for eight hours, as events come rarely."""
    folder = _folder(t, "cache")
    asked = _events(t).withColumn("shelf", F.col("user_id") % 2)
    return streams.drained(cache.cached(asked, "shelf", "user_id", "event_id", "ts", "1 hour", live=28_800), f"{folder}/out", f"{folder}/checkpoint")
