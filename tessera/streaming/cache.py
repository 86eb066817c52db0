"""A bounded cache with expiry as a keyed stream: entries live for a time, and the oldest makes room for a new one.

Each partition of the keys (a shelf) has its own state: when it was put there, for every entry. Requests of a shelf are
served in the order of their time; an entry that is older than ``live`` is gone, and a shelf of ``most`` entries lets the
oldest go before it takes another. A timer clears a shelf that nobody asks for any more, so that state shrinks by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Shelf(StatefulProcessor):
    """Serves requests (shelf, key, at in milliseconds) and tells for each whether it was held."""

    def __init__(self, live: int, most: int):
        self.live, self.most = live, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "key string", "at long, n long")
        self.turn = handle.getValueState("turn", "n long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        asked = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        before = set(held)
        n, until = self.turn.get() if self.turn.exists() else (0, 0)
        hits, gone = [], []
        for k, at in zip(asked["key"].tolist(), asked["at"].tolist()):
            for old in [x for x, (put, _) in held.items() if at - put > self.live]:
                del held[old]
            hits.append(k in held)
            dropped = 0
            if k not in held:
                while len(held) >= self.most:
                    del held[min(held, key=lambda x: held[x][1])]
                    dropped += 1
                n += 1
                held[k] = (int(at), n)
            gone.append(dropped)
        for k in before - set(held):
            self.held.removeKey((k,))
        for k, v in held.items():
            self.held.updateValue((k,), v)
        latest = int(asked["at"].iloc[-1]) + self.live + 1
        if latest > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
            until = latest
        self.turn.update((n, until))
        yield pd.DataFrame({"shelf": key[0], "id": asked["id"], "key": asked["key"], "hit": hits, "evicted": gone})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.held.clear()
        self.turn.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached(stream: DataFrame, shelf: str, key: str, id_: str, time: str, late: str, live: int = fixed.CACHE_SECONDS, most: int = fixed.CACHE_ENTRIES) -> DataFrame:
    """shelf, id, key, hit, evicted (entries that made room) for each request of a stream; the session keeps state in RocksDB."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    asked = stream.withWatermark(time, late).select(F.col(shelf).cast("string").alias("shelf"), F.col(id_).cast("long").alias("id"), F.col(key).cast("string").alias("key"), F.unix_millis(time).alias("at"), F.col(time).alias("_time"))
    kinds = "shelf string, id long, key string, hit boolean, evicted long"
    return asked.groupBy("shelf").transformWithStateInPandas(Shelf(live * 1000, most), kinds, "Append", "EventTime")
