"""Streams that remember for a while: caches whose entries expire, and deduplication within a watermark.

State is kept by the stream's own store, by key, and goes when its time is over:
by event time here, so that a run repeated over the same rows gives the same
rows. A stream that stops goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers needs this store; cache_stream() sets it for the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LOOKED_UP = "cache_key string, asked_at timestamp, answer string, stored_at timestamp"
_FOUND = "cache_key string, asked_at long, answer string, stored_at long"


class _Cache(StatefulProcessor):
    """One value a key. An entry answers what is asked after it and within ``hours``; a timer at its expiry clears it.

    Times are microseconds. Rows come as rows, not as a pandas frame a key: most keys have few.
    """

    def __init__(self, hours: int) -> None:
        self.micros = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "answer string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        events = sorted((r.micros, r.is_query, r.answer is not None, r.answer or "") for r in rows)
        held = self.entry.get()
        answer, at = held or (None, None)
        stored = False
        for now, is_query, known, said in events:
            if is_query:
                fresh = at is not None and now - self.micros < at <= now
                yield Row(cache_key=key[0], asked_at=now, answer=answer if fresh else None, stored_at=at if fresh else None)
            elif at is None or now >= at:
                answer, at, stored = said if known else None, now, True
        if stored:
            if held:  # only then there is a timer
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.entry.update((answer, at))
            self.handle.registerTimer((at + self.micros) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, ttl_hours: int, late: str = "0 seconds") -> DataFrame:
    """LOOKED_UP of a stream events(cache_key, at, is_query, answer): what the cache answers each query, null if it has nothing young enough.

    Within a micro-batch rows of a key go by time, stores before queries of the
    same time; of stores at one time the greatest answer holds. Rows later than
    the watermark (``late``) are not looked at. Keys and times are not null. A
    key's state is one entry, which a timer clears when it expires.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    rows = events.where("cache_key is not null and at is not null").withWatermark("at", late)
    rows = rows.select("cache_key", "at", F.unix_micros("at").alias("micros"), "is_query", "answer")
    found = rows.groupBy("cache_key").transformWithState(_Cache(ttl_hours), outputStructType=_FOUND, outputMode="Append", timeMode="EventTime")
    return found.select("cache_key", F.timestamp_micros("asked_at").alias("asked_at"), "answer", F.timestamp_micros("stored_at").alias("stored_at"))


def distinct_within(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """A stream's rows, of those that share the keys within the watermark's delay one.

    State is bounded by the keys of that time. A row that repeats after the delay
    passes again; one later than the watermark is dropped. Rows of a null time
    are left out.
    """
    return rows.where(F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
