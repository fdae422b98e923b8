"""Keyed state in streams: sessions with a time to live and a capacity, and the last values of logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyed import KeyedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION_ENDS = "owner long, session_id long, created_ms long, ended_ms long, reason string"


class Sessions(StatefulProcessor):
    """Sessions of an owner, in the order of their creation: one ends when ``capacity`` newer ones have come, else when its time to live is over.

    A session is decided by a timer once the watermark has passed the end of its time to live, as all that could push it out is known then. State holds the undecided sessions."""

    def __init__(self, ttl_ms: int, capacity: int):
        self.ttl, self.capacity = ttl_ms, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "created_ms long, session_id long")

    def _timer(self, rows: list[tuple[int, int]], now: int) -> None:
        if rows:
            self.handle.registerTimer(max(rows[0][0] + self.ttl + 1, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["created_ms"].tolist(), pdf["session_id"].tolist(), strict=True)]
        held = sorted([*map(tuple, self.open.get()), *new])
        self.open.put(held)
        self._timer(held, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = sorted(map(tuple, self.open.get())), timerValues.getCurrentWatermarkInMs()
        n = sum(created + self.ttl < now for created, _ in held)  # the first n are over
        out = []
        for i, (created, session) in enumerate(held[:n]):
            pushed = held[i + self.capacity][0] if i + self.capacity < len(held) else None
            full = pushed is not None and pushed <= created + self.ttl
            out.append((key[0], session, created, pushed if full else created + self.ttl, "capacity" if full else "time"))
        self.open.put(held[n:]) if n < len(held) else self.open.clear()
        self._timer(held[n:], now)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SESSION_ENDS.split(", ")])

    def close(self) -> None:
        pass


def session_ends(puts: DataFrame, ttl_seconds: int, capacity: int, late: str) -> DataFrame:
    """A stream of (owner, session_id, created) to the ends of its sessions; rows later than ``late`` are dropped. The session's state store has to be RocksDB's (``rocks``)."""
    timed = puts.where("created IS NOT NULL AND owner IS NOT NULL").withWatermark("created", late)
    rows = timed.select("owner", "session_id", "created", F.unix_millis("created").alias("created_ms"))
    return rows.groupBy("owner").transformWithStateInPandas(Sessions(ttl_seconds * 1000, capacity), SESSION_ENDS, outputMode="append", timeMode="eventtime")


class rocks:
    """Within it, streams keep their state in RocksDB; the session's setting is restored after."""

    def __init__(self, spark: SparkSession):
        self.conf, self.key = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.conf.get(self.key)
        self.conf.set(self.key, ROCKS)

    def __exit__(self, *error) -> None:
        self.conf.set(self.key, self.before)


def to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Append what a stream has to say until its sources are used up, and read it back."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


ACTIVITY = "source string, line_no long, line string"


def follow_logs(lines: DataFrame, pattern: str, table: KeyedTable, checkpoint: str) -> None:
    """Keep the last line of every source that matches: state holds one line each, and a batch writes the sources that have a new one.

    ``lines``: a stream of (source, line_no, line)."""
    hit = lines.where(F.col("line").rlike(pattern))
    last = hit.groupBy("source").agg(F.max("line_no").alias("line_no"), F.max_by("line", "line_no").alias("line"))
    query = last.writeStream.outputMode("update").foreachBatch(lambda rows, number: table.upsert(rows, number, "line_no"))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
