"""A budget for each key of a stream that is spent in the order of the events' times, not of their arrival.

Events wait in the key's state until the watermark has passed their time; one timer of the key then lets out all that are due, in order, so shuffled arrival inside the
watermark gives the rows of ordered arrival, and a key costs a few calls to the state store a micro-batch, however many events it has. A task holds the events of one key that wait. What is spent is state as well. A key that has no event for `idle` starts with a full budget again, by a timer too. State lives in the checkpoint: a stream that starts again
goes on where it was, and a file sink holds each row once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that timers and maps need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, event string, at timestamp, spent double, submitted boolean"


class OrderedBudget(StatefulProcessor):
    def __init__(self, limit: float, idle_ms: int | None) -> None:
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", T.StructType([T.StructField("spent", T.DoubleType()), T.StructField("last", T.LongType())]))
        kinds = {"ms": T.LongType(), "events": T.StringType(), "costs": T.DoubleType()}
        self.waiting = handle.getValueState("waiting", T.StructType([T.StructField(k, T.ArrayType(v)) for k, v in kinds.items()]))

    def come(self) -> list[tuple[int, str | None, float | None]]:
        """The key's events that wait: (ms, event, cost)."""
        return list(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else []

    def keep(self, events: list[tuple]) -> None:
        if events:
            self.waiting.update(tuple(map(list, zip(*events, strict=True))))
        else:
            self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.come()
        new = [(int(r["ms"]), r["event"], r["cost"]) for r in rows]
        if not new:
            return iter(())
        self.keep(before + new)
        first = min(e[0] for e in new)
        if not before or first < min(e[0] for e in before):
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(at + 1, timerValues.getCurrentWatermarkInMs())
        waiting = self.come()
        due = sorted((e for e in waiting if e[0] < passed), key=lambda e: (e[0], e[1] or ""))
        spent, last = tuple(self.spent.get()) if self.spent.exists() else (0.0, None)
        if not due:
            if self.idle_ms is not None and last is not None and last + self.idle_ms < at:
                self.spent.clear()
            return
        for ms, event, cost in due:
            if self.idle_ms is not None and last is not None and last + self.idle_ms < ms:
                spent = 0.0
            out, last = spent <= self.limit, ms
            yield Row(key=key[0], event=event, ms=ms, spent=spent, submitted=out)
            spent += (cost or 0.0) if out else 0.0
        rest = [e for e in waiting if e[0] >= passed]
        self.keep(rest)
        self.spent.update((spent, last))
        if rest:
            self.handle.registerTimer(min(e[0] for e in rest))
        if self.idle_ms is not None:
            self.handle.registerTimer(last + self.idle_ms + 1)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store of streams that start from now on."""
    spark.conf.set(*STORE)


def ordered_budget(events: DataFrame, key: str, event: str, at: str, cost: Column, limit: float, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """(key, event, at, spent, submitted) of a stream: spent is what the key's earlier events have cost, ties in time by the event's name.

    An event goes out while that is within the limit; what does not go out costs nothing. Null costs are 0. Events later than `late` behind the newest are left out, as Spark's
    watermarks do; events inside it wait. Events without a time have no order and are left out. An event more than idle_ms after the one before it finds nothing spent.
    """
    use_state_store(events.sparkSession)
    timed = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    rows = timed.select(F.col(key).cast("string").alias("key"), F.col(event).cast("string").alias("event"), at, F.unix_millis(at).alias("ms"), cost.cast("double").alias("cost"))
    out = rows.groupBy("key").transformWithState(OrderedBudget(limit, idle_ms), "key string, event string, ms long, spent double, submitted boolean", "Append", "EventTime")
    return out.select("key", "event", F.timestamp_millis("ms").alias("at"), "spent", "submitted")
