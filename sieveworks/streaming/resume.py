"""Resumable work as streams: each run takes what is new, checkpoints where it is, and compacts at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resume(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, key: str = "id", per_run: int = 1000) -> StreamingQuery:
    """Runs `work` over new JSON files of a folder and appends its rows to a Parquet log; a second run only sees later files.

    Ids that the log has without an error are skipped, whichever file they come in again. Batches are written under their epoch, so a
    batch that runs again replaces what it left.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_run).json(source)

    def put(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            before = spark.read.parquet(log).where(F.col("epoch") != epoch)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            done = before.where(F.coalesce(F.col("error").cast("string"), F.lit("")) == "") if "error" in before.columns else before
            fresh = fresh.join(done.select(key), key, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(cases: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Cases without a complete row: output there, not truncated, no error."""
    ok = F.coalesce(F.col("output"), F.lit("")) != ""
    for flag in ("truncated", "error"):
        if flag in done.columns:
            is_flag = done.schema[flag].dataType.typeName() == "boolean"
            ok = ok & ~F.coalesce(F.col(flag) if is_flag else F.col(flag).cast("string") != "", F.lit(False))
    return cases.join(done.where(ok).select(key), key, "left_anti")


def compact(log: DataFrame, order: DataFrame, key: str = "id", position: str = "position", epoch: str = "epoch") -> DataFrame:
    """The last row of each key, in the order of the cases (key, position)."""
    from ..operators.sampling import last_wins

    return last_wins(log, [key], [F.col(epoch)]).join(order, key).orderBy(position)


def sticky_budget(events: DataFrame, key: str, cost: Column, limit: float) -> DataFrame:
    """(key, event, spent, submitted) of a stream with an event column: once a key's spending is over its limit, nothing of it goes out again.

    Micro-batches are spent in the order they come, and the rows of a key inside one in the order of their events. Arrow batches cut a key's rows anywhere, so
    a task holds one key's events and costs of one micro-batch; maxFilesPerTrigger and the like bound it.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("event").cast("string").alias("event"), cost.cast("double").alias("cost"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        come = pd.concat([b[["event", "cost"]] for b in batches], ignore_index=True).sort_values("event", kind="stable", ignore_index=True)
        after = np.cumsum(np.append(spent, come["cost"].fillna(0.0).to_numpy(float)))  # one addition after the other
        if (over := after > limit).any():
            after[over.argmax() :] = after[over.argmax()]
        yield pd.DataFrame({"key": k[0], "event": come["event"], "spent": after[:-1], "submitted": after[:-1] <= limit})
        state.update((float(after[-1]),))

    return rows.groupBy("key").applyInPandasWithState(step, "key string, event string, spent double, submitted boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums with a watermark; works on streams and on tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
