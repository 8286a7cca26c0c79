import datetime as dt
import random

from pyspark.sql import functions as F

from sieveworks.streaming.budgets import ordered_budget

SCHEMA = "key string, event string, at timestamp, cost double"
START = dt.datetime(2024, 3, 1)


def run(spark, root, idle=None):
    """One run over what has come since the last, as a stream that starts again from its checkpoint."""
    stream = spark.readStream.schema(SCHEMA).json(f"{root}/in")
    out = ordered_budget(stream, "key", "event", "at", F.col("cost"), 20.0, "1 hour", idle)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start().awaitTermination()


def ordered(rows, idle=None):
    """(key, event, spent, submitted) of ordered arrival."""
    spent, last, out = {}, {}, []
    for key, event, at, cost in sorted(rows, key=lambda r: (r[2], r[1])):
        if idle is not None and key in last and (at - last[key]).total_seconds() * 1000 > idle:
            spent[key] = 0.0
        s = spent.get(key, 0.0)
        out.append((key, event, s, s <= 20.0))
        spent[key], last[key] = s + (cost or 0.0) * (s <= 20.0), at
    return sorted(out, key=str)


def test_shuffled_arrival_and_restarts_give_the_rows_of_ordered_arrival(spark, tmp_path):
    rng = random.Random(5)
    for idle in (None, 20 * 60_000):
        root = str(tmp_path / f"r{idle}")
        rows = [(rng.choice(["a", "b", None]), f"e{i:03d}", START + dt.timedelta(minutes=rng.choice([i, i, i + 30])), rng.choice([1.0, 4.0, None])) for i in range(120)]
        rng.shuffle(rows)
        slices = [[r for r in rows if r[2] < START + dt.timedelta(minutes=60)], [r for r in rows if r[2] >= START + dt.timedelta(minutes=60)]]
        for part in [*slices, [("tick", "", START + dt.timedelta(days=9), 0.0)]]:
            spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").json(f"{root}/in")
            run(spark, root, idle)
        run(spark, root, idle)  # nothing new: no row again
        got = [tuple(r) for r in spark.read.parquet(f"{root}/out").where("event != ''").select("key", "event", "spent", "submitted").collect()]
        assert sorted(got, key=str) == ordered(rows, idle)
