"""Keyed tables, trees of hashes, files of marked blocks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import merkle as M
from sieveworks.sources import kpi_file as K
from sieveworks.sources import upsert as U

SCHEMA = "k string, seq int, v string"


def test_batches_in_order_give_the_last_rows(spark, tmp_path):
    rng, root, want = random.Random(3), str(tmp_path / "t"), {}
    for batch in range(4):
        rows = [(rng.choice([None, *[f"k{i}" for i in range(60)]]), i, f"{batch}-{i}") for i in range(rng.choice([3, 80]))]
        written = U.upsert(spark.createDataFrame(rows, SCHEMA), root, ["k"], [F.col("seq")], buckets=16)
        want |= {k: (k, s, v) for k, s, v in rows}
        assert len(written) <= len({k for k, *_ in rows})
        assert sorted(map(tuple, U.read_table(spark, root).select("k", "seq", "v").collect()), key=str) == sorted(want.values(), key=str)
    assert U.upsert(spark.createDataFrame([], SCHEMA), root, ["k"]) == [] and U.manifest(spark, root)[0][3] == 4


def test_only_touched_buckets_are_written_and_lost_jobs_change_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    U.upsert(spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("seq"), F.lit("a").alias("v")), root, ["k"], buckets=16)
    before = {b: f for b, f, *_ in U.manifest(spark, root)}
    touched = U.upsert(spark.createDataFrame([("7", 1, "new"), ("9", 1, "new")], SCHEMA), root, ["k"])
    after = {b: f for b, f, *_ in U.manifest(spark, root)}
    assert len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    lost = spark.createDataFrame([("11", 1, "lost")], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        U.upsert(lost, root, ["k"])
    assert {b: f for b, f, *_ in U.manifest(spark, root)} == after
    assert U.read_table(spark, root).where("v = 'new'").count() == 2 and U.read_table(spark, root).count() == 500


def test_roots_do_not_depend_on_order_or_partitions(spark):
    rows = [(i % 300, None if i % 7 == 0 else f"v{i % 50}", i % 3) for i in range(1000)] + [(None, "x", 1)] * 3
    one = spark.createDataFrame(rows, "k int, v string, w int").repartition(7)
    other = spark.createDataFrame(rows[::-1], "k int, v string, w int").repartition(2)
    root = lambda df: tuple(M.root(M.tree(df, "k", ["k", "v", "w"], 2)).first())
    assert root(one) == root(other) and root(one)[1] == 1003
    assert root(one) != root(one.where("k != 5 OR k IS NULL")) and root(one) != root(one.unionByName(one.limit(1)))
    assert root(one.select("k", F.lit("").alias("v"), "w")) != root(one.select("k", F.lit(None).cast("string").alias("v"), "w"))
    assert root(one.where("false")) == root(other.where("false")) and root(one.where("false"))[1] == 0


def test_descent_finds_planted_changes_and_reads_little(spark):
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    other = one.where("k != 77").withColumn("v", F.when(F.col("k") == 1234, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(9999, 1)], "k long, v long"))
    got = {(r["k"], r["status"]) for r in M.differing_keys(one, other, "k", ["k", "v"], 3).collect()}
    assert got == {(77, "removed"), (1234, "changed"), (9999, "added")}
    leaves, compared = M.differing_leaves(M.tree(one, "k", ["k", "v"], 3), M.tree(other, "k", ["k", "v"], 3), 3)
    assert leaves.count() <= 3 and compared[0] == 1 and all(n <= 48 for n in compared)
    same, compared = M.differing_leaves(M.tree(one, "k", ["k", "v"], 3), M.tree(one.repartition(3), "k", ["k", "v"], 3), 3)
    assert same.count() == 0 and compared == [1, 0, 0, 0]


TEXT = """# head: kept
metrics:
  - id: one
    # a comment: stays
    actual: null
    ci95: [0, 1]   # old
    nested:
      actual: 5

  - id: two
    actual: 7
    note: "actual: null"
other:
  actual: 1
"""


def write(spark, path, rows):
    spark.dataSource.register(K.KpiFile)
    spark.createDataFrame(rows, K.SCHEMA).repartition(2).write.format("kpi_file").mode("append").save(path)


def test_blocks_are_patched_and_siblings_stay(spark, tmp_path):
    path = str(tmp_path / "kpi.yaml")
    with open(path, "w") as f:
        f.write(TEXT)
    write(spark, path, [])
    assert open(path).read() == TEXT  # nothing to write
    rows = [("one", "actual", "0.97"), ("one", "ci95", "[0.9, 1.0]"), ("one", "absent", "1"), ("none", "actual", "1"), (None, "last_run", "r1"), (None, "mean", None)]
    write(spark, path, rows)
    want = TEXT.replace("    actual: null\n    ci95: [0, 1]   # old", "    actual: 0.97\n    ci95: [0.9, 1.0]") + "\n# --- filled in ---\nlast_run: r1\nmean: null\n"
    assert open(path).read() == want
    write(spark, path, rows)
    assert open(path).read() == want
    write(spark, path, [(None, "last_run", "r2")])
    assert open(path).read() == want.replace("last_run: r1\nmean: null\n", "last_run: r2\n")
    got = {tuple(r) for r in spark.read.format("kpi_file").load(path).collect()}
    assert {("one", "actual", "0.97"), ("two", "actual", "7"), (None, "last_run", "r2")} <= got and ("other", "actual", "1") not in got
    assert os.listdir(tmp_path) == ["kpi.yaml"]


def test_failed_tasks_and_double_values_leave_the_file(spark, tmp_path):
    path = str(tmp_path / "kpi.yaml")
    with open(path, "w") as f:
        f.write(TEXT)
    spark.dataSource.register(K.KpiFile)
    bad = spark.range(4).select(F.lit("one").alias("block"), F.lit("actual").alias("field"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise("1").alias("value"))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4).write.format("kpi_file").mode("append").save(path)
    with pytest.raises(Exception, match="two values"):
        write(spark, path, [("one", "actual", "1"), ("one", "actual", "2")])
    assert open(path).read() == TEXT
