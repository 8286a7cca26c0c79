import random

from pyspark.sql import functions as F

from sieveworks.operators import ranges as R


def test_running_totals_equal_one_pass(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]) if i % 3 else "hot", rng.randint(0, 40), rng.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, o int, v long").repartition(7)
    got = {r["id"]: (r["before"], r["n"]) for r in R.running_totals(df, [F.col("o"), F.col("id")], {"before": F.col("v"), "n": F.lit(1)}).collect()}
    spent, want = 0, {}
    for n, (i, _, _, v) in enumerate(sorted(rows, key=lambda r: (r[2], r[0]))):
        want[i], spent = (spent, n), spent + (v or 0)
    assert got == want
    got = {r["id"]: r["before"] for r in R.running_totals(df, [F.col("o").desc(), F.col("id")], {"before": F.col("v")}, by=["k"]).collect()}
    spent, want = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[i], spent[k] = spent.get(k, 0), spent.get(k, 0) + (v or 0)
    assert got == want


def test_ranks_of_equal_rows_are_dense_and_empty_tables_stay_empty(spark):
    df = spark.range(5000).select(F.lit("same").alias("x"), F.lit(None).cast("int").alias("rank"))
    got = R.with_rank(df.select("x"), [F.col("x")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(5000))
    assert R.with_rank(df.where("false").select("x"), [F.col("x")]).collect() == []

