import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import hard_negatives as M

SCHEMA = "vec_id long, label int, embedding array<double>, at long, rank string"


def brute(rows, positives=5, negatives=10):
    whole = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (i, label, v) in enumerate(whole):
        if i is None or i % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, _, w in whole]
        order = sorted((b for b in range(len(whole)) if b != a), key=lambda b: (-score[b], late(whole[b][0])))
        for p in [b for b in order if whole[b][1] == label][:positives]:
            fits = [b for b in order if whole[b][1] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(i, whole[p][0], r + 1, whole[b][0], score[p], score[b]) for r, b in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def made(seed=2, n=260, dims=11):
    rng = random.Random(seed)
    vector = lambda m=dims: [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.4, 1.0, 3.7]) for _ in range(m)]  # noqa: E731  few values, so many ties
    rows = [(i * 10, rng.choice([0, 0, 0, 1, 2, 3]), vector()) for i in range(n)]
    rows += [(100, 0, rows[10][2]), (100, 0, rows[10][2]), (5, None, vector()), (6, 1, None), (200, 1, [1.0, None]), (300, 1, [float("nan")]), (400, 2, [float("inf"), 1.0]), (None, 1, vector()), (None, 0, vector()), (500, 3, []), (600, 2, vector(4)), (700, 1, vector(19)), (800, 77, vector())]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"rows": 16, "anchors": 4, "dims": 3}, {"rows": 1, "anchors": 1, "dims": 64}])
def test_rows_equal_brute_force(spark, sizes):
    rows = made() if sizes.get("rows") != 1 else made(n=30)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in M.mine(df, F.col("vec_id") % 100 == 0, **sizes).collect()]
    assert sorted(got, key=str) == brute(rows) and got


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(1 << 25), 1 << 25, (5, 40)), rng.integers(-(1 << 20), 1 << 20, (6, 37))
    assert M.product(x, y).tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in y.tolist()] for a in x.tolist()]
    with pytest.raises(ValueError):
        M.product(x << 10, y << 10)


def test_tables_without_anchors_or_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(1, 1, [1.0], 0, ""), (100, 1, [1.0], 0, ""), (3, 2, [0.5], 0, "")], SCHEMA)
    assert [tuple(r) for r in M.mine(one, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 3, 65536, 32768)]
    assert M.mine(one, F.lit(False)).collect() == []


def test_no_tile_has_more_than_its_block(spark):
    rows = spark.createDataFrame([(*r, 1, "x") for r in made()], SCHEMA).where("embedding IS NOT NULL AND label IS NOT NULL").selectExpr("monotonically_increasing_id() AS rank", "0L AS at", "vec_id AS id", "CAST(label AS long) AS label", "array(1D, 2D, 3D) AS vector")
    found = M.blocks(M.with_rank(rows.drop("rank"), [F.col("label")], "rank"), 16, 2, 256).collect()
    assert {r["chunk"] for r in found} == {0, 1} and max(r["n"] for r in found) == 16 and {len(r["matrix"]) for r in found} <= {r["n"] * w * 2 for r in found for w in (1, 2)}
