"""Ranks and running totals over all rows of a table, without a window that holds them all.

Two passes: rows are dealt out by ranges of their order and each range is summed on its own; the sums of the ranges before are added.
What meets in one task is a range's rows, or one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def running_totals(rows: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """rows with a column for each total: the sum of its value over the rows that come before in `order`, inside a key of `by`.

    Null values count as 0, and null is a key as any other. Ties take the order in which the rows are read, which only the input's files decide; ranges split among
    tied rows too, so equal rows never meet in one task. A key may hold all rows. No rows give none.
    """
    values = {f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(totals.values())}
    tagged = saved(rows.withColumns(values).withColumn("__row", F.monotonically_increasing_id()), "tagged")
    every = [*map(F.col, by), *order, F.col("__row")]
    ranged = tagged.repartitionByRange(*every).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy(*by, "__part").orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = saved(ranged.withColumns({f"__s{i}": F.sum(v).over(own) for i, v in enumerate(values)}), "ranges")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(*by, "__part").agg(*[F.sum(v).alias(v) for v in values])
    starts = sums.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__of"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__b{i}") for i, v in enumerate(values)])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col("__part") == F.col("__of"))
    out = local.join(starts, same).withColumns({name: F.col(f"__b{i}") + F.col(f"__s{i}") - F.col(f"__v{i}") for i, name in enumerate(totals)})
    return out.select(*rows.columns, *totals)


def with_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """rows with their place in `order`, from 0, inside a key of `by`."""
    return running_totals(rows, order, {name: F.lit(1).cast("long")}, by)
