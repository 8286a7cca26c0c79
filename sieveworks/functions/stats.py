"""Rates, intervals, agreement, gates: plain column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of a 95 % interval; grid and cap of positives_needed.
Z95 = 1.96
NEED_CAP = 200_000


def rate(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the class is empty."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi), clamped to [0, 1]; (0, 0) for n = 0."""
    n_, p = n.cast("double"), k.cast("double") / n
    middle, spread = p + z * z / (2 * n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    scale = 1 + z * z / n_
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / scale))).otherwise(F.lit(0.0))
    return F.struct(bound(middle - spread).alias("lo"), bound(middle + spread).alias("hi"))


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes/no raters; 0 without rows, 1 where chance agreement is complete."""
    n = (both + only_a + only_b + neither).cast("double")
    observed = (both + neither) / n
    chance = ((both + only_a) * (both + only_b) + (neither + only_a) * (neither + only_b)) / (n * n)
    return F.when(n == 0, 0.0).when(chance == 1, 1.0).otherwise((observed - chance) / (1 - chance))


def youden(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """|TPR - FPR|: an inverted feature counts as well."""
    return F.abs(rate(tp, tp + fn) - rate(fp, fp + tn))


def miss_rate_upper(tp: Column, positives: Column) -> Column:
    return F.when(positives > 0, 1 - wilson(tp, positives)["lo"]).otherwise(F.lit(1.0))


def need_grid() -> list[int]:
    """1, 2, 4 ... 64, then each the integer above 1.3 times the last, up to the cap."""
    grid, n = [], 1
    while n <= NEED_CAP:
        grid.append(n)
        n = n * 2 if n < 64 else int(n * 1.3) + 1
    return grid


def positives_needed(miss: Column, gate: Column) -> Column:
    """The first grid size at which the upper miss bound at this miss rate meets the gate; null if none does."""
    grid = F.array(*[F.lit(n) for n in need_grid()])
    meets = lambda n: 1 - wilson(F.bround(n * (1 - miss)), n)["lo"] <= gate
    return F.try_element_at(F.filter(grid, meets), F.lit(1))


def half_even(x: Column) -> Column:
    """Round to an integer, ties to even."""
    return F.bround(x).cast("long")


def gate(name: str, value: Column, limit: float, at_most: bool = True) -> Column:
    """struct(gate, value, limit, passed); a null value fails."""
    ok = value <= limit if at_most else value >= limit
    return F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), F.coalesce(ok, F.lit(False)).alias("passed"))
