"""Splits, quotas, top-n, oversampling and caps. All orders are hashes of seeded strings, so no run depends on chance.

Ranking is row_number over a stratum, which Catalyst turns into a per-task group limit before the shuffle where the rank is
bounded; so a stratum that holds most rows sends n rows a task, not all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hex_to_long, seeded, split_pool
from ..functions.stats import half_even
from .ranges import running_totals, with_rank


def split_records(records: DataFrame, key: str, seed: str, shares: Sequence[tuple[str, int]]) -> DataFrame:
    """(key, pool, seed)."""
    return records.select(F.col(key), split_pool(seed, F.col(key), shares).alias("pool"), F.lit(seed).alias("seed"))


def top_n_per_stratum(rows: DataFrame, stratum: str, key: str, n: int | Column, seed: str, first: Column | None = None, rank: str = "rank") -> DataFrame:
    """At most n rows of each stratum: those where `first` holds come first, then by sha256(seed:stratum:key), then key."""
    order = ([F.when(first, 0).otherwise(1)] if first is not None else []) + [seeded(seed, F.col(stratum).cast("string"), F.col(key).cast("string")), F.col(key)]
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col(rank) <= n)


def quota_sample(rows: DataFrame, bucket: str, key: str, total: int, shares: dict[str, float], seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """round(total * share) rows of each bucket, ties to even. A larger total contains a smaller one."""
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    spark = rows.sparkSession
    quota = spark.createDataFrame(sorted(shares.items()), f"{bucket} string, share double").select(bucket, half_even(F.col("share") * total).alias("quota"))
    ranked = top_n_per_stratum(rows.where(F.col(bucket).isin(*shares)), bucket, key, max(round(total * s) for s in shares.values()), seed)
    return ranked.join(F.broadcast(quota), bucket).where("rank <= quota").drop("quota")  # a row for each share that the caller wrote


def stratified_sample(rows: DataFrame, label: str, key: Column, n: int, seed: str) -> DataFrame:
    """At most n rows of each class."""
    order = seeded(seed, key)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("rank") <= n)


def dense_ids(rows: DataFrame, order: Sequence[Column], prefix: str, n: int | None = None, start: int = 0) -> DataFrame:
    """The first n rows in that order (all without n), with ids prefix-000 and on."""
    if n is not None:
        rows = rows.orderBy(*order).limit(n)
    ranked = with_rank(rows, order, "__rank")
    return ranked.withColumn("id", F.format_string(f"{prefix}-%03d", F.col("__rank") + start)).drop("__rank")


def next_start(ids: DataFrame, id_col: str) -> int:
    """One more than the largest numeric suffix; 0 without rows."""
    top = ids.agg(F.max(F.substring_index(F.col(id_col), "-", -1).try_cast("int"))).first()[0]
    return 0 if top is None else top + 1


def allocate(freq: DataFrame, stratum: str, weight: str, total: int, floor: int, order: str | None = None) -> DataFrame:
    """Largest remainder over strata: a floor for each, the rest by share, leftovers by descending fraction, again and again.

    freq has one row for each stratum. Zero weight in all counts as weight one in the denominator. Ties keep `order`.
    """
    tie = F.col(order or stratum)
    everything = Window.partitionBy()
    n, rest = F.count("*").over(everything), F.lit(total) - F.lit(floor) * F.count("*").over(everything)
    whole = F.greatest(F.sum(F.coalesce(F.col(weight), F.lit(0))).over(everything), F.lit(1))
    exact = (F.coalesce(F.col(weight), F.lit(0)) * rest).cast("double") / whole
    out = freq.withColumns({"__n": n, "__exact": exact, "__base": F.floor(exact).cast("long")})
    out = out.withColumn("__left", F.lit(total) - F.lit(floor) * F.col("__n") - F.sum("__base").over(everything))
    out = out.withColumn("__rank", F.row_number().over(Window.orderBy((F.col("__exact") - F.col("__base")).desc(), tie)))
    extra = F.floor(F.col("__left") / F.col("__n")) + F.when(F.col("__rank") <= F.col("__left") % F.col("__n"), 1).otherwise(0)
    return out.withColumn("n", (F.lit(floor) + F.col("__base") + extra).cast("long")).drop("__n", "__exact", "__base", "__left", "__rank")


def greedy_exclusive(candidates: DataFrame, stratum: str, key: str, quota: dict[str, int], seed: str) -> DataFrame:
    """Strata by ascending pool size, each taking its top n of the keys that no earlier one took.

    One small job a stratum; what was taken is at most the sum of the quotas.
    """
    sizes = {r[stratum]: r["n"] for r in candidates.groupBy(stratum).agg(F.countDistinct(key).alias("n")).collect()}
    order = {s: i for i, s in enumerate(quota)}
    taken: list = []
    out = None
    key_type = candidates.schema[key].dataType.simpleString()
    for s in sorted((s for s in quota if s in sizes), key=lambda s: (sizes[s], order[s])):
        left = candidates.where(F.col(stratum) == s)
        if taken:
            used = candidates.sparkSession.createDataFrame([(t,) for t in taken], f"{key} {key_type}")
            left = left.join(used, key, "left_anti")
        picked = top_n_per_stratum(left, stratum, key, quota[s], seed)
        taken += [r[key] for r in picked.select(key).collect()]
        out = picked if out is None else out.unionByName(picked)
    return out if out is not None else top_n_per_stratum(candidates.limit(0), stratum, key, 0, seed)


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in that order; apply it after all filters."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_wins(rows, keys, [c.desc() for c in order])


def _edge(rows: DataFrame, order: Column, bucket: Column, k: int):
    """(the k-th order struct, how many rows come before all of its equals); None for k < 1.

    Rows are counted by 65,536 buckets of a hash that the order starts with, so one small job finds the bucket of the border, and only that
    bucket, a 65,536th of the rows, is sorted.
    """
    if k < 1:
        return None
    before = 0
    for r in sorted(rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["b"]):
        if before + r["n"] >= k:
            inside = rows.where(bucket == r["b"]).select(order.alias("o"))
            edge = inside.orderBy("o").limit(k - before).agg(F.max("o").alias("o"))
            less = inside.join(F.broadcast(edge.withColumnRenamed("o", "e")), F.col("o") < F.col("e")).count()  # one row
            return edge, before + less
        before += r["n"]
    return None


def _first(rows: DataFrame, order: Column, bucket: Column, k: int, name: str) -> DataFrame:
    """rows with a boolean column: whether a row is among the first k by an order that starts with a hash; of equals any."""
    found = _edge(rows, order, bucket, k)
    if found is None:
        return rows.withColumn(name, F.lit(k >= 1))
    edge, before = found
    marked = rows.withColumn("__o", order).join(F.broadcast(edge.withColumnRenamed("o", "__e")))  # one row
    other = marked.where("__o != __e").withColumn(name, F.col("__o") < F.col("__e"))
    equal = marked.where("__o = __e").withColumn(name, F.row_number().over(Window.partitionBy("__o").orderBy(F.lit(0))) <= k - before)
    return other.unionByName(equal).drop("__o", "__e")


def _bucket(order: Column) -> Column:
    """The first four hex digits of a hash."""
    return hex_to_long(F.substring(order, 1, 4))


def holdout_split(rows: DataFrame, label: str, text: str, share: float, fail_share: float, seed: str = "holdout", head: int = 64) -> DataFrame:
    """Adds pool: a share of rows, of which fail_share positives (as far as they go), by the hash of the text's head."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("f")).first()
    size = round(counts["n"] * share)
    fails = min(counts["f"], round(size * fail_share))
    order = seeded(seed, F.substring(F.col(text), 1, head))
    by = F.struct(order.alias("h"), F.col(text).alias("t"))
    parts = [_first(rows.where(F.col(label) if value else ~F.col(label)), by, _bucket(order), k, "__in") for value, k in ((True, fails), (False, size - fails))]
    return parts[0].unionByName(parts[1]).withColumn("pool", F.when(F.col("__in"), "holdout").otherwise("train")).drop("__in")


def train_val_split(rows: DataFrame, key: str, share: float = 0.05, seed: str = "rx") -> DataFrame:
    """The first max(1, int(n * share)) rows by sha256(seed:key), then key, are val.

    The border is found by the hash itself, so the corpus is not sorted in one place.
    """
    order = seeded(seed, F.col(key).cast("string"))
    marked = _first(rows, F.struct(order.alias("h"), F.col(key).alias("k")), _bucket(order), max(1, int(rows.count() * share)), "__in")
    return marked.withColumn("pool", F.when(F.col("__in"), "val").otherwise("train")).drop("__in")


def oversample(rows: DataFrame, positive: Column, factor: int) -> DataFrame:
    """Positives factor times over; 1 changes nothing, less is an error."""
    if factor < 1:
        raise ValueError("the factor is below 1")
    if factor == 1:
        return rows
    copies = F.sequence(F.lit(1), F.when(F.coalesce(positive, F.lit(False)), factor).otherwise(1))
    return rows.withColumn("__copy", F.explode(copies)).drop("__copy")


def cap_source_share(rows: DataFrame, source: str, key: str, share: float) -> DataFrame:
    """Keeps, again and again, the first int(total * share) rows of each source until no source has more.

    The fixpoint needs the sizes of the sources alone, so it runs over the counts (a row a source), and the rows
    are ranked once. A cap of 0 empties the pool.
    """
    sizes = [r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).collect()]
    while True:
        cap = int(sum(sizes) * share)
        if all(n <= cap for n in sizes):
            break
        sizes = [min(n, cap) for n in sizes]
    # every source at the cap that came out, or below it
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(key))).where(F.col("__r") <= max(sizes, default=0)).drop("__r")


def kind_quota(rows: DataFrame, kind: str, quota: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first rows of each kind up to its quota (kind, n); kinds that run short stay short."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
    return ranked.join(quota, kind).where("rank <= n").drop("n")


def replace_slots(slots: DataFrame, spares: DataFrame, stratum: str, order: Sequence[Column]) -> DataFrame:
    """The k-th bad slot of a stratum takes its k-th spare; a spare key serves once in all strata.

    slots: (stratum, slot); spares: (stratum, key).
    """
    unique = first_wins(spares, ["key"], [F.col(stratum)])
    w = Window.partitionBy(stratum)
    return slots.withColumn("k", F.row_number().over(w.orderBy("slot"))).join(unique.withColumn("k", F.row_number().over(w.orderBy(*order))), [stratum, "k"], "left").drop("k")


def budget_cutoff(rows: DataFrame, cost: Column, order: Sequence[Column], limit: float, by: Sequence[str] = ()) -> DataFrame:
    """Adds spent_before and submitted: a row goes out while what was spent before it is within the limit; later ones never do.

    Costs are not negative, so the sum only grows. Give `by` to keep a budget for each key; one budget for all, or for a key of most rows, is summed over ranges
    of the order, so no task holds more than a range.
    """
    spent = running_totals(rows, order, {"spent_before": F.coalesce(cost.cast("double"), F.lit(0.0))}, by)
    return spent.withColumn("submitted", F.col("spent_before") <= limit)


def shards(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Adds shard and position; `size` consecutive rows to each shard, order kept. Ranks come from counts of ranges, not from one sort."""
    at = with_rank(rows, order, "__at")
    return at.withColumns({"shard": F.floor(F.col("__at") / size).cast("long"), "position": (F.col("__at") % size).cast("long")}).drop("__at")


#: The published constants of the 32-bit Mersenne twister.
STATE, SHIFT, MATRIX, UPPER_BIT, LOWER_BITS = 624, 397, 0x9908B0DF, 0x80000000, 0x7FFFFFFF
SEED_STEP, SEED_BASE, KEY_ONE, KEY_TWO = 1812433253, 19650218, 1664525, 1566083941


class Twister:
    """The 32-bit Mersenne twister, seeded by an integer's 32-bit words as its authors' array seeding does."""

    def __init__(self, seed: int) -> None:
        number, key = abs(seed), []
        while number or not key:
            key.append(number & 0xFFFFFFFF)
            number >>= 32
        s = [SEED_BASE]
        for i in range(1, STATE):
            s.append((SEED_STEP * (s[-1] ^ s[-1] >> 30) + i) & 0xFFFFFFFF)
        at = 1
        for k in range(max(STATE, len(key))):
            word = k % len(key)
            s[at] = ((s[at] ^ (s[at - 1] ^ s[at - 1] >> 30) * KEY_ONE) + key[word] + word) & 0xFFFFFFFF
            at += 1
            if at == STATE:
                s[0], at = s[-1], 1
        for _ in range(STATE - 1):
            s[at] = ((s[at] ^ (s[at - 1] ^ s[at - 1] >> 30) * KEY_TWO) - at) & 0xFFFFFFFF
            at += 1
            if at == STATE:
                s[0], at = s[-1], 1
        s[0] = UPPER_BIT
        self.state, self.at = s, STATE

    def word(self) -> int:
        if self.at == STATE:
            s = self.state
            for i in range(STATE):
                y = (s[i] & UPPER_BIT) | (s[(i + 1) % STATE] & LOWER_BITS)
                s[i] = s[(i + SHIFT) % STATE] ^ y >> 1 ^ (MATRIX if y & 1 else 0)
            self.at = 0
        y = self.state[self.at]
        self.at += 1
        y ^= y >> 11
        y ^= y << 7 & 0x9D2C5680
        y ^= y << 15 & 0xEFC60000
        return y ^ y >> 18

    def bits(self, k: int) -> int:
        """k random bits, low words first, the last word's high bits."""
        out = 0
        for i in range(0, k, 32):
            out |= (self.word() >> max(0, 32 - (k - i))) << i
        return out

    def below(self, n: int) -> int:
        """A number under n: as many bits as n has, drawn again until they are below it."""
        k = n.bit_length()
        while (r := self.bits(k)) >= n:
            pass
        return r


def sample_places(population: int, n: int, seed: int) -> list[int]:
    """The n places, in the order drawn, of a sample without replacement of a population: what drawing from a list whose drawn place the last free entry fills gives.

    Only entries that were moved are held, so work and memory are those of n draws, whatever the population. Small samples of large populations draw again on a
    place that is taken instead; which of the two holds is part of the result: it depends on 21 plus the power of four above 3n.
    """
    if not 0 <= n <= population:
        raise ValueError(f"{n} of {population} rows")
    draw = Twister(seed).below
    least = 21 + (4 ** _ceil_log4(3 * n) if n > 5 else 0)
    if population > least:
        seen: dict[int, None] = {}
        while len(seen) < n:
            seen.setdefault(draw(population))
        return list(seen)
    moved, out = {}, []
    for i in range(n):
        free = population - i
        at = draw(free)
        out.append(moved.get(at, at))
        moved[at] = moved.get(free - 1, free - 1)
    return out


def _ceil_log4(x: int) -> int:
    return math.ceil(math.log(x, 4))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """rows with `draw` (from 0): the n rows that a seeded sample of the sorted keys takes, in the order drawn. Keys are distinct.

    The generator gives n numbers on the driver; ranks of the keys are exact and distributed, and the places drawn meet them by a join.
    """
    ranked = with_rank(rows, [F.col(key)], "__at")
    places = sample_places(rows.count(), n, seed)
    drawn = rows.sparkSession.createDataFrame(list(zip(places, range(n), strict=True)), "__at long, draw long")
    return ranked.join(drawn, "__at").drop("__at")
