"""One hash of a table, and where two tables differ, by a tree of hashes over ranges of key hashes.

A leaf is a prefix of hex digits of sha256(key). Its hash is over the number of its rows and the sums of their hashes' eight 32-bit words, which tasks add up in part, so neither the order nor
the partitions of rows matter, repeated rows count, and no leaf's rows meet in one place. A node's hash is over its at most 16 children's, and the root is the table's.
Two tables are compared from the root down, below nodes that differ only; rows are compared in the leaves that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved

WORDS = range(8)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def key_digest(key: Column) -> Column:
    """Of the key's text; a null key has one of its own."""
    return _sha(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")))


def row_digest(fields: Sequence[str]) -> Column:
    """Fields as text, each behind its length; null fields are told from empty ones."""
    parts = [F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("~")) for f in fields]
    return _sha(F.concat_ws(",", *parts))


def tree(df: DataFrame, key: str, fields: Sequence[str], depth: int = 3) -> DataFrame:
    """(level, prefix, n, hash), saved: leaves at level `depth` (16 ** depth of them at most), the root at level 0. An empty table has the root alone."""
    digest = row_digest(fields)
    rows = df.select(F.substring(key_digest(F.col(key)), 1, depth).alias("prefix"), digest.alias("h"))
    word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("prefix").agg(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in WORDS])
    level = sums.select("prefix", "n", _sha(F.concat_ws(":", "n", *[f"w{i}" for i in WORDS])).alias("hash"))
    levels = [saved(level.withColumn("level", F.lit(depth)), "leaves")]
    for d in range(depth - 1, -1, -1):
        below = levels[-1].select(F.substring("prefix", 1, d).alias("up"), "prefix", "n", "hash")
        up = below.groupBy("up").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "hash"))), lambda c: c["hash"]), "").alias("all"))
        if d == 0:
            up = up.unionByName(df.sparkSession.createDataFrame([("", 0, "")], "up string, n long, all string")).groupBy("up").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
        levels.append(saved(up.select(F.lit(d).alias("level"), F.col("up").alias("prefix"), "n", _sha(F.col("all")).alias("hash")), "nodes"))
    out = levels[0].select("level", "prefix", "n", "hash")
    for l in levels[1:]:  # noqa: E741
        out = out.unionByName(l)
    return out


def root(nodes: DataFrame) -> DataFrame:
    """(content_hash, n_rows) of a table's tree."""
    return nodes.where("level = 0").select(F.col("hash").alias("content_hash"), F.col("n").alias("n_rows"))


def differing_leaves(a: DataFrame, b: DataFrame, depth: int = 3) -> tuple[DataFrame, list[int]]:
    """(prefix) of the leaves whose hashes differ, and how many nodes were compared at each level on the way down."""
    side = lambda nodes, name, d: nodes.where(F.col("level") == d).select("prefix", F.col("hash").alias(name))
    at, compared = a.sparkSession.createDataFrame([("",)], "prefix string"), []
    for d in range(depth + 1):
        up = F.substring("prefix", 1, max(0, d - 1))
        within = lambda nodes, name, d=d, up=up, at=at: side(nodes, name, d).withColumn("__up", up).join(at.select(F.col("prefix").alias("__up")), "__up", "left_semi").drop("__up")
        both = saved(within(a, "one").join(within(b, "other"), "prefix", "full"), "compared")
        compared.append(both.count())
        at = both.where(~F.col("one").eqNullSafe(F.col("other"))).select("prefix")
    return at, compared


def differing_keys(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], depth: int = 3) -> DataFrame:
    """(key, status) of keys whose rows differ: changed, added (in b alone) or removed. Only rows of differing leaves are compared; the rows of a key are compared as a bag."""
    leaves, _ = differing_leaves(tree(a, key, fields, depth), tree(b, key, fields, depth), depth)
    word = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")

    def bags(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.col(key), F.substring(key_digest(F.col(key)), 1, depth).alias("prefix"), row_digest(fields).alias("h")).join(leaves, "prefix", "left_semi")
        return own.groupBy(key).agg(F.struct(F.count("*").alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in WORDS]).alias(name)).withColumnRenamed(key, f"__{name}")

    one, other = bags(a, "one"), bags(b, "other")
    both = one.join(other, F.col("__one").eqNullSafe(F.col("__other")), "full").where(~F.col("one").eqNullSafe(F.col("other")))
    status = F.when(F.col("one").isNull(), "added").when(F.col("other").isNull(), "removed").otherwise("changed")
    return both.select(F.when(F.col("one").isNull(), F.col("__other")).otherwise(F.col("__one")).alias(key), status.alias("status"))
