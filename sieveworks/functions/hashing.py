"""Deterministic hashing: split buckets, order keys, moduli of whole digests, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by colons; a str is a literal."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def hex_to_long(digits: Column) -> Column:
    """At most 15 hex digits as a bigint."""
    return F.conv(digits, 16, 10).cast("long")


def bucket(seed: str, key: Column, modulus: int = 100) -> Column:
    """The first 8 hex digits of sha256(seed:key), modulo."""
    return hex_to_long(F.substring(seeded(seed, key.cast("string")), 1, 8)) % modulus


def split_pool(seed: str, key: Column, shares: Sequence[tuple[str, int]]) -> Column:
    """Pool by cumulative percentages of the bucket; shares must sum to 100."""
    if sum(n for _, n in shares) != 100:
        raise ValueError("shares do not sum to 100")
    at, b, out, edges = 0, bucket(seed, key), None, []
    for name, share in shares:
        at += share
        edges.append((name, at))
    for name, edge in edges[:-1]:
        out = F.when(b < edge, name) if out is None else out.when(b < edge, name)
    return F.lit(edges[-1][0]) if out is None else out.otherwise(edges[-1][0])


def digest_mod(hexadecimal: Column, k: int) -> Column:
    """A whole hex digest modulo a small k, digit by digit."""
    digits = F.filter(F.split(hexadecimal, ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % k)


def low_bit(hexadecimal: Column) -> Column:
    return hex_to_long(F.right(hexadecimal, F.lit(1))) % 2


def content_hash(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One hash of all rows that their order does not change: row hashes by key, then a hash over them.

    The row hashes meet in one row; at 64 hex digits a row this is for frozen sets, not for corpora. For those use
    table_digest.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]).cast("binary"), 256)
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("h"))))
    return df.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), "").cast("binary"), 256).alias("content_hash"), F.count("*").alias("n_rows"))


def dataset_hash(df: DataFrame, key: str, json: str) -> DataFrame:
    """One hash of canonical JSON texts, joined in the order of their keys: for frozen sets, as content_hash is."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(json).alias("j"))))
    return df.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["j"]), "").cast("binary"), 256).alias("content_hash"), F.count("*").alias("n_rows"))


def table_digest(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Order-free digest of any size of table: count, sum and xor of row hashes, with partial sums in each task."""
    h = F.xxhash64(*fields)
    return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))
