"""A keyed table that takes batches: buckets by the key's hash, and a manifest for each version.

A batch rewrites the buckets that its keys fall into and no others; the next version's manifest names the new folders for these and the old ones for the rest. The manifest is one
file, written when all data is there, so readers see one version, and a lost job leaves the version before as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import last_wins

MANIFEST = "bucket int, folder string, buckets int, version int"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> list[tuple[int, str, int, int]]:
    """(bucket, folder, buckets, version) of the last version, a row for each bucket that holds rows; empty where there is none."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    last = rows.agg(F.max("version")).first()[0]
    return [tuple(r) for r in rows.where(F.col("version") == last).collect()] if last is not None else []


def read_table(spark: SparkSession, root: str, schema: str | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of the last version, of all buckets or of some. An empty table needs a schema."""
    folders = [f for b, f, _, _ in manifest(spark, root) if only is None or b in only]
    if not folders:
        if schema is None:
            raise ValueError("there is no row; give a schema")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)


def upsert(batch: DataFrame, root: str, keys: Sequence[str], order: Sequence[Column] = (), buckets: int = 64) -> list[int]:
    """Puts a batch in; gives the buckets that were written. Of rows of one key the last in `order` wins, and each wins over the table's.

    The number of buckets is the first batch's. A batch without rows makes no version. Null keys are keys. Two writers that start from one version write one
    manifest path, and the later one fails.
    """
    spark = batch.sparkSession
    known = manifest(spark, root)
    buckets, version = (known[0][2], known[0][3] + 1) if known else (buckets, 1)
    rows = last_wins(batch, keys, order or [F.lit(0)]).withColumn("__bucket", bucket_of(keys, buckets))
    new = f"{root}/data/{version:09d}-{uuid.uuid4().hex}"
    rows.write.partitionBy("__bucket").parquet(f"{new}/batch")
    rows = spark.read.schema(rows.schema).parquet(f"{new}/batch")
    touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())  # as many as there are buckets, at most
    if not touched:
        return []
    folders = {b: f for b, f, _, _ in known}
    if any(b in folders for b in touched):
        old = read_table(spark, root, only=touched).withColumn("__bucket", bucket_of(keys, buckets))
        gone = rows.select("__bucket", *keys)
        same = old["__bucket"] == gone["__bucket"]
        for k in keys:
            same = same & old[k].eqNullSafe(gone[k])
        rows = old.join(gone, same, "left_anti").select(*rows.columns).unionByName(rows)
    rows.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{new}/table")
    folders |= {b: f"{new}/table/__bucket={b}" for b in touched}
    lines = spark.createDataFrame([(b, f, buckets, version) for b, f in sorted(folders.items())], MANIFEST)
    lines.coalesce(1).write.parquet(f"{root}/manifest/{version:09d}")
    return touched
