"""Sinks: JSON lines, fixed-size shards, word lists, the KPI table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import upsert_kpi
from ..operators.sampling import shards


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Lines with all fields, null ones too; non-ASCII characters as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """An array document for each partition, its rows in their order; they are written as they come, a line each."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = "["
        for batch in batches:
            if batch.num_rows:
                lines = pc.binary_join_element_wise(pa.array([head] + [","] * (batch.num_rows - 1)), batch.column(0), "")
                yield pa.RecordBatch.from_arrays([lines], ["value"])
                head = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if head == "," else "[]"])], ["value"])

    fields = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    rows.select(fields).mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def write_shards(rows: DataFrame, path: str, order: Sequence[Column], size: int = 14, output: str = "output") -> None:
    """Folders shard=k of `size` rows each, in order; rows without output are left out."""
    kept = rows.where(F.coalesce(F.col(output), F.lit("")) != "")
    placed = shards(kept, order, size)
    placed.repartition("shard").sortWithinPartitions("shard", "position").drop("position").write.mode("overwrite").partitionBy("shard").json(path)


def word_list_text(name: str, terms: DataFrame, header: Sequence[str], column: str = "term") -> str:
    """The text of a lexicon file: comments, the count, sorted terms. For lexicons, which are bounded."""
    words = sorted(r[0] for r in terms.select(column).distinct().collect())
    return "\n".join([f"# {name}", *[f"# {h}" for h in header], f"# {len(words)}", *words]) + "\n"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("metric_id string, field string, value double, version int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_kpi(spark: SparkSession, path: str) -> DataFrame:
    """The last version of the table; empty where there is none."""
    rows = _versions(spark, path)
    if rows is None:
        return spark.createDataFrame([], "metric_id string, field string, value double")
    last = rows.agg(F.max("version")).first()[0] or 0
    return rows.where(F.col("version") == last).drop("version")


def write_kpi(table: DataFrame, new: DataFrame, path: str) -> None:
    """Replaces by key; without new rows nothing is written.

    Each write is a version of its own in one file, so the table may be read from the same path, and a lost job leaves the version
    before it as it was.
    """
    if not new.isEmpty():
        rows = _versions(table.sparkSession, path)
        last = 0 if rows is None else rows.agg(F.max("version")).first()[0] or 0
        upsert_kpi(table, new).coalesce(1).write.parquet(f"{path}/version={last + 1}")
