"""Set operations over vocabularies and ids, and the parsers that make vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions.text import clean_terms

HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same distinct rows."""
    return a.subtract(b).unionAll(b.subtract(a)).isEmpty()


def demand_same(a: DataFrame, b: DataFrame, what: str) -> None:
    if not same_set(a, b):
        raise DataContractError(f"{what} differ")


def overlap_counts(splits: DataFrame, key: str, pools: Sequence[str]) -> DataFrame:
    """(a, b, n) for each pair of pools: how many keys both have; one pass over the keys."""
    held = splits.groupBy(key).agg(F.collect_set("pool").alias("p")).where(F.size("p") > 1)  # at most one of each pool
    pairs = splits.sparkSession.createDataFrame([(a, b) for i, a in enumerate(pools) for b in pools[i + 1 :]], "a string, b string")
    of = held.select(key, F.explode("p").alias("a"), F.col("p")).select(key, "a", F.explode("p").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(of, ["a", "b"], "left").na.fill(0, ["n"])


def union_rows(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns that a part lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def lexicon_union(terms: DataFrame, others: DataFrame, least: int = 3, column: str = "term") -> DataFrame:
    """Distinct terms of at least so many characters, and all of the others."""
    return terms.where(F.length(column) >= least).select(column).union(others.select(column)).distinct()


def han_chars(tokens: DataFrame, column: str = "value") -> DataFrame:
    """Distinct Han characters of all tokens."""
    return tokens.select(F.explode(F.regexp_extract_all(column, F.lit(HAN), F.lit(0))).alias("char")).distinct()


def char_list(lines: DataFrame, value: str = "value", line: str = "line") -> DataFrame:
    """(char, position): Han characters of lines that are no comments, each at its first place."""
    kept = lines.where(~F.col(value).rlike(r"^\s*(#|$)")).select(line, F.posexplode(F.regexp_extract_all(value, F.lit(HAN), F.lit(0))).alias("at", "char"))
    return kept.groupBy("char").agg(F.min(F.struct(line, "at")).alias("position"))


def sectioned_vocabulary(lines: DataFrame, header: str, keep: Sequence[str], entry: str = r"^\s*\d+\s+(\S.*)$", separators: str = "[/、,，|]", value: str = "value", line: str = "line", by: str | None = None) -> DataFrame:
    """Words of the sections whose header is kept: the header above a line is the last one before it.

    With `by` (a file), lines of one file only are put in order together.
    """
    w = Window.partitionBy(*([by] if by else [])).orderBy(line)
    head = F.nullif(F.regexp_extract(value, header, 1), F.lit(""))
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(head.isNull() & F.col("section").isin(*keep))
    body = F.regexp_replace(F.regexp_extract(value, entry, 1), r"[（(][^）)]*[）)]", "")
    words = rows.select(F.explode(F.split(body, separators)).alias("word")).select(F.trim("word").alias("word"))
    return words.where(F.col("word").rlike(f"^{HAN}+$")).distinct()


def harvest_terms(rows: DataFrame, formal: Sequence[str], alias: Sequence[str], exclude: DataFrame, common_chars: DataFrame, most: int = 4) -> DataFrame:
    """Terms of formal and alias columns, without those that are colloquial (alias only, short, all characters common) or excluded."""
    def of(columns: Sequence[str], is_formal: bool) -> list[DataFrame]:
        return [rows.select(F.explode(clean_terms(F.coalesce(F.col(c), F.lit("")))).alias("term"), F.lit(is_formal).alias("formal")) for c in columns]

    found = union_rows(*of(formal, True), *of(alias, False)).groupBy("term").agg(F.bool_or("formal").alias("formal"))
    rare = found.select("term", F.explode(F.array_distinct(F.split("term", ""))).alias("char")).where("char != ''").join(common_chars, "char", "left_anti").select("term").distinct()
    with_rare = found.join(rare.withColumn("rare", F.lit(True)), "term", "left")
    colloquial = ~F.col("formal") & (F.length("term") <= most) & F.col("rare").isNull()
    return with_rare.where(~colloquial).select("term", "formal").join(exclude.select("term"), "term", "left_anti")
