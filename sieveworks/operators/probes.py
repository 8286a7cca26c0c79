"""Shortcut probes: features of form alone that must not tell positives from negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions.stats import rate, youden
from ..functions.text import last_index
from .candidates import infer_kind, number_patterns, packed

STRUCTURAL = ("prefix_present", "inside_bracket", "in_tail", "ends_with_bracket")


def first_prefix(answer: Column, prefixes: Sequence[str]) -> Column:
    """Start (from 1) of the earliest prefix; 0 if there is none."""
    at = [F.nullif(F.instr(answer, p), F.lit(0)) for p in prefixes]
    return F.coalesce(at[0] if len(at) == 1 else F.least(*at), F.lit(0))


def with_probes(pool: DataFrame, prefixes: Sequence[str], suffix: str, close: str = "）", tail: float = 0.15, nfkc: bool = True) -> DataFrame:
    """pool (source_text, answer, candidate_text, kind or null, label) with a boolean column for each probe."""
    answer, cand = F.col("answer"), F.col("candidate_text")
    kind = F.coalesce(F.col("kind"), infer_kind(cand)) if "kind" in pool.columns else infer_kind(cand)
    rows = pool.withColumns({"__kind": kind, "__cut": first_prefix(answer, prefixes), "__src": packed(F.col("source_text"), nfkc), "__cand": packed(cand, nfkc)})
    after = F.expr("substring(answer, __cut)")
    inner = F.when(F.instr(after, close) > 0, F.substring_index(after, close, 1)).otherwise(after)
    supported = F.when(F.col("__kind") == "lexicon", F.col("__src").contains(F.col("__cand")))
    for k, pattern, _ in number_patterns():
        supported = supported.when(F.col("__kind") == k, F.array_contains(F.regexp_extract_all(F.col("__src"), F.lit(pattern), F.lit(0)), F.col("__cand")))
    at = last_index(answer, cand)
    out = rows.withColumns({
        "prefix_present": F.col("__cut") > 0,
        "inside_bracket": (F.col("__cut") > 0) & inner.contains(cand),
        "in_tail": (at >= 0) & (at >= (1 - tail) * F.length(answer)),
        "ends_with_bracket": F.regexp_replace(answer, r"(?U)\s+$", "").endswith(suffix),
        "not_grounded": ~F.coalesce(supported, F.lit(False)),
        "kind_is_lexicon": F.col("__kind") == "lexicon",
        "kind_is_digit": F.col("__kind") == "digit",
    })
    return out.withColumn("inside_and_not_grounded", F.col("inside_bracket") & F.col("not_grounded")).drop("__kind", "__cut", "__src", "__cand")


PROBES = ("prefix_present", "inside_bracket", "in_tail", "ends_with_bracket", "not_grounded", "inside_and_not_grounded", "kind_is_lexicon", "kind_is_digit")


def score_probes(rows: DataFrame, probes: Sequence[str] = PROBES, label: str = "label", structural: Sequence[str] = STRUCTURAL, limit: float = 0.3) -> DataFrame:
    """(probe, tp, fp, fn, tn, tpr, fpr, j, gated, failed), in one pass. An empty pool is an error."""
    if rows.isEmpty():
        raise DataContractError("the pool is empty")
    long = rows.select(label, *[F.col(p).cast("boolean") for p in probes]).unpivot([label], list(probes), "probe", "hit")
    y, x = F.col(label), F.coalesce(F.col("hit"), F.lit(False))
    counts = long.groupBy("probe").agg(F.count_if(y & x).alias("tp"), F.count_if(~y & x).alias("fp"), F.count_if(y & ~x).alias("fn"), F.count_if(~y & ~x).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"tpr": rate(tp, tp + fn), "fpr": rate(fp, fp + tn), "j": youden(tp, fp, fn, tn), "gated": F.col("probe").isin(*structural)})
    return out.withColumn("failed", F.col("gated") & (F.col("j") > limit))


def best_structural(scores: DataFrame) -> DataFrame:
    """The structural probe with the largest J; a model is compared with this one only."""
    return scores.where("gated").agg(F.max_by("probe", F.struct("j", "probe")).alias("probe"), F.max("j").alias("j"))


def kind_mismatches(pool: DataFrame) -> DataFrame:
    """Rows of the pool whose kind differs from the shape of their text; rows without a kind fit."""
    return pool.where(F.col("kind").isNotNull() & (F.col("kind") != infer_kind(F.col("candidate_text"))))


def check_kinds(pool: DataFrame) -> DataFrame:
    """The pool; raises if a kind differs from the shape of its text."""
    bad = kind_mismatches(pool).select("candidate_text", "kind")
    if found := bad.limit(5).collect():
        raise DataContractError(f"kinds that do not fit their texts: {[tuple(r) for r in found]}")
    return pool
