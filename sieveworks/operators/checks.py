"""Validators as problem tables: (id, rule, detail), one row a problem, none when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError

PROBLEM = "struct<rule:string,detail:string>"


def problems(rows: DataFrame, key: str, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Every rule in one pass: a condition that is true is a problem; null counts as true."""
    bad = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(rule).alias("rule"), (F.lit("") if d is None else F.coalesce(d.cast("string"), F.lit(""))).alias("detail"))) for rule, (c, d) in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("id"), F.explode(bad).alias("p")).select("id", "p.rule", "p.detail")


def repeated(rows: DataFrame, column: str, rule: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(rule).alias("rule"), F.col("n").cast("string").alias("detail"))


def case_problems(cases: DataFrame, required: Sequence[str], parents: dict[str, str], difficulties: Sequence[str], modes: Sequence[str], per_scenario: dict[str, int] | None = None, targets: dict[str, float] | None = None, tolerance: float = 0.05) -> DataFrame:
    """Required fields, unique ids and records, parents, enums, two items or more, query length and place, counts, difficulty shares.

    record_id is read from provenance.
    """
    rules: dict[str, tuple[Column, Column | None]] = {}
    for f in required:
        kind = cases.schema[f].dataType.simpleString()
        empty = F.size(f) <= 0 if kind.startswith("array") else (F.trim(F.col(f)) == "" if kind == "string" else F.col(f).isNull())
        rules[f"required:{f}"] = (F.col(f).isNull() | F.coalesce(empty, F.lit(False)), None)
    pairs = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv]) if parents else F.create_map().cast("map<string,string>")
    rules |= {
        "parent": (~F.coalesce(F.try_element_at(pairs, F.col("scenario")) == F.col("parent_class"), F.lit(False)), F.col("scenario")),
        "difficulty": (~F.col("difficulty").isin(*difficulties), F.col("difficulty")),
        "failure mode": (~F.col("targets_failure_mode").isin(*modes), F.col("targets_failure_mode")),
        "key points": (F.size("key_points") < 2, F.size("key_points")),
        "negative rubric": (F.size("negative_rubric") < 2, F.size("negative_rubric")),
        "short query": (F.length("query") < 8, F.length("query")),
        "query in source": (F.col("source_text").contains(F.col("query")), None),
    }
    out = problems(cases, "id", rules).unionByName(repeated(cases, "id", "repeated id"))
    out = out.unionByName(repeated(cases.withColumn("r", F.col("provenance.record_id")), "r", "repeated record"))
    if per_scenario:
        want = cases.sparkSession.createDataFrame(sorted(per_scenario.items()), "scenario string, want long")
        have = cases.groupBy("scenario").agg(F.count("*").alias("have"))
        off = want.join(have, "scenario", "full").where(~F.col("want").eqNullSafe(F.col("have")))
        out = out.unionByName(off.select(F.col("scenario").alias("id"), F.lit("scenario count").alias("rule"), F.concat_ws("/", F.coalesce("have", F.lit(0)), "want").alias("detail")))
    if targets:
        want = cases.sparkSession.createDataFrame(sorted(targets.items()), "difficulty string, want double")
        have = cases.groupBy("difficulty").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
        off = want.join(have, "difficulty", "left").where(F.abs(F.coalesce("share", F.lit(0.0)) - F.col("want")) > tolerance)
        out = out.unionByName(off.select(F.col("difficulty").alias("id"), F.lit("difficulty share").alias("rule"), F.format_number(F.coalesce("share", F.lit(0.0)), 4).alias("detail")))
    return out


def flag_problems(cases: DataFrame, banned: Sequence[str], text: str = "query") -> DataFrame:
    """Banned words, and simulated rows without a note."""
    rules = {f"banned:{w}": (F.col(text).contains(w), None) for w in banned}
    if {"simulated", "simulated_note"} <= set(cases.columns):
        rules["simulated without note"] = (F.coalesce("simulated", F.lit(False)) & (F.coalesce("simulated_note", F.lit("")) == ""), None)
    return problems(cases, "id", rules)


def coverage_problems(cases: DataFrame, required: DataFrame, column: str) -> DataFrame:
    """Required values that no case has."""
    return required.join(cases.select(column).distinct(), column, "left_anti").select(F.col(column).alias("id"), F.lit("not covered").alias("rule"), F.lit("").alias("detail"))


def leakage_problems(used: DataFrame, splits: DataFrame, pool: str, key: str = "record_id") -> DataFrame:
    """Used ids of other pools, and used ids of no pool."""
    ids = used.select(key).distinct()
    other = ids.join(splits.where(F.col("pool") != pool), key).select(F.col(key).alias("id"), F.lit("in another pool").alias("rule"), F.col("pool").alias("detail"))
    none = ids.join(splits.select(key), key, "left_anti").select(F.col(key).alias("id"), F.lit("in no pool").alias("rule"), F.lit("").alias("detail"))
    return other.unionByName(none)


def split_problems(records: DataFrame, splits: DataFrame, pools: Sequence[str], key: str = "record_id") -> DataFrame:
    """Records without a pool, ids in several rows or pools, pools of no record, unknown pool names."""
    lone = lambda a, b, rule: a.select(key).join(b.select(key), key, "left_anti").select(F.col(key).cast("string").alias("id"), F.lit(rule).alias("rule"), F.lit("").alias("detail"))
    by = splits.groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("pool").alias("k"))
    twice = by.where("n > 1").select("id", F.when(F.col("k") > 1, "in two pools").otherwise("repeated id").alias("rule"), F.col("n").cast("string").alias("detail"))
    unknown = splits.where(~F.coalesce(F.col("pool").isin(*pools), F.lit(False))).select(F.col(key).cast("string").alias("id"), F.lit("unknown pool").alias("rule"), F.col("pool").alias("detail"))
    return lone(records, splits, "without pool").unionByName(lone(splits, records, "without record")).unionByName(twice).unionByName(unknown)


def label_problems(labels: DataFrame, cases: DataFrame) -> DataFrame:
    """Labels against their cases: known case, array sizes, positions, evidence in the texts, verdict.

    labels: (case_id, key_points, red_lines, verdict); cases: (case_id, source_text, answer, key_points, red_lines).
    """
    c = cases.select("case_id", F.col("source_text").alias("src"), F.col("answer").alias("ans"), F.size("key_points").alias("n_points"), F.size("red_lines").alias("n_lines"), F.lit(True).alias("known"))
    rows = labels.join(c, "case_id", "left")
    ungrounded = lambda array: F.exists(array, lambda x: (F.coalesce(x["evidence"], F.lit("")) != "") & ~F.coalesce(F.col("src").contains(x["evidence"]), F.lit(False)) & ~F.coalesce(F.col("ans").contains(x["evidence"]), F.lit(False)))
    off = lambda array: F.exists(F.transform(array, lambda x, i: F.coalesce(x["idx"] != i, F.lit(True))), lambda b: b)
    known = F.col("known").isNotNull()
    return problems(rows, "case_id", {
        "unknown case": (~known, None),
        "key point count": (known & (F.size("key_points") != F.col("n_points")), F.size("key_points")),
        "red line count": (known & (F.size("red_lines") != F.col("n_lines")), F.size("red_lines")),
        "key point order": (off("key_points"), None),
        "red line order": (off("red_lines"), None),
        "flag is missing": (F.exists("key_points", lambda x: x["covered"].isNull()) | F.exists("red_lines", lambda x: x["violated"].isNull()), None),
        "evidence is not in the texts": (known & (ungrounded("key_points") | ungrounded("red_lines")), None),
        "verdict": (~F.col("verdict").isin("pass", "fail"), F.col("verdict")),
    })


def fail_rates(labels: DataFrame, bucket_of: DataFrame, buckets: Sequence[str], enough: int = 20) -> DataFrame:
    """(position, bucket, n, fails, fail_rate, enough) in the given order; empty buckets show."""
    dim = labels.sparkSession.createDataFrame(list(enumerate(buckets)), "position int, bucket string")
    by = labels.join(bucket_of, "case_id").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "fail").alias("fails"))
    out = dim.join(by, "bucket", "left").na.fill(0, ["n", "fails"])
    return out.withColumns({"fail_rate": F.when(F.col("n") > 0, F.col("fails") / F.col("n")).otherwise(0.0), "enough": F.col("n") >= enough})


def demand_none(found: DataFrame, what: str) -> None:
    """Raises with examples if there is a problem."""
    if some := found.limit(5).collect():
        raise DataContractError(f"{what}: {[tuple(r) for r in some]}")


def audit_predictions(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse and structure of predictions: rows (raw, n_points, n_lines, source_text, answer) with parsed and ok columns.

    Wrong containers are a schema failure, never an error; only real booleans count; evidence must be in the texts.
    """
    from ..functions.text import json_object

    item = lambda flag: f"ARRAY<STRUCT<idx: INT, {flag}: BOOLEAN, evidence: STRING>>"
    parsed = json_object(F.col(raw), f"key_points {item('covered')}, red_lines {item('violated')}, verdict STRING")
    out = rows.withColumn("p", parsed)
    whole = lambda array, flag, n: F.coalesce((F.size(array) == F.col(n)) & F.forall(array, lambda x: x[flag].isNotNull()), F.lit(False))
    cited = F.concat(F.coalesce("p.key_points.evidence", F.array()), F.coalesce("p.red_lines.evidence", F.array()))
    cited = F.filter(cited, lambda e: F.coalesce(e, F.lit("")) != "")
    return out.withColumns({
        "parse_failed": F.col("p").isNull(),
        "schema_ok": F.col("p").isNotNull() & F.coalesce(F.col("p.verdict").isin("pass", "fail"), F.lit(False)) & whole("p.key_points", "covered", "n_points") & whole("p.red_lines", "violated", "n_lines"),
        "evidence": F.size(cited),
        "evidence_grounded": F.size(F.filter(cited, lambda e: F.col("source_text").contains(e) | F.col("answer").contains(e))),
    })


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("n"), F.count_if("parse_failed").alias("parse_failed"), F.count_if(~F.col("parse_failed") & ~F.col("schema_ok")).alias("schema_failed"), F.sum("evidence").alias("evidence"), F.sum("evidence_grounded").alias("evidence_grounded"))
