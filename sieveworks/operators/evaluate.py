"""Confusion slices, agreement, votes, rollups, gates and the KPI table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions import stats as S
from ..functions.hashing import low_bit, seeded


def confusion_counts(label: Column, flag: Column) -> list[Column]:
    f = F.coalesce(flag, F.lit(False))
    return [F.count_if(label & f).alias("tp"), F.count_if(~label & f).alias("fp"), F.count_if(label & ~f).alias("fn"), F.count_if(~label & ~f).alias("tn")]


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"n": tp + fp + fn + tn, "miss_rate": S.rate(fn, tp + fn), "false_alarm": S.rate(fp, fp + tn), "tpr": S.rate(tp, tp + fn), "fpr": S.rate(fp, fp + tn), "miss_rate_upper": S.miss_rate_upper(tp, tp + fn), "kappa": S.kappa(tp, fp, fn, tn), "agreement": S.rate(tp + tn, tp + fp + fn + tn)})


def confusion_slices(rows: DataFrame, label: Column, flag: Column, slices: dict[str, Column], always: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of each slice (a condition) in one pass; empty slices are left out, save those in `always`."""
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in slices.items()]), lambda x: x.isNotNull())
    counts = rows.select(F.explode(names).alias("slice"), label.alias("l"), flag.alias("f")).groupBy("slice").agg(*confusion_counts(F.col("l"), F.col("f")))
    if always:
        wanted = rows.sparkSession.createDataFrame([(n,) for n in always], "slice string")
        counts = wanted.join(counts, "slice", "full").na.fill(0, ["tp", "fp", "fn", "tn"])
    return with_rates(counts)


def mixed_groups(rows: DataFrame, group: str, label: Column, flag: Column) -> DataFrame:
    """Groups that hold both labels, and whether every row of theirs is right."""
    by = rows.groupBy(group).agg(F.count_distinct(label).alias("labels"), F.bool_and(label == F.coalesce(flag, F.lit(False))).alias("all_correct"), F.count("*").alias("rows"))
    return by.where("labels = 2").drop("labels")


def positional_quantile(rows: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """sorted[int(q * n)], not interpolated; nulls are left out.

    Equal values are counted first, in each task, so what is put in order is a row for each distinct value of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"__upto": F.sum("__k").over(w.orderBy(value)), "__n": F.sum("__k").over(w)})
    at = lambda q: F.least(F.floor(F.col("__n") * F.lit(q)), F.col("__n") - 1)
    return ranked.groupBy(*by).agg(F.max("__n").alias("n"), *[F.min(F.when(F.col("__upto") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def pass_rates(rows: DataFrame, by: Sequence[str], score: str, threshold: float = 0.90) -> DataFrame:
    """Passes, rows, share and its interval; a score at the threshold passes."""
    k, n = F.count_if(F.col(score) >= threshold), F.count(score)
    out = rows.groupBy(*by).agg(k.alias("passed"), n.alias("n"), F.avg(score).alias("mean"))
    return out.withColumns({"pass_rate": S.rate(F.col("passed"), F.col("n")), "ci": S.wilson(F.col("passed"), F.col("n"))})


def micro_macro(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of each group and, with a null group, over all rows: one pass with grouping sets."""
    return rows.rollup(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping(by).alias("is_total"))


def per_case(cases: DataFrame, outputs: DataFrame, judged: DataFrame, output_scores: Column, source_score: str = "src_readability") -> DataFrame:
    """One row a case with an output: scores, net gain, length ratio, headroom, and the judge's columns (null if not judged)."""
    done = cases.join(outputs.where(F.coalesce(F.col("output"), F.lit("")) != ""), "id")
    rows = done.withColumn("__s", output_scores)
    faith = judged.select("id", F.col("faithful_overall").alias("faithful"), (F.coalesce(F.size("violated_indices") > 0, F.lit(False)) | F.coalesce("fabrication_extra", F.lit(False))).alias("violated"), F.col("key_points_covered").alias("kp_covered"), F.col("key_points_total").alias("kp_total"))
    out = rows.select("id", "scenario", "difficulty", F.col("__s.strict").alias("strict"), F.col("__s.glossed").alias("glossed"), F.col("__s.lenient").alias("lenient"), F.col("__s.n_chars").alias("n_chars"), F.col("__s.n_scored").alias("n_scored"), F.col(source_score).alias("src_readability"), F.length("source_text").alias("__src"))
    out = out.withColumns({"net_gain": F.col("strict") - F.col("src_readability"), "len_ratio": F.col("n_chars") / F.col("__src"), "has_headroom": F.col("src_readability") < 0.90}).drop("__src")
    return out.join(faith, "id", "left")


def rollup_run(rows: DataFrame) -> DataFrame:
    """The headline of a run: overall, for each scenario, for the headroom and the hard subset."""
    parts = {"overall": F.lit(True), "headroom": F.col("has_headroom"), "hard": F.col("difficulty") == "难"}
    tagged = rows.withColumn("part", F.explode(F.filter(F.concat(F.array(*[F.when(c, F.lit(n)) for n, c in parts.items()]), F.array(F.concat(F.lit("scenario:"), F.col("scenario")))), lambda x: x.isNotNull())))
    judged = F.col("faithful").isNotNull()
    out = tagged.groupBy("part").agg(F.count("*").alias("n"), F.avg("strict").alias("strict_case_mean"), (F.sum(F.col("strict") * F.col("n_scored")) / F.sum("n_scored")).alias("strict_micro"), F.avg("net_gain").alias("net_gain"), F.count_if(F.col("strict") >= 0.90).alias("passed"), F.count_if(judged).alias("judged"), F.count_if(judged & F.col("faithful") & ~F.col("violated")).alias("guarded"), F.count_if(judged & F.col("violated")).alias("violations"), F.sum("kp_covered").alias("kp_covered"), F.sum("kp_total").alias("kp_total"))
    return out.withColumns({"pass_rate": S.rate(F.col("passed"), F.col("n")), "guard_rate": S.rate(F.col("guarded"), F.col("judged")), "coverage": S.rate(F.col("kp_covered"), F.col("kp_total"))})


def swapped(case_id: Column, judge: Column) -> Column:
    """Whether a pair is shown in reverse: the lowest bit of sha256(ab:id:judge)."""
    return low_bit(seeded("ab", case_id.cast("string"), judge.cast("string"))) == 1


def unswap(vote: Column, was_swapped: Column) -> Column:
    return F.when(was_swapped & vote.isin("A", "B"), F.translate(vote, "AB", "BA")).otherwise(vote)


def vote_tallies(votes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dim, A, B, tie); unknown votes are ties."""
    long = votes.unpivot([], list(dims), "dim", "vote").withColumn("vote", F.when(F.col("vote").isin("A", "B"), F.col("vote")).otherwise("tie"))
    return long.groupBy("dim").agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("A", "B", "tie")])


def case_majority(votes: DataFrame, key: str, dim: str) -> DataFrame:
    """A or B where one has more votes of the case's judges, else tie; counted."""
    a, b = F.count_if(F.col(dim) == "A"), F.count_if(F.col(dim) == "B")
    by = votes.groupBy(key).agg(F.when(a > b, "A").when(b > a, "B").otherwise("tie").alias("winner"))
    return by.groupBy("winner").agg(F.count("*").alias("cases"))


def cost(prompt: Column, completion: Column, per_prompt: float = 1.0, per_completion: float = 9.5) -> Column:
    """Null usage costs nothing."""
    return (F.coalesce(completion, F.lit(0)) * per_completion + F.coalesce(prompt, F.lit(0)) * per_prompt) / 1e6


def instance_level(cases: DataFrame, flags: DataFrame, key: str = "case_id", covered: Sequence[int] = (0, 2)) -> DataFrame:
    """Counts with "any candidate in the case" as prediction and each covered red line as gold. cases: (key, red_lines)."""
    gold = cases.select(key, F.explode("red_lines").alias("r")).where(F.col("r.idx").isin(*covered)).select(key, F.col("r.idx").alias("idx"), F.coalesce("r.violated", F.lit(False)).alias("gold"))
    rows = gold.join(flags.select(key, F.lit(True).alias("flag")).distinct(), key, "left")
    return with_rates(rows.agg(*confusion_counts(F.col("gold"), F.col("flag"))))


def missed_instances(cases: DataFrame, flags: DataFrame, key: str = "case_id", covered: Sequence[int] = (0, 2)) -> DataFrame:
    gold = cases.select(key, F.explode("red_lines").alias("r")).where(F.col("r.idx").isin(*covered) & F.coalesce("r.violated", F.lit(False)))
    return gold.join(flags.select(key).distinct(), key, "left_anti")


#: Acceptance limits.
LIMITS = {"miss": 0.05, "false_alarm": 0.20, "artifact_gap": 0.10, "missing": 0.01, "agreement": 0.85, "kappa": 0.70, "adversarial_positives": 50, "structural_j": 0.3, "recall": 0.95, "teacher": 0.90}


def gate_verdict(summary: DataFrame) -> DataFrame:
    """One row: (real_miss, real_fa, real_positives, adv_miss, adv_positives, missing_share) to gates, reasons and verdict.

    The gap is signed: only adversarial rows that are easier than real ones show an artifact.
    """
    c = F.col
    checks = {
        "too many predictions are missing": c("missing_share") > LIMITS["missing"],
        "missed positives": c("real_miss") > LIMITS["miss"],
        "false alarms": c("real_fa") > LIMITS["false_alarm"],
        "too few adversarial positives": c("adv_positives") < LIMITS["adversarial_positives"],
        "real rows are missed more than adversarial ones": (c("adv_positives") >= LIMITS["adversarial_positives"]) & (c("real_miss") - c("adv_miss") > LIMITS["artifact_gap"]),
    }
    reasons = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]), lambda x: x.isNotNull())
    undecided = F.coalesce(c("missing_share") > LIMITS["missing"], F.lit(False)) | (c("adv_positives") < LIMITS["adversarial_positives"])
    out = summary.withColumn("reasons", reasons)
    return out.withColumn("verdict", F.when(undecided, "no conclusion").when(F.size("reasons") > 0, "fail").otherwise("pass"))


def power_warning(counts: DataFrame, gate: float) -> DataFrame:
    """warn where the observed miss rate meets the gate and its upper bound does not; needed positives from the grid."""
    positives = F.col("tp") + F.col("fn")
    warn = (positives > 0) & (F.col("miss_rate") <= gate) & (F.col("miss_rate_upper") > gate)
    return counts.withColumns({"warn": warn, "needed": F.when(warn, S.positives_needed(F.col("miss_rate"), F.lit(gate)))})


def case_gate(counts: DataFrame) -> DataFrame:
    c = F.col
    ok = ((c("agreement") >= LIMITS["agreement"]) | (c("kappa") >= LIMITS["kappa"])) & (c("miss_rate") <= LIMITS["miss"]) & (c("false_alarm") <= LIMITS["false_alarm"])
    return counts.withColumn("passed", ok)


def upsert_kpi(table: DataFrame, new: DataFrame) -> DataFrame:
    """(metric_id, field, value): new values replace old ones of the same key, others stay, no new rows change nothing."""
    return table.join(new, ["metric_id", "field"], "left_anti").unionByName(new)


def reject_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; raises if a key occurs twice."""
    if twice := rows.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise DataContractError(f"keys occur more than once: {[tuple(r)[:-1] for r in twice]}")
    return rows


def train_set_preflight(rows: DataFrame, positive: Column) -> DataFrame:
    """Share of positives and its band: none, low (at most .05), normal, high (above .5)."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(positive).alias("positives"))
    share = S.rate(F.col("positives"), F.col("n"))
    return out.withColumns({"share": share, "band": F.when(share == 0, "none").when(share <= 0.05, "low").when(share <= 0.5, "normal").otherwise("high")})
