"""Roll-ups of labelling runs and what goes between them: dropped rows, two judges' agreement, slots, hints, readouts, training pools.

Every roll-up is one aggregate over rows; joins carry keys and arrays of a case, never whole corpora.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataContractError
from ..functions import stats as S
from ..functions.text import composite_id
from .evaluate import LIMITS, confusion_counts, with_rates
from .joins import join_by_index, join_by_position
from .ranges import with_rank
from .sampling import kind_quota
from .sets import union_rows


def accounted_join(labels: DataFrame, pool: DataFrame, key: str, longest: int, text: str = "source_text") -> DataFrame:
    """labels with the pool's columns and status: the first of error, missing, toolong that fits, else kept. Nothing is dropped here."""
    joined = labels.join(pool.withColumn("__in", F.lit(True)), key, "left")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    status = F.when(failed, "error").when(F.col("__in").isNull(), "missing").when(F.length(text) > longest, "toolong").otherwise("kept")
    return joined.withColumn("status", status).drop("__in")


def verbatim(terms: Column, text: Column, besides: Column | None = None, separator: str = "、") -> Column:
    """Terms that the text holds word for word, without separators or line ends, and not in `besides`."""
    ok = lambda t: text.contains(t) & ~t.contains(separator) & ~t.contains("\n")
    return F.filter(terms, (lambda t: ok(t) & ~F.array_contains(besides, t)) if besides is not None else ok)


def drop_accounting(rows: DataFrame, empty: Column) -> DataFrame:
    """(status, n, empty_targets, empty_share): rows by status; the share of empty targets counts kept rows only, 0 without any."""
    kept = F.col("status") == "kept"
    out = rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(kept & empty).alias("empty_targets"))
    return out.withColumn("empty_share", S.rate(F.col("empty_targets"), F.col("n")))


def cross_check(labels: DataFrame, second: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, parse_failed, disagreements, verdict_match) of each second opinion; points that it does not name are not compared.

    labels, second: (key, key_points array<struct<idx, flag>>, red_lines likewise, verdict); a second verdict and arrays of null did not parse.
    """
    failed = F.col("verdict").isNull() & F.col("key_points").isNull() & F.col("red_lines").isNull()
    marks = second.select(key, failed.alias("parse_failed"), F.col("verdict").alias("__v"))
    off = None
    for array in ("key_points", "red_lines"):
        pairs = join_by_index(labels.select(key, array), second.select(key, array), key, array).where(F.col("b.flag").isNotNull() & ~F.col("a.flag").eqNullSafe(F.col("b.flag"))).select(key)
        off = pairs if off is None else off.unionByName(pairs)
    n = off.groupBy(key).agg(F.count("*").alias("disagreements"))
    out = marks.join(labels.select(key, "verdict"), key).join(n, key, "left")
    return out.select(key, "parse_failed", F.coalesce("disagreements", F.lit(0)).alias("disagreements"), (~F.col("parse_failed") & F.col("__v").eqNullSafe(F.col("verdict"))).alias("verdict_match"))


def cross_check_rollup(rows: DataFrame) -> DataFrame:
    """One row: parse failures, verdict agreement over what parsed, disagreements, rows to look at again."""
    out = rows.agg(F.count("*").alias("n"), F.count_if("parse_failed").alias("parse_failed"), F.count_if("verdict_match").alias("verdict_agree"), F.sum("disagreements").alias("disagreements"), F.count_if((F.col("disagreements") > 0) | F.col("parse_failed")).alias("flagged"))
    return out.withColumn("verdict_agreement", S.rate(F.col("verdict_agree"), F.col("n") - F.col("parse_failed")))


def agreement_by_class(gold: DataFrame, pred: DataFrame, key: str, gold_col: str, pred_col: str) -> DataFrame:
    """One row of counts and agreement, overall and of either class; a missing prediction disagrees, an empty class gives 0."""
    rows = gold.select(key, gold_col).join(pred.select(key, pred_col, F.lit(True).alias("__in")), key, "left")
    g, same = F.col(gold_col), F.coalesce(F.col(gold_col) == F.col(pred_col), F.lit(False))
    out = rows.agg(F.count("*").alias("n_total"), F.count_if(g).alias("n_positive"), F.count_if(~g).alias("n_negative"), F.count_if(F.col("__in").isNull()).alias("n_missing"), F.count_if(same).alias("__s"), F.count_if(g & same).alias("__p"), F.count_if(~g & same).alias("__n"))
    out = out.withColumns({"overall_agreement": S.rate(F.col("__s"), F.col("n_total")), "positive_agreement": S.rate(F.col("__p"), F.col("n_positive")), "negative_agreement": S.rate(F.col("__n"), F.col("n_negative"))})
    return out.withColumn("passed", F.col("overall_agreement") >= LIMITS["teacher"]).drop("__s", "__p", "__n")


def slot_confusion(gold: DataFrame, pred: DataFrame, key: str = "case_id", points: str = "covered", lines: str = "violated") -> DataFrame:
    """One row for a case-level verifier: points and red lines by their places in boolean arrays; cases without a prediction stay out and are counted."""
    def part(array: str, name: str) -> DataFrame:
        slots = join_by_position(gold.withColumnRenamed(array, "__g"), pred.select(key, F.coalesce(array, F.array().cast("array<boolean>")).alias("__p")), key, "__g", "__p")
        truth, said = F.coalesce(F.col("gold"), F.lit(False)), F.coalesce(F.col("pred"), F.lit(False))
        return with_rates(slots.agg(*confusion_counts(truth, said))).select(*[F.col(c).alias(f"{name}_{c}") for c in ("n", "tp", "fp", "fn", "tn", "agreement", "kappa", "miss_rate", "false_alarm", "tpr")])

    cases = gold.select(key).join(pred.select(key, F.lit(True).alias("__in")), key, "left").agg(F.count("__in").alias("n_cases"), F.count_if(F.col("__in").isNull()).alias("n_missing"))
    return cases.join(part(points, "coverage")).join(part(lines, "redline"))  # one row each


def power_rule(counts: DataFrame, gate: float) -> DataFrame:
    """warn where the true miss rate may be above twice the gate (always without positives); needed: a rough count of positives."""
    worst = 1 - S.wilson(F.col("tp"), F.col("tp") + F.col("fn"))["lo"]
    return counts.withColumns({"worst_miss": worst, "warn": worst > 2 * gate, "needed": F.lit(int(1 / gate * 4))})


#: The actions of the readout, in the order in which they are told.
ACTIONS = [
    ("adversarial set cannot be judged", "rebuild the adversarial set"),
    ("artifact", "find the causes row by row and rebuild the synthetic data"),
    ("adversarial set is harder", "no artifact: go by the adversarial gate"),
    ("missed positives", "use the next larger base model"),
    ("adversarial miss", "do not integrate, whatever the total says"),
    ("false alarms", "tighten the threshold and look at the negatives"),
]


def readout(summary: DataFrame) -> DataFrame:
    """(position, gate, action): a row for each gate that fails, each on its own; none where all pass.

    summary: one row (real_miss, real_fa, adv_miss, adv_positives). The gap is signed: only real rows that are missed more show an artifact.
    """
    gap, able = F.col("real_miss") - F.col("adv_miss"), F.col("adv_positives") >= LIMITS["adversarial_positives"]
    fails = [~able, able & (gap > LIMITS["artifact_gap"]), able & (gap < -LIMITS["artifact_gap"]), F.col("real_miss") > LIMITS["miss"], able & (F.col("adv_miss") > LIMITS["miss"]), F.col("real_fa") > LIMITS["false_alarm"]]
    told = F.array(*[F.when(F.coalesce(c, F.lit(True)), F.struct(F.lit(i).alias("position"), F.lit(gate).alias("gate"), F.lit(action).alias("action"))) for i, (c, (gate, action)) in enumerate(zip(fails, ACTIONS, strict=True))])
    return summary.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("r")).select("r.*")


def case_dataset(items: DataFrame, labels: DataFrame, prompt: Column, target: Column, key: str = "case_id", array: str = "red_lines") -> DataFrame:
    """(key, input, output) of cases with a label; raises where an element's idx is not its place."""
    off = F.exists(F.transform(array, lambda r, i: ~F.coalesce(r["idx"] == i, F.lit(False))), lambda b: b)
    if bad := labels.where(off).select(key).limit(5).collect():
        raise DataContractError(f"{array} out of place: {[r[0] for r in bad]}")
    return items.join(labels, key).select(key, prompt.alias("input"), target.alias("output"))


def training_pool(trusted: DataFrame, judged: DataFrame, synthetic: DataFrame, entity_negatives: DataFrame, number_negatives: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Trusted and judged candidates, synthetic positives, and negatives in their measure: as many entities as entity positives, numbers by the kinds of number positives."""
    numbers = synthetic.where("red_line_guess = 2").groupBy("kind").agg(F.count("*").alias("n"))
    entities = synthetic.where("red_line_guess = 0").agg(F.count("*").alias("__cap"))
    ranked = with_rank(entity_negatives, order, "__r")
    kept = ranked.join(F.broadcast(entities), F.col("__r") < F.col("__cap")).drop("__r", "__cap")  # one row
    columns = trusted.columns
    return union_rows(trusted, judged.select(*columns), synthetic.select(*columns), kept.select(*columns), kind_quota(number_negatives, "kind", numbers, order).select(*columns))


def truncated(rows: DataFrame, cap: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first `cap` rows, of each key if there are keys."""
    if not by:
        return rows.orderBy(*order).limit(cap)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= cap).drop("__r")


def top_list(rows: DataFrame, by: Sequence[str], n: int, weight: Column | None = None) -> DataFrame:
    """The n keys with the largest counts (or sums of weight), ties by the keys."""
    freq = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(*by).agg(freq.alias("freq")).orderBy(F.desc("freq"), *by).limit(n)


def tuple_counts(rows: DataFrame, array: str) -> DataFrame:
    """One row: how many different tuples, the most frequent one (of equals the first in order), its count and share."""
    by = rows.groupBy(array).agg(F.count("*").alias("n"))
    out = by.agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("m"), F.col(array).alias("top"))).alias("best"))
    return out.select("kinds", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("best.top").alias("top"), (-F.col("best.m")).alias("top_n"), S.rate(-F.col("best.m"), F.col("rows")).alias("top_share"))


def hint_stats(hints: DataFrame) -> DataFrame:
    """One row over hints (keep, explain, dropped arrays, error, latency_s): sizes, empty rows, errors, mean latency (0 without rows)."""
    size = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))
    out = hints.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(size(c)), F.lit(0)).alias(c) for c in ("keep", "explain", "dropped")], F.count_if((size("keep") == 0) & (size("explain") == 0)).alias("empty"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.coalesce(F.sum("latency_s"), F.lit(0.0)).alias("__l"))
    return out.withColumn("mean_latency", S.rate(F.col("__l"), F.col("n"))).drop("__l")


def with_hints(cases: DataFrame, hints: DataFrame, key: str = "id") -> DataFrame:
    """cases with the hint's arrays; cases without a hint get empty ones."""
    none = F.array().cast("array<string>")
    joined = cases.join(hints.select(key, "keep", "explain"), key, "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("keep", "explain")})


def output_map(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, output), null as empty; of repeated keys the last row by output stands, as in a map that is filled in order of output."""
    return rows.groupBy(key).agg(F.max(F.coalesce("output", F.lit(""))).alias("output"))


def only_cases(cases: DataFrame, ids: DataFrame | None, key: str = "id") -> DataFrame:
    """The cases of the given ids; all cases for None."""
    return cases if ids is None else cases.join(ids.select(key).distinct(), key, "left_semi")


def candidate_tasks(pool: DataFrame, prompt: Column) -> DataFrame:
    """(row_id, prompt) of each candidate; the row id is the composite one that labels are joined by."""
    return pool.select(composite_id(F.col("case_id"), F.col("candidate_text")).alias("row_id"), prompt.alias("prompt"))


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """(case_id, violated): what goes out of a run; the gold never does."""
    return predictions.select(F.col("row_id").alias("case_id"), "violated")


def negative_flavor(case_id: Column, suffixes: dict[str, str], other: str = "plain") -> Column:
    """The flavor whose suffix the id ends with; the first of them wins."""
    return F.coalesce(*[F.when(case_id.endswith(s), F.lit(n)) for s, n in suffixes.items()], F.lit(other))


def without_excluded(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose class is not marked by the prefix as excluded."""
    return rows.where(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def numbered_then_kept(rows: DataFrame, by: Sequence[str], order: Sequence[Column], start: int, keep: Column, prefix: Column) -> DataFrame:
    """Adds id, prefix-NNN from `start`; numbers are dealt before the filter, so gaps stay."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)
    return rows.withColumn("__keep", keep).withColumn("id", F.concat_ws("-", prefix, F.lpad(at.cast("string"), 3, "0"))).where("__keep").drop("__keep")


def recall_gate(counts: DataFrame) -> DataFrame:
    """counts (tp, fn, ...) with recall, 0 without positives, and whether it meets its limit."""
    return counts.withColumn("recall", S.rate(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("passed", F.col("recall") >= LIMITS["recall"])


def table_lines(rows: DataFrame, columns: Sequence[tuple[str, int, str]], order: Sequence[Column]) -> DataFrame:
    """(position, line) of a report: (column, width, format) each; text is padded on the right, numbers by their printf format on the left."""
    cells = [F.rpad(F.col(c).cast("string"), w, " ") if not f else F.lpad(F.format_string(f, c), w, " ") for c, w, f in columns]
    return with_rank(rows, order, "__at").select(F.col("__at").cast("int").alias("position"), F.concat(*cells).alias("line"))
