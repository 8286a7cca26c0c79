"""More of the engine's operators as queries: roll-ups of labelling runs, drop accounting, readouts, lexicon and file round trips.

Importing this module adds its queries and SQL to the catalogue's tables. Values are planted by SHA-256, which both engines have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as Hs
from ..functions import text as X
from ..functions.lexical import canonical_json, nfkc_packed, readability, rounded, segments
from ..operators import checks as Ck
from ..operators import evaluate as Ev
from ..operators import reporting as Rp
from ..operators import selection as Sl
from ..operators import sets as Se
from ..sources import readers as Rd
from ..sources import sinks as Si
from ..sources.tables import shared_root, spread
from .catalogue import FLAG_ROWS_SQL, LEXICON, PAIRS_SQL, flag_rows, h8, pairs, planted, query, r9, rate_sql, wilson_sql



def scratch(spark, name: str) -> str:
    """A folder that driver and executors share, for files that a query writes and reads."""
    return f"{shared_root(spark)}/sieveworks-files/{name}-{uuid.uuid4().hex}"


# --- joins with accounting, hints, outputs ---

DROPS_SQL = f"""(
    SELECT l.*, p.source_text, p.answer,
           CASE WHEN error != '' THEN 'error' WHEN p.case_id IS NULL THEN 'missing' WHEN length(p.source_text) > 400 THEN 'toolong' ELSE 'kept' END AS status
    FROM (SELECT CASE WHEN {h8('case_id')} % 10 = 1 THEN case_id || '?' ELSE case_id END AS id,
                 CASE WHEN {h8('case_id')} % 10 = 0 THEN 'timeout' ELSE '' END AS error,
                 regexp_extract(answer, '[A-Za-z]{{3,}}') AS word
          FROM {PAIRS_SQL}) l LEFT JOIN {PAIRS_SQL} p ON p.case_id = l.id)"""


def labelled_pairs(read) -> DataFrame:
    h = planted(F.col("case_id"))
    labels = pairs(read).select(
        F.when(h % 10 == 1, F.concat("case_id", F.lit("?"))).otherwise(F.col("case_id")).alias("case_id"),
        F.when(h % 10 == 0, "timeout").alias("error"),
        F.array(F.regexp_extract("answer", "[A-Za-z]{3,}", 0)).alias("keep"),
    )
    return Rp.accounted_join(labels, pairs(read), "case_id", 400)


@query("accounted_join", f"SELECT id AS case_id, status, CASE WHEN word != '' AND contains(source_text, word) THEN word ELSE '' END AS kept FROM {DROPS_SQL}")
def accounted_join(read):
    kept = Rp.verbatim(F.filter("keep", lambda w: w != ""), F.coalesce("source_text", F.lit("")))
    return labelled_pairs(read).select("case_id", "status", F.array_join(kept, "|").alias("kept"))


@query("drop_accounting", f"""
SELECT status, n, empty_targets, {rate_sql('empty_targets', 'n')} AS empty_share
FROM (SELECT status, count(*) AS n, count_if(status = 'kept' AND NOT (word != '' AND contains(source_text, word))) AS empty_targets FROM {DROPS_SQL} GROUP BY status)""")
def drop_accounting(read):
    rows = labelled_pairs(read)
    return Rp.drop_accounting(rows, F.size(Rp.verbatim(F.filter("keep", lambda w: w != ""), F.col("source_text"))) == 0)


HINTS_SQL = """(
    SELECT doc_id AS id, regexp_extract_all(text, '[A-Z][a-z]{5,}')[1:3] AS keep, regexp_extract_all(text, '[0-9]+')[1:2] AS explain,
           CASE WHEN doc_id % 13 = 0 THEN 'timeout' ELSE '' END AS error, (doc_id % 7)::DOUBLE / 2 AS latency_s
    FROM documents WHERE lang = 'en')"""


def hints(read) -> DataFrame:
    first = lambda p, n: F.slice(F.regexp_extract_all("text", F.lit(p), F.lit(0)), 1, n)
    return read("documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), first("[A-Z][a-z]{5,}", 3).alias("keep"), first("[0-9]+", 2).alias("explain"), F.array().cast("array<string>").alias("dropped"), F.when(F.col("doc_id") % 13 == 0, "timeout").alias("error"), ((F.col("doc_id") % 7).cast("double") / 2).alias("latency_s"))


@query("hint_stats", f"""
SELECT count(*) AS n, sum(len(keep))::BIGINT AS keep, sum(len(explain))::BIGINT AS explain, 0::BIGINT AS dropped, count_if(len(keep) = 0 AND len(explain) = 0) AS empty,
       count_if(error != '') AS errors, sum(latency_s) / count(*) AS mean_latency
FROM {HINTS_SQL}""")
def hint_stats(read):
    return Rp.hint_stats(hints(read))


@query("hints_on_cases", f"SELECT d.doc_id AS id, coalesce(array_to_string(keep, '|'), '') AS keep, coalesce(array_to_string(explain, '|'), '') AS explain FROM documents d LEFT JOIN {HINTS_SQL} h ON h.id = d.doc_id")
def hints_on_cases(read):
    got = Rp.with_hints(read("documents").select(F.col("doc_id").alias("id")), hints(read))
    return got.select("id", F.array_join("keep", "|").alias("keep"), F.array_join("explain", "|").alias("explain"))


@query("output_map", "SELECT conv_id AS id, max(CASE WHEN turn % 2 = 0 THEN text ELSE '' END) AS output FROM conversations GROUP BY conv_id")
def output_map(read):
    return Rp.output_map(read("conversations").select(F.col("conv_id").alias("id"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("output")))


@query("case_subset", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def case_subset(read):
    return Rp.only_cases(read("documents").select("doc_id", "lang"), read("labels").where("quality = 0"), "doc_id")


@query("candidate_tasks", f"SELECT case_id || '::' || substr(answer, 1, 5) AS row_id, source_text || chr(10) || substr(answer, 1, 5) AS prompt FROM {PAIRS_SQL}")
def candidate_tasks(read):
    pool = pairs(read).withColumn("candidate_text", F.substring("answer", 1, 5))
    return Rp.candidate_tasks(pool, F.concat("source_text", F.lit("\n"), "candidate_text"))


@query("prediction_rows", f"SELECT case_id || '::' || substr(answer, 1, 5) AS case_id, {h8('case_id')} % 2 = 0 AS violated FROM {PAIRS_SQL}")
def prediction_rows(read):
    pool = pairs(read).withColumns({"candidate_text": F.substring("answer", 1, 5), "violated": planted(F.col("case_id")) % 2 == 0})
    return Rp.prediction_rows(pool.select(X.composite_id(F.col("case_id"), F.col("candidate_text")).alias("row_id"), "violated", F.lit(True).alias("gold")))


# --- two judges, slots, gates ---

A, B = h8("case_id"), h8("'second' || case_id")
CROSS_SQL = f"""(
    SELECT case_id, b % 11 = 0 AS parse_failed,
           CASE WHEN b % 11 = 0 THEN 0 ELSE (CASE WHEN (a % 2 = 0) != (b % 2 = 0) THEN 1 ELSE 0 END) + (CASE WHEN b % 7 != 0 AND (a % 5 = 0) != (b % 5 = 0) THEN 1 ELSE 0 END) END::BIGINT AS disagreements,
           b % 11 != 0 AND (a % 5 = 0) = (b % 5 = 0) AS verdict_match
    FROM (SELECT case_id, {A} AS a, {B} AS b FROM {PAIRS_SQL}))"""


def opinions(read) -> tuple[DataFrame, DataFrame]:
    a, b = planted(F.col("case_id")), planted(F.concat(F.lit("second"), "case_id"))
    point = lambda i, flag: F.struct(F.lit(i).alias("idx"), flag.alias("flag"))
    verdict = lambda h: F.when(h % 5 == 0, "fail").otherwise("pass")
    cases, parsed = pairs(read).select("case_id"), b % 11 != 0
    first = cases.select("case_id", F.array(point(0, a % 2 == 0), point(1, a % 3 == 0)).alias("key_points"), F.array(point(0, a % 5 == 0)).alias("red_lines"), verdict(a).alias("verdict"))
    second = cases.select("case_id", F.when(parsed, F.array(point(0, b % 2 == 0))).alias("key_points"), F.when(parsed, F.array(point(0, F.when(b % 7 != 0, b % 5 == 0)))).alias("red_lines"), F.when(parsed, verdict(b)).alias("verdict"))
    return first, second


@query("cross_check", f"SELECT * FROM {CROSS_SQL}")
def cross_check(read):
    return Rp.cross_check(*opinions(read))


@query("cross_check_rollup", f"""
SELECT n, parse_failed, verdict_agree, disagreements, flagged, {rate_sql('verdict_agree', '(n - parse_failed)')} AS verdict_agreement
FROM (SELECT count(*) AS n, count_if(parse_failed) AS parse_failed, count_if(verdict_match) AS verdict_agree, sum(disagreements)::BIGINT AS disagreements, count_if(disagreements > 0 OR parse_failed) AS flagged FROM {CROSS_SQL})""")
def cross_check_rollup(read):
    return Rp.cross_check_rollup(Rp.cross_check(*opinions(read)))


@query("agreement_by_class", f"""
SELECT n_total, n_positive, n_negative, n_missing, {rate_sql('s', 'n_total')} AS overall_agreement, {rate_sql('p', 'n_positive')} AS positive_agreement, {rate_sql('q', 'n_negative')} AS negative_agreement, s::DOUBLE / n_total >= 0.9 AS passed
FROM (SELECT count(*) AS n_total, count_if(gold) AS n_positive, count_if(NOT gold) AS n_negative, count_if(pred IS NULL) AS n_missing, count_if(coalesce(gold = pred, false)) AS s, count_if(gold AND coalesce(pred, false)) AS p, count_if(NOT gold AND NOT coalesce(pred, true)) AS q
      FROM (SELECT doc_id, quality = 1 AS gold FROM labels) LEFT JOIN (SELECT doc_id, toxic = 0 AS pred FROM labels WHERE doc_id % 4 != 0) USING (doc_id))""")
def agreement_by_class(read):
    gold = read("labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    pred = read("labels").where("doc_id % 4 != 0").select("doc_id", (F.col("toxic") == 0).alias("pred"))
    return Rp.agreement_by_class(gold, pred, "doc_id", "gold", "pred")


def slot_sql(name: str, gold: str, pred: str) -> str:
    slots = f"SELECT unnest(range(len(g.{gold}))) AS i, g.{gold} AS g, p.{pred} AS p FROM g JOIN p USING (case_id)"
    counts = f"SELECT count_if(x AND y) AS tp, count_if(NOT x AND y) AS fp, count_if(x AND NOT y) AS fn, count_if(NOT x AND NOT y) AS tn FROM (SELECT g[i + 1] AS x, coalesce(p[i + 1], false) AS y FROM ({slots}))"
    kappa = "CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END"
    inner = f"SELECT *, tp + fp + fn + tn AS n, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS po, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / ((tp + fp + fn + tn)::DOUBLE * (tp + fp + fn + tn)::DOUBLE) AS pe FROM ({counts})"
    columns = {"n": "n", "tp": "tp", "fp": "fp", "fn": "fn", "tn": "tn", "agreement": "round(po, 9)", "kappa": f"round({kappa}, 9)", "miss_rate": f"round({rate_sql('fn', '(tp + fn)')}, 9)", "false_alarm": f"round({rate_sql('fp', '(fp + tn)')}, 9)", "tpr": f"round({rate_sql('tp', '(tp + fn)')}, 9)"}
    return "(SELECT " + ", ".join(f"{v} AS {name}_{k}" for k, v in columns.items()) + f" FROM ({inner}))"


@query("slot_confusion", f"""
WITH g AS (SELECT conv_id AS case_id, list(length(text) > 150 ORDER BY turn) AS covered, list(contains(text, 'q') ORDER BY turn) AS violated FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id AS case_id, list(contains(text, 'a') ORDER BY turn) AS covered, list(contains(text, 'z') ORDER BY turn) AS violated FROM conversations WHERE turn < 3 AND conv_id % 5 != 0 GROUP BY conv_id)
SELECT n_cases, n_missing, c.*, r.* FROM (SELECT count(p.case_id) AS n_cases, count_if(p.case_id IS NULL) AS n_missing FROM g LEFT JOIN p USING (case_id)), {slot_sql('coverage', 'covered', 'covered')} c, {slot_sql('redline', 'violated', 'violated')} r""")
def slot_confusion(read):
    c = read("conversations").withColumnRenamed("conv_id", "case_id")
    of = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda x: x["v"])
    gold = c.groupBy("case_id").agg(of(F.length("text") > 150).alias("covered"), of(F.col("text").contains("q")).alias("violated"))
    pred = c.where("turn < 3 AND case_id % 5 != 0").groupBy("case_id").agg(of(F.col("text").contains("a")).alias("covered"), of(F.col("text").contains("z")).alias("violated"))
    out = Rp.slot_confusion(gold, pred)
    return out.select(*[r9(x) if t == "double" else F.col(x) for x, t in out.dtypes])


BY_LANG_SQL = f"(SELECT lang, count_if(label AND flag) AS tp, count_if(label AND NOT flag) AS fn FROM {FLAG_ROWS_SQL} GROUP BY lang)"


@query("power_rule", f"SELECT lang, tp, fn, round(worst, 9) AS worst_miss, worst > 0.1 AS warn, 80 AS needed FROM (SELECT *, 1 - {wilson_sql('tp', '(tp + fn)', '-')} AS worst FROM {BY_LANG_SQL})")
def power_rule(read):
    counts = flag_rows(read).groupBy("lang").agg(*Ev.confusion_counts(F.col("label"), F.col("flag")))
    return Rp.power_rule(counts, 0.05).select("lang", "tp", "fn", r9("worst_miss"), "warn", "needed")


@query("power_warning", f"SELECT lang, tp, fn, (tp + fn > 0 AND fn::DOUBLE / (tp + fn) <= 0.9 AND 1 - {wilson_sql('tp', '(tp + fn)', '-')} > 0.9) AS warn FROM {BY_LANG_SQL}")
def power_warning(read):
    counts = Ev.with_rates(flag_rows(read).groupBy("lang").agg(*Ev.confusion_counts(F.col("label"), F.col("flag"))))
    return Ev.power_warning(counts, 0.9).select("lang", "tp", "fn", "warn")


@query("recall_gate", f"SELECT lang, tp, fn, {rate_sql('tp', '(tp + fn)')} AS recall, {rate_sql('tp', '(tp + fn)')} >= 0.95 AS passed FROM {BY_LANG_SQL}")
def recall_gate(read):
    counts = flag_rows(read).groupBy("lang").agg(*Ev.confusion_counts(F.col("label"), F.col("flag")))
    return Rp.recall_gate(counts).select("lang", "tp", "fn", "recall", "passed")


SUMMARY_SQL = f"""(
    SELECT {rate_sql('rfn', '(rtp + rfn)')} AS real_miss, {rate_sql('rfp', '(rfp + rtn)')} AS real_fa, rtp + rfn AS real_positives, {rate_sql('afn', '(atp + afn)')} AS adv_miss, atp + afn AS adv_positives
    FROM (SELECT count_if(label AND flag) AS rtp, count_if(label AND NOT flag) AS rfn, count_if(NOT label AND flag) AS rfp, count_if(NOT label AND NOT flag) AS rtn,
                 count_if(label AND flag AND doc_id % 3 = 0) AS atp, count_if(label AND NOT flag AND doc_id % 3 = 0) AS afn FROM {FLAG_ROWS_SQL}))"""


def summary(read) -> DataFrame:
    rows = flag_rows(read)
    counts = lambda df: Ev.with_rates(df.agg(*Ev.confusion_counts(F.col("label"), F.col("flag"))))
    real = counts(rows).select(F.col("miss_rate").alias("real_miss"), F.col("false_alarm").alias("real_fa"), (F.col("tp") + F.col("fn")).alias("real_positives"))
    return real.join(counts(rows.where("doc_id % 3 = 0")).select(F.col("miss_rate").alias("adv_miss"), (F.col("tp") + F.col("fn")).alias("adv_positives")))  # one row each


FAILS_SQL = ["NOT able", "able AND real_miss - adv_miss > 0.1", "able AND real_miss - adv_miss < -0.1", "real_miss > 0.05", "able AND adv_miss > 0.05", "real_fa > 0.2"]


@query("readout", "SELECT position::INT AS position, gate, action FROM (" + " UNION ALL ".join(f"SELECT {i} AS position, '{gate}' AS gate, '{action}' AS action FROM (SELECT *, adv_positives >= 50 AS able FROM {SUMMARY_SQL}) WHERE {cond}" for i, (cond, (gate, action)) in enumerate(zip(FAILS_SQL, Rp.ACTIONS, strict=True))) + ")")
def readout(read):
    return Rp.readout(summary(read))


@query("gate_verdict", f"""
SELECT CASE WHEN adv_positives < 50 THEN 'no conclusion' WHEN reasons != '' THEN 'fail' ELSE 'pass' END AS verdict, reasons
FROM (SELECT *, concat_ws('|', CASE WHEN real_miss > 0.05 THEN 'missed positives' END, CASE WHEN real_fa > 0.2 THEN 'false alarms' END, CASE WHEN adv_positives < 50 THEN 'too few adversarial positives' END,
                             CASE WHEN adv_positives >= 50 AND real_miss - adv_miss > 0.1 THEN 'real rows are missed more than adversarial ones' END) AS reasons FROM {SUMMARY_SQL})""")
def gate_verdict(read):
    return Ev.gate_verdict(summary(read).withColumn("missing_share", F.lit(0.0))).select("verdict", F.array_join("reasons", "|").alias("reasons"))


@query("case_gate", f"""
SELECT lang, ((po >= 0.85 OR CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END >= 0.7) AND miss <= 0.05 AND fa <= 0.2) AS passed
FROM (SELECT lang, (tp + tn)::DOUBLE / n AS po, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n::DOUBLE * n::DOUBLE) AS pe, {rate_sql('fn', '(tp + fn)')} AS miss, {rate_sql('fp', '(fp + tn)')} AS fa
      FROM (SELECT lang, count(*) AS n, count_if(label AND flag) AS tp, count_if(NOT label AND flag) AS fp, count_if(label AND NOT flag) AS fn, count_if(NOT label AND NOT flag) AS tn FROM {FLAG_ROWS_SQL} GROUP BY lang))""")
def case_gate(read):
    counts = flag_rows(read).groupBy("lang").agg(*Ev.confusion_counts(F.col("label"), F.col("flag")))
    return Ev.case_gate(Ev.with_rates(counts)).select("lang", "passed")


@query("micro_macro", f"SELECT lang, avg(n_chars) AS mean, count(n_chars) AS n, (grouping(lang))::TINYINT AS is_total FROM documents GROUP BY ROLLUP (lang)")
def micro_macro(read):
    return Ev.micro_macro(read("documents"), "lang", "n_chars")


@query("pass_rates", f"SELECT lang, passed, n, round({rate_sql('passed', 'n')}, 4) AS pass_rate, round({wilson_sql('passed', 'n', '-')}, 9) AS lo FROM (SELECT lang, count_if(n_chars >= 900) AS passed, count(n_chars) AS n FROM documents GROUP BY lang)")
def pass_rates(read):
    return Ev.pass_rates(read("documents"), ["lang"], "n_chars", 900).select("lang", "passed", "n", F.round("pass_rate", 4).alias("pass_rate"), F.round("ci.lo", 9).alias("lo"))


@query("instance_level", f"""
SELECT tp, fp, fn, tn, round({rate_sql('fn', '(tp + fn)')}, 9) AS miss_rate
FROM (SELECT count_if(gold AND flag) AS tp, count_if(NOT gold AND flag) AS fp, count_if(gold AND NOT flag) AS fn, count_if(NOT gold AND NOT flag) AS tn
      FROM (SELECT unnest([a % 3 = 0, a % 4 = 0]) AS gold, a % 2 = 0 AS flag FROM (SELECT {A} AS a FROM {PAIRS_SQL})))""")
def instance_level(read):
    a = planted(F.col("case_id"))
    line = lambda i, v: F.struct(F.lit(i).alias("idx"), v.alias("violated"))
    cases = pairs(read).select("case_id", F.array(line(0, a % 3 == 0), line(1, a % 7 == 0), line(2, a % 4 == 0)).alias("red_lines"))
    flags = pairs(read).where(a % 2 == 0).select("case_id")
    return Ev.instance_level(cases, flags).select("tp", "fp", "fn", "tn", r9("miss_rate"))


# --- pools, ids, lists ---


@query("case_dataset", f"SELECT case_id, 'read: ' || source_text AS input, CASE WHEN {A} % 2 = 0 THEN 'fail' ELSE 'pass' END AS output FROM {PAIRS_SQL} WHERE {A} % 3 != 0")
def case_dataset(read):
    a = planted(F.col("case_id"))
    labels = pairs(read).where(a % 3 != 0).select("case_id", F.when(a % 2 == 0, "fail").otherwise("pass").alias("verdict"), F.array(*[F.struct(F.lit(i).alias("idx"), (a % (i + 2) == 0).alias("violated")) for i in range(3)]).alias("red_lines"))
    return Rp.case_dataset(pairs(read), labels, F.concat(F.lit("read: "), "source_text"), F.col("verdict"))


@query("training_pool", """
WITH d AS (SELECT doc_id, lang AS kind, doc_id % 10 AS k, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS red FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM d WHERE k IN (4, 5, 6)),
f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS r FROM d WHERE k > 6)
SELECT doc_id, kind FROM d WHERE k < 4
UNION ALL SELECT doc_id, kind FROM e WHERE r <= (SELECT count(*) FROM d WHERE k IN (2, 3) AND red = 0)
UNION ALL SELECT doc_id, f.kind FROM f JOIN (SELECT kind, count(*) AS n FROM d WHERE k IN (2, 3) AND red = 2 GROUP BY kind) q ON q.kind = f.kind AND r <= n""")
def training_pool(read):
    d = read("documents").select("doc_id", F.col("lang").alias("kind"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2).alias("red_line_guess"), (F.col("doc_id") % 10).alias("k"))
    part = lambda *ks: d.where(F.col("k").isin(*ks)).drop("k")
    pool = Rp.training_pool(part(0).select("doc_id", "kind"), part(1), part(2, 3), part(4, 5, 6), part(7, 8, 9), [F.col("doc_id")])
    return pool.select("doc_id", "kind")


@query("truncated", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 7")
def truncated(read):
    return Rp.truncated(read("documents"), 7, [F.desc("n_chars"), F.col("doc_id")], ["lang"]).select("lang", "doc_id")


@query("top_list", "SELECT event_type, user_id, count(*) AS freq FROM events GROUP BY ALL ORDER BY freq DESC, event_type, user_id LIMIT 40")
def top_list(read):
    return Rp.top_list(read("events"), ["event_type", "user_id"], 40)


@query("tuple_counts", "SELECT count(*) AS kinds, sum(n)::BIGINT AS rows, arg_min(array_to_string(t, '|'), {'m': -n, 't': t}) AS top, max(n) AS top_n, max(n)::DOUBLE / sum(n)::DOUBLE AS top_share FROM (SELECT [lang, source] AS t, count(*) AS n FROM documents GROUP BY 1)")
def tuple_counts(read):
    return Rp.tuple_counts(read("documents").select(F.array("lang", "source").alias("t")), "t").select("kinds", "rows", F.array_join("top", "|").alias("top"), "top_n", "top_share")


@query("negative_flavor", "SELECT doc_id, CASE WHEN doc_id::VARCHAR LIKE '%7' THEN 'grounded' WHEN doc_id::VARCHAR LIKE '%3' THEN 'equivalent' ELSE 'plain' END AS flavor FROM documents")
def negative_flavor(read):
    return read("documents").select("doc_id", Rp.negative_flavor(F.col("doc_id").cast("string"), {"7": "grounded", "3": "equivalent"}).alias("flavor"))


@query("without_excluded", "SELECT doc_id, source FROM documents WHERE source NOT LIKE 'src1%'")
def without_excluded(read):
    return Rp.without_excluded(read("documents").select("doc_id", "source"), "source", "src1")


@query("numbered_then_kept", "SELECT lang || '-' || format('{:03d}', r + 4) AS id, doc_id FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE n_chars > 500 AND r < 900")
def numbered_then_kept(read):
    first = Rp.truncated(read("documents"), 899, [F.col("doc_id")], ["lang"])
    return Rp.numbered_then_kept(first, ["lang"], [F.col("doc_id")], 5, F.col("n_chars") > 500, F.col("lang")).select("id", "doc_id")


@query("table_lines", "SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS position, rpad(lang, 6, ' ') || lpad(n::VARCHAR, 8, ' ') || lpad(printf('%.3f', share), 9, ' ') AS line FROM (SELECT lang, count(*) AS n, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE AS share FROM documents GROUP BY lang)")
def table_lines(read):
    d = read("documents")
    by = d.groupBy("lang").agg(F.count("*").alias("n")).join(d.agg(F.count("*").alias("all"))).withColumn("share", F.col("n").cast("double") / F.col("all"))  # one row
    return Rp.table_lines(by, [("lang", 6, ""), ("n", 8, "%d"), ("share", 9, "%.3f")], [F.col("lang")])


@query("dataset_hash", "SELECT sha256(string_agg(j, '' ORDER BY doc_id)) AS content_hash, count(*) AS n_rows FROM (SELECT doc_id, '{\"doc_id\": ' || doc_id || ', \"quality\": ' || quality || ', \"toxic\": ' || toxic || '}' AS j FROM labels)")
def dataset_hash(read):
    return Hs.dataset_hash(read("labels").select("doc_id", canonical_json(F.to_json(F.struct("toxic", "quality", "doc_id"))).alias("json")), "doc_id", "json")


@query("nfkc_names", r"SELECT p_partkey, regexp_replace(p_name || ' No 7', '\s', '', 'g') AS name FROM part")
def nfkc_names(read):
    """NFKC turns full-width letters and digits into ASCII ones, so the planted tail comes out as plain text."""
    return read("part").select("p_partkey", nfkc_packed(F.concat("p_name", F.lit(" Ｎｏ　７"))).alias("name"))


# --- readability ---

#: Texts without brackets, so no word is glossed: terms are marked off, what lies between falls into words, white space and single characters.
MARKED_SQL = "regexp_replace(translate(text, '()', ''), '(tionally|tion|lich|ción|eau)', chr(1) || '\\1' || chr(1), 'g')"
TOKENS_SQL = f"(SELECT doc_id, text, unnest(CASE WHEN i % 2 = 0 THEN [p] ELSE regexp_extract_all(p, '[A-Za-z0-9]+|\\s+|(?s:.)') END) AS token FROM (SELECT doc_id, text, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, text, string_split({MARKED_SQL}, chr(1)) AS parts FROM documents)))"


@query("readability_plain", f"""
SELECT doc_id, coalesce(n, 0) AS n_scored, CASE WHEN n > 0 THEN passed::DOUBLE / n ELSE 0.0::DOUBLE END AS strict, CASE WHEN n > 0 THEN 100.0::DOUBLE * terms / n ELSE 0.0::DOUBLE END AS term_density, round(CASE WHEN n > 0 THEN passed::DOUBLE / n ELSE 0.0::DOUBLE END, 4) AS source
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(token IN ('kg', 'the', 'of', 'and')) AS passed, count_if(token IN ('tionally', 'tion', 'lich', 'ción', 'eau')) AS terms FROM {TOKENS_SQL} WHERE regexp_matches(token, '^[A-Za-z]') GROUP BY doc_id) USING (doc_id)""")
def readability_plain(read):
    d = spread(read("documents")).select("doc_id", F.translate("text", "()", "").alias("text"))
    s = readability(d.sparkSession, F.col("text"), LEXICON, failures=False)
    return d.select("doc_id", "text", s.alias("s")).select("doc_id", "s.n_scored", "s.strict", "s.term_density", rounded(F.col("text"), F.col("s.strict")).alias("source"))


@query("segments", f"SELECT doc_id, count(*) AS n, sum(length(token))::BIGINT AS chars, max(length(token))::BIGINT AS longest FROM {TOKENS_SQL} WHERE token != '' GROUP BY doc_id")
def segments_of(read):
    """The tokens of each text; nothing is lost."""
    d = spread(read("documents")).select("doc_id", F.translate("text", "()", "").alias("text"))
    tokens = d.select("doc_id", F.explode(segments(d.sparkSession, F.col("text"), LEXICON)).alias("t"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("t.token")).alias("chars"), F.max(F.length("t.token")).cast("long").alias("longest"))


# --- predicates and texts ---


@query("grounded_evidence", f"SELECT case_id, {A} % 3 = 0 OR contains(source_text, word) OR contains(answer, word) AS grounded FROM (SELECT *, CASE WHEN {A} % 2 = 0 THEN substr(answer, 3, 9) ELSE 'zzqx' END AS word FROM {PAIRS_SQL})")
def grounded_evidence(read):
    a = planted(F.col("case_id"))
    evidence = F.when(a % 3 == 0, "").otherwise(F.when(a % 2 == 0, F.substring("answer", 3, 9)).otherwise("zzqx"))
    return pairs(read).select("case_id", X.grounded(evidence, F.col("source_text"), F.col("answer")).alias("grounded"))


@query("joined_fields", "SELECT p_partkey, 'name：' || p_name || chr(10) || p_brand AS text, p_name != '' AND p_brand != '' AS filled FROM part")
def joined_fields(read):
    values = [("p_name", F.col("p_name")), ("p_brand", F.col("p_brand"))]
    return read("part").select("p_partkey", X.join_fields(values, {"p_name": "name"}).alias("text"), X.all_filled([v for _, v in values]).alias("filled"))


@query("loose_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) END::BIGINT AS strict_k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS grabbed_k FROM events")
def loose_json(read):
    """Every third answer has words around its object: a strict reader takes none of it, a greedy one finds the braces."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so: "), "props", F.lit(" ok"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    k = lambda parsed: F.coalesce(parsed["k"], F.lit(-1).cast("long"))
    return read("events").select("event_id", k(X.stripped_json(raw, "k BIGINT")).alias("strict_k"), k(X.greedy_json(raw, "k BIGINT")).alias("grabbed_k"))


@query("section_split", f"SELECT case_id, source_text AS source, answer AS said FROM {PAIRS_SQL}")
def section_split(read):
    from ..operators.candidates import split_case

    text = F.concat(F.lit("【原文】"), "source_text", F.lit("【回答】"), "answer", F.lit("【要点】x"))
    source, answer = split_case(text)
    return pairs(read).select("case_id", source.alias("source"), answer.alias("said"))


@query("kinds_of", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'digit' WHEN 1 THEN 'cn_numeral' WHEN 2 THEN 'fraction' ELSE 'lexicon' END AS kind FROM events")
def kinds_of(read):
    from ..operators.candidates import infer_kind

    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(k == 1, "三天").when(k == 2, "三分之一").otherwise(F.col("event_type"))
    return read("events").select("event_id", infer_kind(text).alias("kind"))


@query("case_rule_problems", f"""
SELECT id, rule, detail FROM (
    SELECT case_id AS id, 'difficulty' AS rule, 'hard' AS detail FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 5 = 0
    UNION ALL SELECT case_id, 'key points', '1' FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 7 = 0
    UNION ALL SELECT case_id, 'query in source', '' FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 11 = 0 AND length(source_text) >= 12
    UNION ALL SELECT case_id, 'short query', '' FROM {PAIRS_SQL} WHERE false)""")
def case_rule_problems(read):
    """Cases with planted defects, through the validator of authored cases."""
    a = planted(F.col("case_id"))
    two = F.array(F.lit("x"), F.lit("y"))
    query_ = F.when((a % 11 == 0) & (F.length("source_text") >= 12), F.substring("source_text", 1, 12)).otherwise("zz a long question qx")
    cases = pairs(read).select(F.col("case_id").alias("id"), F.lit("s").alias("scenario"), F.lit("p").alias("parent_class"), F.when(a % 5 == 0, "hard").otherwise("easy").alias("difficulty"), F.lit("m").alias("targets_failure_mode"), F.when(a % 7 == 0, F.array(F.lit("x"))).otherwise(two).alias("key_points"), two.alias("negative_rubric"), query_.alias("query"), "source_text", F.struct(F.col("case_id").alias("record_id")).alias("provenance"))
    return Ck.case_problems(cases, ["id", "query", "key_points"], {"s": "p"}, ["easy"], ["m"])


@query("label_problems", f"""
SELECT case_id AS id, 'verdict' AS rule, 'maybe' AS detail FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 5 = 0
UNION ALL SELECT case_id, 'evidence is not in the texts', '' FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 3 = 0
UNION ALL SELECT case_id, 'red line count', '1' FROM (SELECT *, {A} AS a FROM {PAIRS_SQL}) WHERE a % 7 = 0""")
def label_problems(read):
    a = planted(F.col("case_id"))
    item = lambda flag: F.struct(F.lit(0).alias("idx"), F.lit(True).alias(flag), F.when(a % 3 == 0, "zzqx!").otherwise(F.substring("answer", 1, 4)).alias("evidence"))
    labels = pairs(read).select("case_id", F.array(item("covered")).alias("key_points"), F.array(item("violated")).alias("red_lines"), F.when(a % 5 == 0, "maybe").otherwise("pass").alias("verdict"))
    cases = pairs(read).select("case_id", "source_text", "answer", F.array(F.lit("k")).alias("key_points"), F.when(a % 7 == 0, F.array(F.lit("r"), F.lit("s"))).otherwise(F.array(F.lit("r"))).alias("red_lines"))
    return Ck.label_problems(labels, cases)


@query("prediction_audit", f"""
SELECT count(*) AS n, count_if(a % 4 = 0) AS parse_failed, count_if(a % 4 != 0 AND a % 3 = 0) AS schema_failed, count_if(a % 4 != 0)::BIGINT * 2 AS evidence, count_if(a % 4 != 0)::BIGINT AS evidence_grounded
FROM (SELECT {A} AS a FROM {PAIRS_SQL})""")
def prediction_audit(read):
    a = planted(F.col("case_id"))
    body = F.concat(F.lit('{"key_points": [{"idx": 0, "covered": true, "evidence": "zzqx!"}], "red_lines": [{"idx": 0, "violated": false, "evidence": "src: "}], "verdict": "'), F.when(a % 3 == 0, "maybe").otherwise("pass"), F.lit('"}'))
    rows = pairs(read).select(F.when(a % 4 == 0, "no json").otherwise(body).alias("raw"), F.lit(1).alias("n_points"), F.lit(1).alias("n_lines"), F.concat(F.lit("src: "), "source_text").alias("source_text"), "answer")
    return Ck.audit_summary(Ck.audit_predictions(rows))


@query("forced_gender", "SELECT p_partkey, CASE WHEN contains(p_name, 'a') THEN '男' WHEN contains(p_name, 'e') THEN '女' ELSE '-' END AS gender FROM part")
def forced_gender(read):
    return read("part").select("p_partkey", F.coalesce(Sl.forced_gender(F.col("p_name"), ["a"], ["e"]), F.lit("-")).alias("gender"))


@query("suggested_difficulty", "SELECT doc_id, CASE WHEN p < 0.4 THEN '易' WHEN p < 0.85 THEN '中' ELSE '难' END AS difficulty FROM (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY source) AS p FROM documents)")
def suggested_difficulty(read):
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    at = read("documents").select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("at"), F.count("*").over(w).alias("n"))
    return at.select("doc_id", Sl.suggested_difficulty(F.col("at"), F.col("n")).alias("difficulty"))


@query("han_chars", "SELECT DISTINCT unnest(string_split('高血压糖尿病' || chr(20013 + (n_nationkey % 5)::INT), '')) AS char FROM nation")
def han_chars(read):
    tokens = read("nation").select(F.concat(F.lit("高血压abc糖尿病"), F.chr(F.lit(65)), F.col("n_nationkey").cast("string"), F.element_at(F.array(*[F.lit(chr(20013 + i)) for i in range(5)]), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("value"))
    return Se.han_chars(tokens)


@query("lexicon_union", "SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 6 UNION SELECT DISTINCT n_name FROM nation")
def lexicon_union(read):
    terms = read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term"))
    return Se.lexicon_union(terms, read("nation").select(F.col("n_name").alias("term")), 6)


# --- files ---


def csv_library(read, name: str) -> DataFrame:
    """The records of a table that was written as a CSV library and read again."""
    spark = read("nation").sparkSession
    root = scratch(spark, name)
    rows = read("nation").orderBy("n_nationkey").coalesce(1).select("n_name", F.concat(F.lit("line 1\nwith, \"quotes\" "), "n_name").alias("note"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("string")).otherwise("").alias("n_regionkey"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(f"{root}/countries")
    return Rd.read_libraries(spark, root)


@query("library_records", "SELECT 'countries' AS lib, n_nationkey::INT AS row_idx, n_name AS name, CASE WHEN n_nationkey % 3 != 0 THEN 'n_name|note|n_regionkey' ELSE 'n_name|note' END AS filled, 'line 1' || chr(10) || 'with, \"quotes\" ' || n_name AS comment FROM nation")
def library_records(read):
    """CSV of quoted line ends, read into records with ids, names and filled fields."""
    found = Rd.index_records(csv_library(read, "records"), {}, ["no_name", "n_name"])
    return found.select("lib", "row_idx", "name", F.array_join("filled_fields", "|").alias("filled"), F.col("fields")["note"].alias("comment"))


@query("library_files", "SELECT 'countries' AS lib, 'utf-8-sig' AS charset, count(*) AS n_rows, 'n_name|note|n_regionkey' AS columns FROM nation")
def library_files(read):
    files, _ = Rd.index_files(csv_library(read, "files"), {})
    return files.select("lib", "charset", "n_rows", F.array_join("columns", "|").alias("columns"))


@query("library_stats", "SELECT 'countries' AS lib, count(*) AS n, count(*) AS named FROM nation")
def library_stats(read):
    return Rd.index_stats(Rd.index_records(csv_library(read, "stats"), {}, ["n_name"]))


@query("jsonl_round_trip", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS text FROM conversations")
def jsonl_round_trip(read):
    """JSON lines, nulls written out, non-ASCII kept."""
    rows = read("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))
    path = scratch(rows.sparkSession, "lines")
    Si.write_jsonl(rows, path)
    return Rd.jsonl(rows.sparkSession, path, rows.schema)


@query("merged_lines", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE turn < 3 GROUP BY conv_id")
def merged_lines(read):
    """Files in order; the last row of a key wins."""
    rows = read("conversations").where("turn < 3").select("conv_id", "text", "turn")
    path = scratch(rows.sparkSession, "merged")
    for turn in range(3):
        rows.where(F.col("turn") == turn).write.json(f"{path}/{turn}")
    return Rd.merged_jsonl(rows.sparkSession, [f"{path}/{turn}" for turn in range(3)], "conv_id BIGINT, text STRING", "conv_id")


@query("word_list_file", "SELECT DISTINCT n_name AS term FROM nation WHERE length(n_name) >= 6")
def word_list_file(read):
    """A word file with comments, blanks and white space around words."""
    spark = read("nation").sparkSession
    path = scratch(spark, "words")
    lines = read("nation").select(F.explode(F.array(F.concat(F.lit("  "), "n_name", F.lit("\t")), F.lit("# note"), F.lit(""), F.col("n_name"))).alias("value"))
    lines.write.text(path)
    return Rd.word_list(spark, path, least=6)


@query("shard_files", "SELECT ((row_number() OVER (ORDER BY conv_id, turn) - 1) // 14)::INT AS shard, conv_id, turn FROM conversations WHERE text != '' AND turn < 2")
def shard_files(read):
    rows = read("conversations").where("turn < 2").select("conv_id", "turn", F.col("text").alias("output"))
    path = scratch(rows.sparkSession, "shards")
    Si.write_shards(rows, path, [F.col("conv_id"), F.col("turn")], 14)
    return rows.sparkSession.read.schema("conv_id BIGINT, turn BIGINT, output STRING, shard INT").json(path).select("shard", "conv_id", "turn")


@query("query_log", "SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END::INT AS freq, 'q' || doc_id AS text FROM documents")
def query_log(read):
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("[频次:"), (F.col("doc_id") % 50).cast("string"), F.lit("] ")))
    return Rd.query_log(read("documents").select(F.concat(mark, F.lit("q"), F.col("doc_id").cast("string")).alias("value")))


@query("kpi_file", "SELECT 'docs' AS metric_id, lang AS field, count(*)::DOUBLE AS value FROM documents GROUP BY lang UNION ALL SELECT 'old', 'kept', 1.0")
def kpi_file(read):
    spark = read("nation").sparkSession
    path = scratch(spark, "kpi")
    Si.write_kpi(spark.createDataFrame([], "metric_id string, field string, value double"), spark.createDataFrame([("old", "kept", 1.0), ("docs", "en", -1.0)], "metric_id string, field string, value double"), path)
    new = read("documents").groupBy("lang").agg(F.count("*").cast("double").alias("value")).select(F.lit("docs").alias("metric_id"), F.col("lang").alias("field"), "value")
    Si.write_kpi(Si.read_kpi(spark, path), new, path)
    return Si.read_kpi(spark, path)




# --- scores, selection, pools, streams ---

SCORE_SQL = TOKENS_SQL.replace("translate(text, '()', '')", "text")


@query("readability_score", rf"""
SELECT doc_id, coalesce(n, 0) AS n_scored, {rate_sql('passed', 'n')} AS strict, {rate_sql('passed', 'n')} AS lenient, {rate_sql('passed', 'n')} AS glossed, CASE WHEN n > 0 THEN 100.0::DOUBLE * terms / n ELSE 0.0::DOUBLE END AS term_density,
       chars::BIGINT AS n_chars, sentences::BIGINT AS n_sentences, CASE WHEN sentences > 0 THEN chars::DOUBLE / sentences ELSE 0.0::DOUBLE END AS mean_sentence
FROM (SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS chars, len(list_filter(regexp_split_to_array(text, '[。！？；\n!?;]+'), lambda s: length(regexp_replace(s, '\s', '', 'g')) > 0)) AS sentences FROM documents)
LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(token IN ('kg', 'the', 'of', 'and')) AS passed, count_if(token IN ('tionally', 'tion', 'lich', 'ción', 'eau')) AS terms FROM {SCORE_SQL} WHERE regexp_matches(token, '^[A-Za-z]') GROUP BY doc_id) USING (doc_id)""")
def readability_score(read):
    """All scores. No bracket of the test texts glosses a word, and they hold no dates, so the SQL leaves both out."""
    d = spread(read("documents"))
    return d.select("doc_id", readability(d.sparkSession, F.col("text"), LEXICON, failures=False).alias("s")).select("doc_id", "s.n_scored", "s.strict", "s.lenient", "s.glossed", "s.term_density", "s.n_chars", "s.n_sentences", "s.mean_sentence")


CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[ \t\x{3000}]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("select_candidates", rf"""
SELECT scenario, record_id, length(t)::INT AS n_chars, match AS elder_match
FROM (SELECT *, CASE WHEN contains(name, 'tion') THEN 'name:tion' WHEN contains(name, 'lich') THEN 'name:lich' WHEN contains(t, 'tion') THEN 'text:tion' WHEN contains(t, 'lich') THEN 'text:lich' ELSE '' END AS match
      FROM (SELECT CASE source WHEN 'src0' THEN 'first' ELSE 'second' END AS scenario, doc_id::VARCHAR AS record_id, substr(text, 1, 20) AS name, {CLEAN_SQL} AS t FROM documents WHERE source IN ('src0', 'src1') AND doc_id % 5 != 0))
WHERE match != '' AND length(t) BETWEEN 40 AND 1200 AND NOT contains(name, 'The') AND NOT contains(substr(t, 1, 160), 'http') AND NOT (scenario = 'second' AND contains(name, 'Der'))""")
def select_candidates(read):
    """Candidates of two scenarios by rules over a corpus: fields filled and cleaned, length, population, names, relevance, first rule wins."""
    d = read("documents")
    corpus = d.select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("lib"), F.lit("t").alias("logical"), F.lit(0).alias("row_idx"), F.substring("text", 1, 20).alias("name"), F.create_map(F.lit("body"), F.col("text")).alias("fields"))
    ids = d.where("doc_id % 5 != 0").select(F.col("doc_id").cast("string").alias("record_id"))
    rules = [Sl.SourceRule("first", "src0", "t", ("body",)), Sl.SourceRule("first", "src0", "t", ("body",)), Sl.SourceRule("second", "src1", "t", ("body",))]
    spec = Sl.SelectionSpec(labels={}, terms=("tion", "lich"), stop_population=("The",), strong_child=("http",), excluded_names={"second": ("Der",)})
    return Sl.once_over_scenarios(Sl.select_candidates(corpus, ids, rules, spec), ["first", "second"]).select("scenario", "record_id", "n_chars", "elder_match")


PERSONA = Sl.PersonaSpec(ages=tuple(f"a{i}" for i in range(9)), genders=("m", "w"), education=("e0", "e1", "e2"), living=("alone", "family"), helpers=("none", "nurse", "spouse"), conditions={"sting": "C1", "ti": "C2", "er": "C3"}, generic=("er",), fallback=("F0", "F1"), replace={("alone", "spouse"): "neighbour"})


@query("personas", f"""
SELECT record_id, 'a' || (h + i) % 9 AS age, CASE (h >> 3) % 2 WHEN 0 THEN 'm' ELSE 'w' END AS gender, 'e' || (h >> 5) % 3 AS education, living, CASE WHEN living = 'alone' AND helper = 'spouse' THEN 'neighbour' ELSE helper END AS helper,
       CASE WHEN s = 0 AND t = 0 THEN CASE WHEN contains(name, 'er') THEN 'C3' ELSE 'F' || (h >> 11) % 2 END WHEN t = 0 OR (s > 0 AND s <= t) THEN 'C1' ELSE 'C2' END AS condition
FROM (SELECT *, CASE (h >> 7) % 2 WHEN 0 THEN 'alone' ELSE 'family' END AS living, ['none', 'nurse', 'spouse'][((h >> 17) % 3 + 1)::INT] AS helper, strpos(name, 'sting') AS s, strpos(name, 'ti') AS t
      FROM (SELECT doc_id::VARCHAR AS record_id, doc_id % 4 AS i, substr(text, 1, 60) AS name, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT AS h FROM documents))""")
def personas(read):
    rows = read("documents").select(F.col("doc_id").cast("string").alias("record_id"), (F.col("doc_id") % 4).alias("i"), F.substring("text", 1, 60).alias("name"))
    return rows.select("record_id", Sl.persona(F.col("record_id"), F.col("i"), F.col("name"), F.lit(""), PERSONA).alias("p")).select("record_id", "p.*")


@query("run_rollup", f"""
WITH c AS (SELECT case_id AS id, {A} AS a, length(source_text) AS src FROM {PAIRS_SQL} WHERE {A} % 7 != 0),
r AS (SELECT *, (a % 100)::DOUBLE / 100 AS strict, (a % 90)::DOUBLE / 90 AS source, a % 50 + 1 AS n, a % 3 != 0 AS judged, a % 2 = 0 AS faithful, a % 5 = 0 AS violated FROM c),
t AS (SELECT *, unnest(list_filter(['overall', CASE WHEN source < 0.9 THEN 'headroom' END, CASE WHEN a % 4 = 0 THEN 'hard' END, 'scenario:s' || a % 2], lambda x: x IS NOT NULL)) AS part FROM r)
SELECT part, count(*) AS n, round(avg(strict), 9) AS strict_case_mean, round(sum(strict * n) / sum(n), 9) AS strict_micro, count_if(strict >= 0.9) AS passed, count_if(judged) AS judged, count_if(judged AND faithful AND NOT violated) AS guarded, count_if(judged AND violated) AS violations,
       round({rate_sql('count_if(judged AND faithful AND NOT violated)', 'count_if(judged)')}, 9) AS guard_rate
FROM t GROUP BY part""")
def run_rollup(read):
    """Cases, outputs and a judge's rows to a row a case, and that to the headline of a run."""
    a = planted(F.col("case_id"))
    cases = pairs(read).select(F.col("case_id").alias("id"), F.concat(F.lit("s"), (a % 2).cast("string")).alias("scenario"), F.when(a % 4 == 0, "难").otherwise("易").alias("difficulty"), "source_text", ((a % 90).cast("double") / 90).alias("src_readability"), a.alias("a"))
    outputs = pairs(read).select(F.col("case_id").alias("id"), F.when(a % 7 != 0, F.col("answer")).alias("output"))
    judged = pairs(read).where(a % 3 != 0).select(F.col("case_id").alias("id"), (a % 2 == 0).alias("faithful_overall"), F.when(a % 5 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("violated_indices"), F.lit(False).alias("fabrication_extra"), F.lit(1).alias("key_points_covered"), F.lit(2).alias("key_points_total"))
    strict = (F.col("a") % 100).cast("double") / 100
    scores = F.struct(strict.alias("strict"), strict.alias("glossed"), strict.alias("lenient"), F.length("output").alias("n_chars"), (F.col("a") % 50 + 1).alias("n_scored"))
    out = Ev.rollup_run(Ev.per_case(cases, outputs, judged, scores))
    return out.select("part", "n", r9("strict_case_mean"), r9("strict_micro"), "passed", "judged", "guarded", "violations", r9("guard_rate"))


@query("judged_arms", f"SELECT case_id AS id, judge FROM {PAIRS_SQL}, unnest(range(2)) j(judge) WHERE {A} % 3 != 0 AND {A} % 5 != 0")
def judged_arms(read):
    a, cases = planted(F.col("case_id")), pairs(read).select(F.col("case_id").alias("id"))
    arm = lambda k: pairs(read).select(F.col("case_id").alias("id"), F.when(a % k != 0, F.col("answer")).alias("output"))
    from ..operators.joins import arms

    return arms(cases, arm(3), arm(5), 2).select("id", F.col("judge").cast("long").alias("judge"))


@query("applied_labels", f"SELECT case_id, substr(answer, 1, 4) AS candidate_text, {A} % 2 = 0 AS label FROM {PAIRS_SQL} WHERE {A} % 3 = 0")
def applied_labels(read):
    from ..operators.candidates import apply_labels

    a = planted(F.col("case_id"))
    judged = pairs(read).where(a % 3 == 0).select(F.col("case_id").alias("id"), (a % 2 == 0).alias("violated"))
    return apply_labels(pairs(read).select(F.col("case_id").alias("id"), "case_id", F.substring("answer", 1, 4).alias("candidate_text")), judged).select("case_id", "candidate_text", "label")


@query("missed_instances", f"SELECT case_id, 2 AS idx FROM {PAIRS_SQL} WHERE {A} % 4 = 0 AND {A} % 3 != 0")
def missed_instances(read):
    a = planted(F.col("case_id"))
    cases = pairs(read).select("case_id", F.array(F.struct(F.lit(2).alias("idx"), (a % 4 == 0).alias("violated")), F.struct(F.lit(1).alias("idx"), F.lit(True).alias("violated"))).alias("red_lines"))
    return Ev.missed_instances(cases, pairs(read).where(a % 3 == 0)).select("case_id", F.col("r.idx").alias("idx"))


@query("leakage_problems", "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'in another pool' ELSE 'in no pool' END AS rule, CASE WHEN doc_id % 10 = 1 THEN 'train' ELSE '' END AS detail FROM documents WHERE doc_id % 10 IN (1, 2)")
def leakage_problems(read):
    used = read("documents").select(F.col("doc_id").alias("record_id"))
    splits = used.where("record_id % 10 != 2").withColumn("pool", F.when(F.col("record_id") % 10 == 1, "train").otherwise("test"))
    return Ck.leakage_problems(used, splits, "test")


@query("coverage_problems", "SELECT lang AS id, 'not covered' AS rule, '' AS detail FROM (VALUES ('en'), ('xx'), ('yy')) v(lang) WHERE lang NOT IN (SELECT lang FROM documents)")
def coverage_problems(read):
    want = read("nation").sparkSession.createDataFrame([("en",), ("xx",), ("yy",)], "lang string")
    return Ck.coverage_problems(read("documents"), want, "lang")


@query("flag_problems", f"SELECT case_id AS id, 'banned:tion' AS rule, '' AS detail FROM {PAIRS_SQL} WHERE contains(source_text, 'tion') UNION ALL SELECT case_id, 'simulated without note', '' FROM {PAIRS_SQL} WHERE {A} % 6 = 0")
def flag_problems(read):
    a = planted(F.col("case_id"))
    cases = pairs(read).select(F.col("case_id").alias("id"), F.col("source_text").alias("query"), (a % 2 == 0).alias("simulated"), F.when(a % 3 != 0, "note").alias("simulated_note"))
    return Ck.flag_problems(cases, ["tion"])


HAN_DIGITS = "零一二三四五六七八九"


def han(column):
    """A number in Han digits, as the test tables have no Han text."""
    return F.translate(column.cast("string"), "0123456789", HAN_DIGITS)


def han_sql(x: str) -> str:
    return f"translate(({x})::VARCHAR, '0123456789', '{HAN_DIGITS}')"


@query("char_positions", f"""
SELECT char, min(line) AS line, arg_min(place, line * 1000 + place) AS place
FROM (SELECT doc_id AS line, unnest(string_split({han_sql('doc_id')}, '')) AS char, generate_subscripts(string_split({han_sql('doc_id')}, ''), 1)::INT - 1 AS place FROM documents WHERE doc_id % 5 != 0)
GROUP BY char""")
def char_positions(read):
    """Where each character stands first in a list of one line a document; every fifth line is a comment."""
    lines = read("documents").select(F.col("doc_id").alias("line"), F.concat(F.when(F.col("doc_id") % 5 == 0, "# ").otherwise(""), han(F.col("doc_id")), F.lit(" x")).alias("value"))
    return Se.char_list(lines).select("char", "position.line", F.col("position.at").alias("place"))


@query("sectioned_words", f"""
WITH l AS (SELECT source, doc_id, CASE WHEN doc_id // 20 % 4 = 0 THEN CASE WHEN doc_id // 20 % 8 = 0 THEN '甲' ELSE '乙' END END AS head FROM documents),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id) AS section FROM l)
SELECT DISTINCT unnest([{han_sql('doc_id')}, {han_sql('doc_id * 3')}]) AS word FROM s WHERE head IS NULL AND section = '甲'""")
def sectioned_words(read):
    """Words of the kept sections of one list a source; a header holds until the next one."""
    i = F.col("doc_id")
    part = F.expr("doc_id DIV 20")
    head = F.concat(F.when(part % 8 == 0, "甲").otherwise("乙"), F.lit("级词汇表"))
    value = F.when(part % 4 == 0, head).otherwise(F.concat(F.lit("1 "), han(i), F.lit("（注）/"), han(i * 3)))
    return Se.sectioned_vocabulary(read("documents").select("source", i.alias("line"), value.alias("value")), r"^(.)级词汇表$", ["甲"], by="source")


@query("harvested_terms", f"""
WITH t AS (SELECT {han_sql('doc_id + 10')} || '片' AS term, true AS formal FROM documents UNION ALL SELECT unnest([{han_sql('doc_id * 7 + 10')}, {han_sql('doc_id + 10')} || '片']), false FROM documents),
g AS (SELECT term, bool_or(formal) AS formal FROM t GROUP BY term)
SELECT term, formal FROM g
WHERE NOT (NOT formal AND length(term) <= 4 AND regexp_full_match(term, '[一二三四]+')) AND term NOT IN (SELECT {han_sql('doc_id + 10')} || '片' FROM documents WHERE doc_id % 10 = 3)""")
def harvested_terms(read):
    """Terms of two columns; colloquial ones (alias only, short, of common characters) and excluded ones are left out."""
    i = F.col("doc_id")
    d = read("documents")
    formal = F.concat(han(i + 10), F.lit("片"))
    rows = d.select(formal.alias("name"), F.concat(han(i * 7 + 10), F.lit("(别名)，"), formal).alias("alias"))
    common = d.sparkSession.createDataFrame([(c,) for c in "一二三四"], "char string")
    return Se.harvest_terms(rows, ["name"], ["alias"], d.where(i % 10 == 3).select(formal.alias("term")), common)


@query("best_probe", """
SELECT arg_max(probe, {'j': j, 'p': probe}) AS probe, max(j) >= 0.3 AS beats
FROM (SELECT probe, round(abs(coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0)), 9) AS j
      FROM (SELECT probe, count_if(label AND hit)::DOUBLE AS tp, count_if(NOT label AND hit)::DOUBLE AS fp, count_if(label AND NOT hit)::DOUBLE AS fn, count_if(NOT label AND NOT hit)::DOUBLE AS tn
            FROM (SELECT quality = 0 AS label, unnest(['shouting', 'short', 'even']) AS probe, unnest([contains(text, '!!'), n_chars < 300, doc_id % 2 = 0]) AS hit FROM labels JOIN documents USING (doc_id)) GROUP BY probe))
WHERE probe IN ('shouting', 'short')""")
def best_probe(read):
    """The structural probe with the largest J, as the mark that a model has to beat."""
    from ..operators.probes import best_structural, score_probes

    rows = read("labels").join(read("documents"), "doc_id").select((F.col("quality") == 0).alias("label"), F.col("text").contains("!!").alias("shouting"), (F.col("n_chars") < 300).alias("short"), (F.col("doc_id") % 2 == 0).alias("even"))
    return best_structural(score_probes(rows, ("shouting", "short", "even"), structural=("shouting", "short"))).select("probe", (F.col("j") >= 0.3).alias("beats"))


@query("last_places", f"SELECT case_id, length(answer) - strpos(reverse(answer), reverse(substr(answer, 2, 2))) - 1 AS place FROM {PAIRS_SQL}")
def last_places(read):
    return pairs(read).select("case_id", X.last_index(F.col("answer"), F.substring("answer", 2, 2)).cast("long").alias("place"))


@query("next_ids", "SELECT count(*) AS next FROM documents")
def next_ids(read):
    from ..operators.ranges import with_rank
    from ..operators.sampling import next_start

    ids = with_rank(read("documents").select("doc_id"), [F.col("doc_id")], "k").select(F.concat(F.lit("case-"), F.col("k").cast("string")).alias("id"))
    n = next_start(ids, "id")
    return read("nation").sparkSession.createDataFrame([(n,)], "next long")


@query("positive_rule", "SELECT doc_id, toxic = 1 AS positive FROM labels")
def positive_rule(read):
    """The predicate that the rows' own JSON calls for."""
    rows = read("labels").select("doc_id", F.to_json(F.struct((F.col("toxic") == 1).alias("violated"))).alias("output"))
    return rows.select("doc_id", Rd.infer_positive(rows).alias("positive"))


@query("json_array_rows", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def json_array_rows(read):
    spark = read("nation").sparkSession
    path = scratch(spark, "array")
    rows = read("nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))).alias("value"))
    rows.coalesce(1).write.text(path)
    return spark.read.schema("k BIGINT, name STRING").option("multiLine", True).json(path)


@query("unique_lines", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def unique_lines(read):
    spark = read("nation").sparkSession
    path = scratch(spark, "unique")
    Si.write_jsonl(read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), path)
    return Rd.unique_jsonl(spark, path, "k BIGINT, name STRING", "k")


@query("resumed_work", "SELECT conv_id AS id, max(length(text))::BIGINT AS output FROM conversations WHERE turn = 0 GROUP BY conv_id")
def resumed_work(read):
    """Work over a stream of files in two runs; ids of the first run come again in the second and are skipped."""
    from ..streaming.resume import resume

    spark = read("nation").sparkSession
    root = scratch(spark, "resume")
    rows = read("conversations").where("turn = 0").select(F.col("conv_id").alias("id"), "text")
    work = lambda df: df.select("id", F.length("text").cast("long").alias("output"))
    for part in (rows.where("id % 2 = 0"), rows):
        part.write.mode("append").json(f"{root}/in")
        resume(spark, f"{root}/in", "id BIGINT, text STRING", work, f"{root}/log", f"{root}/mark").awaitTermination()
    return spark.read.parquet(f"{root}/log").select("id", "output")


@query("pending_work", "SELECT conv_id AS id FROM conversations WHERE turn = 0 AND (conv_id % 3 = 0 OR conv_id % 4 = 0)")
def pending_work(read):
    from ..streaming.resume import pending

    cases = read("conversations").where("turn = 0").select(F.col("conv_id").alias("id"))
    done = cases.select("id", F.when(F.col("id") % 3 != 0, "text").alias("output"), (F.col("id") % 4 == 0).alias("truncated"))
    return pending(cases, done)


@query("compacted_log", "SELECT conv_id AS id, max(turn) AS epoch FROM conversations GROUP BY conv_id")
def compacted_log(read):
    from ..streaming.resume import compact

    log = read("conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("epoch"))
    order = log.select("id").distinct().withColumn("position", F.col("id"))
    return compact(log, order).select("id", "epoch")


@query("sticky_budgets", "SELECT user_id::VARCHAR AS key, lpad(event_id::VARCHAR, 9, '0') AS event, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 300 AS submitted FROM events")
def sticky_budgets(read):
    """A stream's budget for each key: once it is spent, nothing of the key goes out again."""
    from ..streaming.resume import sticky_budget

    spark = read("nation").sparkSession
    root = scratch(spark, "budget")
    read("events").select(F.col("user_id").cast("string").alias("key"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("event"), F.col("value").cast("double").alias("cost")).write.json(f"{root}/in")
    stream = spark.readStream.schema("key string, event string, cost double").json(f"{root}/in")
    out = sticky_budget(stream, "key", F.col("cost"), 300.0).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("key", "event", "submitted")
