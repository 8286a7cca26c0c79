import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveworks.errors import DataContractError
from sieveworks.operators import candidates as Cd
from sieveworks.operators import checks as Ck
from sieveworks.operators import evaluate as Ev
from sieveworks.operators import joins as Jn
from sieveworks.operators import probes as Pr
from sieveworks.operators import sampling as Sm
from sieveworks.operators import selection as Sl
from sieveworks.operators import sets as Se
from sieveworks.operators import synth as Sy


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def allocate(freq, total=270, floor=15):
    """Largest remainder, dealt out one by one."""
    whole, names = max(1, sum(freq.values())), list(freq)
    exact = {n: freq[n] * (total - floor * len(names)) / whole for n in names}
    out = {n: floor + int(exact[n]) for n in names}
    order = sorted(names, key=lambda n: (-(exact[n] - int(exact[n])), n))
    i = 0
    while sum(out.values()) < total:
        out[order[i % len(order)]] += 1
        i += 1
    return out


@pytest.mark.parametrize("freq", [{"a": 0, "b": 0}, {"a": 5}, {c: i for i, c in enumerate("abcdefghijkl")}, {"a": 1, "b": 1, "c": 1, "d": 96}])
def test_allocation(spark, freq):
    got = {r["s"]: r["n"] for r in Sm.allocate(spark.createDataFrame(list(freq.items()), "s string, f long"), "s", "f", 270, 15).collect()}
    assert got == allocate(freq) and sum(got.values()) == 270 and min(got.values()) >= 15


def test_top_n(spark):
    rows = [(s, f"{s}{i}", i % 3 == 0) for s in "ab" for i in range(20)]
    got = Sm.top_n_per_stratum(spark.createDataFrame(rows, "s string, k string, hit boolean"), "s", "k", 8, "7", F.col("hit")).collect()
    for s in "ab":
        want = sorted((r for r in rows if r[0] == s), key=lambda r: (not r[2], sha(f"7:{s}:{r[1]}")))[:8]
        assert [r["k"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["rank"])] == [r[1] for r in want]


def test_quota_sample_has_the_prefix_property(spark):
    rows = spark.createDataFrame([(b, f"{b}{i}") for b in "abc" for i in range(10)], "bucket string, record_id string")
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    small, large = ({r["record_id"] for r in Sm.quota_sample(rows, "bucket", "record_id", n, shares, "s").collect()} for n in (10, 20))
    assert small < large and Counter(x[0] for x in small) == {"a": 5, "b": 3, "c": 2}
    used = spark.createDataFrame([(x,) for x in small], "record_id string")
    assert not small & {r["record_id"] for r in Sm.quota_sample(rows, "bucket", "record_id", 10, shares, "s", used).collect()}


def test_dense_ids_and_next_start(spark):
    ids = Sm.dense_ids(spark.range(1200).withColumnRenamed("id", "k"), [F.col("k")], "u")
    assert {r["id"] for r in ids.collect()} >= {"u-000", "u-999", "u-1000", "u-1199"}
    assert Sm.next_start(ids, "id") == 1200 and Sm.next_start(ids.limit(0), "id") == 0


def test_greedy_exclusive(spark):
    rows = [("small", i) for i in range(4)] + [("large", i) for i in range(30)]
    got = Sm.greedy_exclusive(spark.createDataFrame(rows, "s string, k long"), "s", "k", {"large": 10, "small": 4, "none": 3}, "x").collect()
    assert Counter(r["s"] for r in got) == {"small": 4, "large": 10} and len({r["k"] for r in got}) == 14


def test_first_and_last_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert sorted(r["v"] for r in Sm.first_wins(rows, ["k"], [F.col("o")]).collect()) == ["a", "c"]
    assert sorted(r["v"] for r in Sm.last_wins(rows, ["k"], [F.col("o")]).collect()) == ["b", "c"]


def cap(counts, share):
    while True:
        c = int(sum(counts.values()) * share)
        new = {k: min(n, c) for k, n in counts.items()}
        if new == counts:
            return {k: n for k, n in new.items() if n}
        counts = new


@pytest.mark.parametrize("counts,share", [({"a": 50, "b": 5, "c": 5}, 0.4), ({"a": 3, "b": 3}, 0.05), ({chr(97 + i): 4 for i in range(26)}, 0.05), ({"a": 100, **{chr(98 + i): 2 for i in range(20)}}, 0.10)])
def test_source_cap_reaches_the_fixpoint(spark, counts, share):
    rows = spark.createDataFrame([(s, i) for s, n in counts.items() for i in range(n)], "s string, k int")
    assert Counter(r["s"] for r in Sm.cap_source_share(rows, "s", "k", share).collect()) == cap(counts, share)


def test_oversample(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, y boolean")
    assert Counter(r["k"] for r in Sm.oversample(rows, F.col("y"), 3).collect()) == {1: 3, 2: 1, 3: 1}
    assert Sm.oversample(rows, F.col("y"), 1) is rows
    with pytest.raises(ValueError):
        Sm.oversample(rows, F.col("y"), 0)


def test_budget_is_sticky(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([3.0, 3.0, None, 0.0, 5.0])], "i int, c double")
    assert [r["submitted"] for r in Sm.budget_cutoff(rows, F.col("c"), [F.col("i")], 5.0).orderBy("i").collect()] == [True, True, False, False, False]


def test_shards_keep_order(spark):
    got = Sm.shards(spark.range(100).repartition(7).withColumnRenamed("id", "k"), [F.col("k")], 14).collect()
    assert all((r["shard"], r["position"]) == divmod(r["k"], 14) for r in got) and len(got) == 100


def test_spares_serve_once(spark):
    slots = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, slot int")
    spares = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("a", "z")], "s string, key string")
    got = Sm.replace_slots(slots, spares, "s", [F.col("key")]).collect()
    keys = [r["key"] for r in got]
    assert len(got) == 3 and len(set(keys)) == 3


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts, terms = [(i, word(rng.randint(0, 20))) for i in range(60)], sorted({word(rng.randint(1, 4)) for _ in range(30)})
    terms, brute = [*terms, "é\U0001f600"], lambda keep: sorted((i, w) for i, t in texts for w in terms if w in (t or "") and keep(i, w))
    texts += [(60, None), (61, "x é\U0001f600é"), (62, "a" * 5000)]
    other = {i: word(6) for i, _ in texts}
    df = spark.createDataFrame([(i, t, other[i]) for i, t in texts], "key int, text string, other string")
    named = spark.createDataFrame([(t,) for t in [*terms, terms[0], ""]], "term string")
    for how in ({}, {"part_bytes": 200}, {"most_bytes": 0}):  # one automaton, several, substrings
        got = Jn.contains_join(df, named, **how).collect()
        assert sorted((r["key"], r["term"]) for r in got) == brute(lambda i, w: True)
        got = Jn.contains_join(df, named, unless="other", **how).collect()
        assert sorted((r["key"], r["term"]) for r in got) == brute(lambda i, w: w not in other[i])
    assert Jn.contains_join(df, named.where("false")).collect() == []


def test_policies_for_missing_rows(spark):
    gold = spark.createDataFrame([(1, True), (2, False)], "k int, g boolean")
    pred = spark.createDataFrame([(1, True)], "k int, p boolean")
    assert [r["missing"] for r in Jn.join_excluding_missing(gold, pred, "k").orderBy("k").collect()] == [False, True]
    assert [r["agrees"] for r in Jn.join_missing_is_wrong(gold, pred, "k", "g", "p").orderBy("k").collect()] == [True, False]
    a = spark.createDataFrame([(1, [True, True, False]), (2, [True])], "k int, g array<boolean>")
    b = spark.createDataFrame([(1, [True])], "k int, p array<boolean>")
    assert sorted(map(tuple, Jn.join_by_position(a, b, "k", "g", "p").collect())) == [(1, 0, True, True), (1, 1, True, False), (1, 2, False, False)]


def cases(spark, *rows):
    return spark.createDataFrame([(f"c{i}", s, a) for i, (s, a) in enumerate(rows)], "case_id string, source_text string, answer string")


def test_candidates(spark):
    c = cases(spark, ("不超过112", "别超过12"), ("十三天", "三天"), ("无", "三千分之一"), ("无", "一般一定"), ("维生素 C", "维生素Ｃ 和 阿司匹林"), ("10 20", "1020"))
    terms = spark.createDataFrame([("维生素Ｃ",), ("阿司匹林",)], "term string")
    got = {(r["case_id"], r["candidate_text"], r["kind"], r["red_line_guess"]) for r in Cd.extract_candidates(c, terms).collect()}
    assert got == {("c0", "12", "digit", 2), ("c1", "三天", "cn_numeral", 0), ("c2", "三千分之一", "fraction", 0), ("c4", "阿司匹林", "lexicon", 0)}
    assert {r["case_id"]: r["flag"] for r in Cd.flag_cases(c, Cd.extract_candidates(c, terms)).collect()} == {"c0": True, "c1": True, "c2": True, "c3": False, "c4": True, "c5": False}


def test_pools_partition_the_candidates(spark):
    lines = "array<struct<idx:int,violated:boolean,evidence:string>>"
    rows = [("p", "s", "a", "pass", []), ("f", "s", "a", "fail", [(2, True, "约112次"), (1, True, "12")])]
    c = spark.createDataFrame(rows, f"case_id string, source_text string, answer string, verdict string, red_lines {lines}")
    found = spark.createDataFrame([("p", "12", "digit", 2), ("f", "12", "digit", 2), ("f", "112", "digit", 2)], "case_id string, candidate_text string, kind string, red_line_guess int")
    pool = Cd.label_pool(c, found)
    assert sorted((r["case_id"], r["candidate_text"], r["label"]) for r in Cd.trusted_pool(pool).collect()) == [("f", "112", True), ("p", "12", False)]
    assert [(r["case_id"], r["candidate_text"]) for r in Cd.uncertain_pool(pool).collect()] == [("f", "12")]


def test_case_text_is_split(spark):
    s, a = Cd.split_case(F.lit("【原文】甲【回答】乙【要点】丙"))
    assert tuple(spark.range(1).select(s, a).first()) == ("甲", "乙")


def probe_rows(spark, *rows):
    return spark.createDataFrame(rows, "source_text string, answer string, candidate_text string, kind string, label boolean")


def test_probes(spark):
    rows = probe_rows(
        spark,
        ("112", "正文（补充一句：12。）", "12", "digit", True),
        ("无", "正文（补充一句：x。）随后布洛芬", "布洛芬", "lexicon", False),
        ("布洛芬", "布洛芬" + "字" * 40 + "布洛芬", "布洛芬", None, False),
        ("无", "没有", "三天", None, False),
    )
    got = [r.asDict() for r in Pr.with_probes(rows, ["（补充一句：", "（这类"], "。）").collect()]
    assert [g["inside_bracket"] for g in got] == [True, False, False, False]
    assert [g["in_tail"] for g in got] == [False, False, True, False]
    assert [g["ends_with_bracket"] for g in got] == [True, False, False, False]
    assert [g["not_grounded"] for g in got] == [True, True, False, True]
    assert [g["kind_is_lexicon"] for g in got] == [False, True, True, False]
    scores = {r["probe"]: r for r in Pr.score_probes(Pr.with_probes(rows, ["（补充一句："], "。）")).collect()}
    assert scores["inside_bracket"]["j"] == 1.0 and scores["inside_bracket"]["failed"] and not scores["not_grounded"]["failed"]
    with pytest.raises(DataContractError):
        Pr.score_probes(rows.limit(0).withColumns({p: F.lit(True) for p in Pr.PROBES}))
    with pytest.raises(DataContractError):
        Pr.check_kinds(probe_rows(spark, ("", "", "3天", "digit", True)))


SPEC = Sy.SynthSpec(
    categories={"激素": ("泼尼松", "地塞米松", "甲泼尼龙"), "降压": ("氨氯地平", "缬沙坦")},
    default=("阿司匹林", "布洛芬", "甲泼尼龙"),
    markers=("类药物", "类药"),
    number_markers=("必要时", "遵医嘱"),
    templates=("（补充一句：像{names}这类。）", "（这类药还有{names}。）"),
    phrases=("每3天复查一次", "一天吃2次", "至少2小时再服用", "每半年复查", "不超过7天", "隔4小时以上", "连服5天后复诊", "不超过2片"),
)


def test_word_pools_are_disjoint():
    for context in ("激素", "降压", None):
        assert not set(SPEC.examples(context, True)) & set(SPEC.examples(context, False))
    held = {w for c in ("激素", "降压", "") for w in SPEC.examples(c, True)}
    assert not held & {w for c in ("激素", "降压", "") for w in SPEC.examples(c, False)}


def test_synthesis(spark):
    c = cases(spark, ("激素类药物" + "。" * 15 + "降压类药，必要时复查", "注意休息 \n"), ("激素类药物与激素类药", "好"), ("激素类药，泼尼松", "好"), ("普通", "好"))
    got = Sy.synthesize(c, SPEC, source_share=None).collect()
    by = Counter(r["source_case_id"] for r in got)
    assert by == {"c0": 3, "c1": 1}
    for r in got:
        assert r["synthetic_answer"].startswith(("注意休息\n\n（", "好\n\n（")) and r["verdict"] == "fail"
        assert all(Sy.normal(x) not in Sy.normal(r["source_text"]) for x in r["injected_examples"] if r["red_line_idx"] == 0)
    assert {r["case_id"] for r in got} == {"c0-synth", "c0-synth2", "c0-synthnum", "c1-synth"}
    assert Sy.to_candidates(Sy.synthesize(c, SPEC, source_share=None)).where("label").count() == sum(len(r["injected_examples"]) for r in got)


def test_negatives_are_supported(spark):
    c = cases(spark, ("每3天用缬沙坦", "好"), ("保泰松0.2克", "好"), ("共三天", "好"), ("每12天一针", "好"))
    rows = Sy.injection_negatives(c, SPEC, ["缬沙坦", "沙坦", "水果"]).collect()
    by = {(r["case_id"], r["flavor"]): r for r in rows}
    assert by["c0", "grounded"]["candidate_text"] == "缬沙坦" and by["c3", "grounded_number"]["candidate_text"] == "12"
    assert ("c0", "grounded_number") not in by  # its other spelling is taken
    assert by["c0", "equivalent"]["candidate_text"] == "三天" and by["c2", "equivalent"]["candidate_text"] == "3"
    assert not any(k[0] == "c1" for k in by) and not any(r["label"] for r in rows)
    for r in rows:
        assert Sy.supported(r["answer"].split("\n\n")[1], Sy.normal(r["source_text"]), forms=r["flavor"] == "equivalent")


def test_confusion_and_mixed(spark):
    rows = spark.createDataFrame([("a", True, True, 0), ("a", False, True, 0), ("b", True, None, 2), ("c", False, False, 2)], "g string, y boolean, f boolean, line int")
    got = {r["slice"]: r for r in Ev.confusion_slices(rows, F.col("y"), F.col("f"), {"overall": F.lit(True), "line 2": F.col("line") == 2, "never": F.lit(False)}).collect()}
    assert set(got) == {"overall", "line 2"}
    assert tuple(got["overall"][c] for c in ("tp", "fp", "fn", "tn")) == (1, 1, 1, 1) and got["line 2"]["miss_rate"] == 1.0
    assert [tuple(r) for r in Ev.mixed_groups(rows, "g", F.col("y"), F.col("f")).select("g", "all_correct").collect()] == [("a", False)]


def test_quantiles_are_positional(spark):
    got = Ev.positional_quantile(spark.range(10).selectExpr("1 AS g", "id AS v"), ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (got["n"], got["p50"], got["p90"]) == (10, 5, 9)


def verdict(spark, **kw):
    row = {"real_miss": 0.02, "real_fa": 0.1, "real_positives": 100, "adv_miss": 0.02, "adv_positives": 60, "missing_share": 0.0} | kw
    types = ", ".join(f"{k} {'long' if k.endswith('positives') else 'double'}" for k in row)
    return Ev.gate_verdict(spark.createDataFrame([tuple(row.values())], types)).first()


def test_gates(spark):
    assert verdict(spark)["verdict"] == "pass"
    assert verdict(spark, real_miss=0.04, adv_miss=0.5)["verdict"] == "pass"
    assert verdict(spark, real_miss=0.2, adv_miss=0.01)["reasons"] == ["missed positives", "real rows are missed more than adversarial ones"]
    assert verdict(spark, missing_share=0.02)["verdict"] == verdict(spark, adv_positives=49)["verdict"] == "no conclusion"


def test_votes(spark):
    v = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "?"), (2, None)], "k int, overall string")
    assert tuple(Ev.vote_tallies(v, ["overall"]).first()) == ("overall", 2, 1, 2)
    assert {r["winner"]: r["cases"] for r in Ev.case_majority(v, "k", "overall").collect()} == {"A": 1, "tie": 1}
    assert [r[0] for r in v.select(Ev.unswap(F.col("overall"), F.lit(True))).collect()] == ["B", "B", "A", "?", None]


def test_kpi_upsert(spark):
    of = lambda rows: spark.createDataFrame(rows, "metric_id string, field string, value double")
    old, new = of([("a", "x", 1.0), ("b", "x", 2.0)]), of([("a", "x", 3.0)])
    once = Ev.upsert_kpi(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, Ev.upsert_kpi(once, new).collect())) == [("a", "x", 3.0), ("b", "x", 2.0)]
    assert sorted(map(tuple, Ev.upsert_kpi(old, new.limit(0)).collect())) == sorted(map(tuple, old.collect()))


def test_run_rollup(spark):
    scores = F.struct(F.lit(0.95).alias("strict"), F.lit(0.95).alias("glossed"), F.lit(0.99).alias("lenient"), F.lit(10).alias("n_chars"), F.lit(5).alias("n_scored"))
    c = spark.createDataFrame([("1", "s", "难", "原文原文", 0.5), ("2", "t", "易", "原文", 0.95), ("3", "t", "易", "原文", 0.9)], "id string, scenario string, difficulty string, source_text string, src_readability double")
    o = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "")], "id string, output string")
    j = spark.createDataFrame([("1", True, [], False, 2, 3)], "id string, faithful_overall boolean, violated_indices array<int>, fabrication_extra boolean, key_points_covered int, key_points_total int")
    got = {r["part"]: r for r in Ev.rollup_run(Ev.per_case(c, o, j, scores)).collect()}
    assert got["overall"]["n"] == 2 and got["overall"]["guard_rate"] == 1.0 and got["hard"]["n"] == got["headroom"]["n"] == 1 and got["scenario:t"]["judged"] == 0
    assert got["overall"]["coverage"] == pytest.approx(2 / 3) and got["headroom"]["net_gain"] == pytest.approx(0.45)


CASE = {"id": "1", "scenario": "s", "parent_class": "p", "query": "a long question", "source_text": "text", "key_points": ["a", "b"], "negative_rubric": ["a", "b"], "difficulty": "易", "targets_failure_mode": "m", "provenance": ("r1",)}
CASE_DDL = "id string, scenario string, parent_class string, query string, source_text string, key_points array<string>, negative_rubric array<string>, difficulty string, targets_failure_mode string, provenance struct<record_id:string>"


@pytest.mark.parametrize("change,rule", [({"query": "short"}, "short query"), ({"query": "text of it", "source_text": "the text of it all"}, "query in source"), ({"parent_class": "q"}, "parent"), ({"difficulty": "?"}, "difficulty"), ({"key_points": ["a"]}, "key points"), ({"targets_failure_mode": None}, "failure mode"), ({"source_text": " "}, "required:source_text")])
def test_case_defects_are_reported(spark, change, rule):
    of = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], CASE_DDL)
    args = (["id", "source_text", "key_points"], {"s": "p"}, ["易", "中", "难"], ["m"])
    assert Ck.case_problems(of(CASE), *args).collect() == []
    assert rule in {r["rule"] for r in Ck.case_problems(of(CASE | change), *args).collect()}


def test_repeated_cases_and_shares(spark):
    rows = spark.createDataFrame([tuple(CASE.values())] * 2, CASE_DDL)
    got = {r["rule"] for r in Ck.case_problems(rows, ["id"], {"s": "p"}, ["易"], ["m"], per_scenario={"s": 1}, targets={"易": 0.4, "难": 0.6}).collect()}
    assert got == {"repeated id", "repeated record", "scenario count", "difficulty share"}


def test_label_defects_are_reported(spark):
    c = spark.createDataFrame([("1", "source", "answer", ["k"], ["r"])], "case_id string, source_text string, answer string, key_points array<string>, red_lines array<string>")
    ddl = "case_id string, key_points array<struct<idx:int,covered:boolean,evidence:string>>, red_lines array<struct<idx:int,violated:boolean,evidence:string>>, verdict string"
    rules = lambda *row: {r["rule"] for r in Ck.label_problems(spark.createDataFrame([row], ddl), c).collect()}
    assert rules("1", [(0, True, "sour")], [(0, False, "")], "pass") == set()
    assert rules("1", [(1, None, "nowhere")], [], "maybe") == {"key point order", "flag is missing", "evidence is not in the texts", "red line count", "verdict"}
    assert rules("9", [], [], "pass") == {"unknown case"}


def test_audit_never_crashes(spark):
    good = '{"key_points": [{"idx": 0, "covered": true, "evidence": "sour"}], "red_lines": [], "verdict": "pass"}'
    raw = [good, f"```json\n{good}\n```", good[:-5], '{"key_points": {"a": 1}, "red_lines": [], "verdict": "pass"}', good.replace("true", '"true"'), "", None]
    rows = spark.createDataFrame([(r, 1, 0, "source", "answer") for r in raw], "raw string, n_points int, n_lines int, source_text string, answer string")
    got = Ck.audit_predictions(rows).collect()
    assert [r["schema_ok"] for r in got] == [True, True, False, False, False, False, False]
    assert [r["parse_failed"] for r in got][2] and not got[0]["parse_failed"]
    s = Ck.audit_summary(Ck.audit_predictions(rows.limit(2))).first()
    assert (s["n"], s["parse_failed"], s["evidence"], s["evidence_grounded"]) == (2, 0, 2, 2)


def test_sets(spark):
    of = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    assert Se.same_set(of("a", "b", "b"), of("b", "a")) and not Se.same_set(of("a"), of("b"))
    with pytest.raises(DataContractError):
        Se.demand_same(of("a"), of("b"), "tables")
    lines = spark.createDataFrame([(0, "# 注 释"), (1, "天地 天"), (2, "人地")], "line int, value string")
    assert [r["char"] for r in Se.char_list(lines).orderBy("position").collect()] == ["天", "地", "人"]
    book = spark.createDataFrame(list(enumerate(["一级词汇表", "1 爱", "2 八/九（数）", "七级词汇表", "3 难词", "二级词汇表", "4 好 x"])), "line int, value string")
    assert {r["word"] for r in Se.sectioned_vocabulary(book, "^(.级)词汇表$", ["一级", "二级"]).collect()} == {"爱", "八", "九"}


def test_harvest(spark):
    rows = spark.createDataFrame([("高血压,甲亢", "血压高"), ("糖尿病（二型）", "消渴症,高血压")], "formal string, alias string")
    chars = spark.createDataFrame([(c,) for c in "血压高"], "char string")
    got = {r["term"] for r in Se.harvest_terms(rows, ["formal"], ["alias"], spark.createDataFrame([("甲亢",)], "term string"), chars).collect()}
    assert got == {"高血压", "糖尿病", "消渴症"}


def test_selection(spark):
    rows = [("r1", "L", "t", 0, "高血压", {"a": "字" * 30, "b": "文" * 30}), ("r2", "L", "t", 1, "感冒", {"a": "字" * 60, "b": ""}), ("r3", "L", "t", 2, "儿童高血压", {"a": "字" * 60, "b": "x"}), ("r4", "L", "u", 0, "无", {"a": "高血压" + "字" * 60, "b": "x"}), ("r5", "L", "t", 3, "高血压", {"a": "字" * 60, "b": "x"})]
    corpus = spark.createDataFrame(rows, "record_id string, lib string, logical string, row_idx int, name string, fields map<string,string>")
    ids = spark.createDataFrame([(f"r{i}",) for i in range(1, 5)], "record_id string")
    spec = Sl.SelectionSpec(labels={"a": "甲"}, terms=("高血压",), stop_population=("儿童",))
    rules = [Sl.SourceRule("s", "L", "t", ("a", "b")), Sl.SourceRule("s", "L", "t", ("a",)), Sl.SourceRule("z", "L", "u", ("a",), thin=True)]
    got = {(r["scenario"], r["record_id"]): r for r in Sl.select_candidates(corpus, ids, rules, spec).collect()}
    assert set(got) == {("s", "r1"), ("z", "r4")}
    assert got["s", "r1"]["source_text"].startswith("甲：字") and got["s", "r1"]["elder_match"] == "name:高血压" and got["z", "r4"]["thin_source"]


def test_persona(spark):
    spec = Sl.PersonaSpec(ages=("60", "70"), genders=("男", "女"), education=("a", "b"), living=("home", "nursing"), helpers=("spouse", "child"), conditions={"血压": "高血压", "高血压危象": "危象", "病": "病"}, generic=("病",), fallback=("x", "y"), male=("前列腺",), replace={("nursing", "spouse"): "carer"})
    rows = spark.createDataFrame([("r1", 0, "前列腺病", "name:病"), ("r2", 1, "高血压危象血压", ""), ("r3", 2, "无", "text:血压"), ("r4", 3, "无", "")], "record_id string, i int, name string, m string")
    got = [r["p"] for r in rows.select(Sl.persona(F.col("record_id"), F.col("i"), F.col("name"), F.col("m"), spec).alias("p")).collect()]
    for i, p in enumerate(got):
        h = int(sha(f"r{i + 1}")[:12], 16)
        assert p["age"] == spec.ages[(h + i) % 2] and p["education"] == spec.education[(h >> 5) % 2]
        assert not (p["living"] == "nursing" and p["helper"] == "spouse")
    assert got[0]["gender"] == "男" and [p["condition"] for p in got[:3]] == ["病", "危象", "高血压"] and got[3]["condition"] in ("x", "y")


def test_twister_and_places_equal_the_known_generator():
    for seed in [0, 1, 7, 42, 2026, 20260810, 2**32 - 1, 2**32, 2**70 + 5, -9]:
        rng, own = random.Random(seed), Sm.Twister(seed)
        assert [own.bits(k) for k in (1, 7, 32, 33, 64, 100)] == [rng.getrandbits(k) for k in (1, 7, 32, 33, 64, 100)]
        for population, n in [(1, 1), (5, 5), (21, 5), (22, 5), (30, 6), (85, 6), (100, 90), (1000, 3), (5000, 400), (10**9, 50), (7, 0)]:
            assert Sm.sample_places(population, n, seed) == random.Random(seed).sample(range(population), n)
    with pytest.raises(ValueError):
        Sm.sample_places(3, 4, 1)


def test_seeded_sample_equals_the_known_one(spark):
    keys = [f"case-{i * 7919 % 1000:03d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "id string").repartition(5)
    for seed, n in [(1, 12), (2026, 60), (5, 299), (9, 0)]:
        got = [r["id"] for r in Sm.seeded_sample(df, "id", n, seed).orderBy("draw").collect()]
        assert got == random.Random(seed).sample(sorted(keys), n)


def test_one_budget_over_ranges_equals_one_pass(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 20)) if i % 11 else None) for i in range(2000)]
    got = {r["id"]: (r["spent_before"], r["submitted"]) for r in Sm.budget_cutoff(spark.createDataFrame(rows, "id long, cost double").repartition(6), F.col("cost"), [F.col("id")], 900.0).collect()}
    spent = 0.0
    for i, c in rows:
        assert got[i] == (spent, spent <= 900)
        spent += c or 0.0
