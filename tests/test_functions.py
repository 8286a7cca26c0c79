import difflib
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sieveworks.errors import DataContractError
from sieveworks.functions import hashing as H
from sieveworks.functions import lexical as L
from sieveworks.functions import stats as S
from sieveworks.functions import text as X

LEX = L.Lexicon(chars=frozenset("每天吃药一次多喝水我你他好的了请"), more_chars=frozenset("疗程"), terms=frozenset({"阿司匹林", "匹林", "高血压", "每天吃"}), units=frozenset({"毫克", "疗程"}), common=frozenset({"血压"}))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_split_is_stable_and_near_its_shares(spark):
    shares = [("test", 20), ("verifier_train", 60), ("reserve", 20)]
    rows = spark.range(5000).select("id", H.split_pool("20260810", F.col("id"), shares).alias("a"), H.split_pool("1", F.col("id"), shares).alias("b")).collect()
    for r in rows[:200]:
        b = int(hashlib.sha256(f"20260810:{r['id']}".encode()).hexdigest()[:8], 16) % 100
        assert r["a"] == ("test" if b < 20 else "verifier_train" if b < 80 else "reserve")
    assert any(r["a"] != r["b"] for r in rows)
    assert abs(sum(r["a"] == "test" for r in rows) / 5000 - 0.2) < 0.03


def test_digest_mod(spark):
    for r in spark.range(50).select("id", *[H.digest_mod(F.sha2(F.col("id").cast("string").cast("binary"), 256), k).alias(f"k{k}") for k in (3, 5, 8)]).collect():
        whole = int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16)
        assert [r["k3"], r["k5"], r["k8"]] == [whole % 3, whole % 5, whole % 8]


def test_content_hash_ignores_order_only(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    of = lambda x: H.content_hash(spark.createDataFrame(x, "id int, v string"), "id", ["id", "v"]).first()["content_hash"]
    assert of(rows) == of(rows[::-1]) != of([*rows[:2], (3, "c")])


def wilson(k, n, z=1.96):
    if not n:
        return 0.0, 0.0
    p = k / n
    m, s, d = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return max(0.0, (m - s) / d), min(1.0, (m + s) / d)


def test_wilson(spark):
    cases = [(0, 0), (0, 9), (9, 9), (263, 270), (155, 270)]
    for r in spark.createDataFrame(cases, "k int, n int").select("k", "n", S.wilson(F.col("k"), F.col("n")).alias("w")).collect():
        assert (r["w"]["lo"], r["w"]["hi"]) == pytest.approx(wilson(r["k"], r["n"]))
    assert [round(x, 4) for x in wilson(263, 270)] == [0.9475, 0.9874]


def test_kappa_edges(spark):
    rows = [(0, 0, 0, 0), (5, 0, 0, 0), (2, 1, 1, 6), (0, 5, 5, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a int, b int, c int, d int").select(S.kappa(*[F.col(c) for c in "abcd"])).collect()]
    assert got == pytest.approx([0.0, 1.0, (0.8 - 0.58) / 0.42, -1.0])


def test_positives_needed(spark):
    got = {r["m"]: r["n"] for r in spark.createDataFrame([(0.0,), (0.02,), (0.05,), (0.5,)], "m double").select("m", S.positives_needed(F.col("m"), F.lit(0.05)).alias("n")).collect()}
    for miss, n in got.items():
        fit = [g for g in S.need_grid() if 1 - wilson(round(g * (1 - miss)), g)[0] <= 0.05]
        assert n == (fit[0] if fit else None)
    assert got[0.5] is None


def test_youden_of_an_inverted_feature(spark):
    assert one(spark, S.youden(F.lit(1), F.lit(9), F.lit(9), F.lit(1)))[0] == pytest.approx(0.8)


def test_clean_and_join(spark):
    r = one(spark, X.clean(F.lit("['甲', '乙']")), X.clean(F.lit("a<b>b</b>\t 　c\n\n\nd ")), X.join_fields([("x", F.lit("1")), ("y", F.lit("2"))], {"x": "名"}), X.join_fields([("x", F.lit("1"))], {"x": "名"}))
    assert tuple(r) == ("甲、乙", "ab c\nd", "名：1\n2", "1")
    lists = ["见 ['甲', '乙'] 等", "['a']['b' ,  'c']", "说明[ 'x' ]", "no [list], ['bad]", "[]", None, "['a\nb', ''] z"]
    want = ["见 甲、乙 等", "ab、c", "说明x", "no [list], ['bad]", "[]", "", "a\nb、 z"]
    assert [one(spark, X.clean(F.lit(t).cast("string")))[0] for t in lists] == want


def test_population_and_relevance(spark):
    rows = [("小儿肺炎", ""), ("肺炎", "患儿一 患儿二"), ("肺炎", "患儿"), ("肺炎", "x" * 160 + "新生儿"), ("肺炎", "新生儿")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, t string").select(X.excluded_population(F.col("n"), F.col("t"), ["小儿"], ["新生儿"], "患儿")).collect()]
    assert got == [True, True, False, False, True]
    assert one(spark, X.relevance(F.lit("高血压"), F.lit("糖尿病"), ["糖尿病", "高血压"]), X.relevance(F.lit("无"), F.lit("糖尿病"), ["糖尿病"]), X.relevance(F.lit("无"), F.lit("无"), ["糖尿病"]))[:] == ("name:高血压", "text:糖尿病", "")


def test_mask_keeps_durations(spark):
    assert one(spark, X.mask_datetime(F.lit("病史20年，2023年5月6日 8:30复查，3月4日")))[0] == "病史20年，   复查， "


def test_list_ordinal(spark):
    rows = [("1", "1. a\n 2、b", True), ("2", "1. a\n 2、b", True), ("3", "x 3. y", False), ("一", "一、x", False), ("12", "112. x", False)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, a string, want boolean").select(X.list_ordinal(F.col("c"), F.col("a")) == F.col("want")).collect()]
    assert all(got)


def test_json_object_is_strict(spark):
    s = "violated BOOLEAN"
    raw = ['x ```json\n{"violated": true}\n``` y', 'so: {"violated": false}.', '{"violated": "true"}', '{"violated": tr', "none", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(X.strict_true(X.json_object(F.col("r"), s)["violated"])).collect()]
    assert got == [True, False, False, False, False, False]


@pytest.mark.parametrize("keep,explain", [(["甲"], ["乙", "丙"]), ([], ["乙，丁"]), ([], [])])
def test_target_round_trip(spark, keep, explain):
    a = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    got = one(spark, X.parse_target(X.format_target(a(keep), a(explain))))[0]
    assert (got["keep"], got["explain"]) == (keep, explain)


def test_target_lines_are_written_and_read_by_the_rules(spark):
    a = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    written = one(spark, X.format_target(a(["甲", "乙"]), a([])), X.format_target(a([]), a(["丙"])), X.format_target(a([]), a([])))
    assert tuple(written) == ("保留: 甲、乙\n解释: -", "保留: -\n解释: 丙", "-")
    text = "head\n 保留： a 、、b，c \r\n解释: -\n解释:d\n保留:e、f"
    got = one(spark, X.parse_target(F.lit(text)), X.parse_target(F.lit(" - ")), X.parse_target(F.lit(None).cast("string")))
    assert [(g["keep"], g["explain"]) for g in got] == [(["a", "b，c", "e", "f"], ["d"]), ([], []), ([], [])]


def test_key_points_take_both_ends(spark):
    for n in range(7, 24):
        parts = [f"part number {i:02d} of it" for i in range(n)]
        got = one(spark, X.key_points(F.lit("。".join(parts) + "。short")))[0]
        assert got == [parts[i] for i in sorted({round(k * (n - 1) / 5) for k in range(6)})]


def test_last_index_and_section(spark):
    got = one(spark, X.last_index(F.lit("abcabc"), F.lit("bc")), X.last_index(F.lit("abc"), F.lit("x")), X.section(F.lit("【原文】a【回答】b【要点】c"), "【回答】", "【要点】"))
    assert tuple(got) == (4, -1, "b")


def random_text(rng):
    return "".join(rng.choice("每天吃药阿司匹林高血压毫克疗程病人ABc12 ，。（）()\n\t") for _ in range(rng.randint(0, 40)))


def test_segmentation_properties():
    rng = random.Random(7)
    for _ in range(800):
        t = random_text(rng)
        tokens = LEX.segment(t)
        assert "".join(w for w, _, _ in tokens) == t
        spans = LEX.spans(t)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert set(spans) <= {(a, b) for _, a, b in tokens}
        s = LEX.score(t)
        assert s["strict"] <= s["lenient"] + 1e-9 and s["strict"] <= s["glossed"] + 1e-9 <= 1 + 1e-6


def test_longest_term_wins():
    assert LEX.spans("阿司匹林匹林") == [(0, 4), (4, 6)]


def test_verdicts():
    assert LEX.verdict("毫克", LEX.chars) == "pass" and LEX.verdict("每天吃", LEX.chars) == "jargon"
    assert LEX.verdict("维生素C", LEX.chars) == LEX.verdict("CT", LEX.chars) == "latin" and LEX.verdict("鼾", LEX.chars) == "char"


def test_gloss_rescues_the_bracketed_one_only():
    s = LEX.score("高血压（血压好高的）高血压")
    assert s["strict"] < s["glossed"] < 1
    assert LEX.score("高血压（" + "好" * 16 + "）")["glossed"] == LEX.score("高血压（" + "好" * 16 + "）")["strict"]


def test_empty_texts_score_zero(spark):
    d = spark.createDataFrame([("",), (" \n",), ("！？",), (None,)], "t string").select(L.readability(spark, F.col("t"), LEX).alias("s"))
    assert all(r["s"]["n_scored"] == 0 and r["s"]["strict"] == 0.0 for r in d.collect())


def test_lexicon_check_and_selftest():
    with pytest.raises(DataContractError):
        L.Lexicon(chars=frozenset("a")).check()
    assert L.selftest(LEX, ["每天吃药一次"], ["高血压阿司匹林"]) >= 0.2
    with pytest.raises(DataContractError):
        L.selftest(LEX, ["高血压"], ["高血压"])


def test_snap():
    assert L.snap_phrase("阿司匹林", "服用阿司匹林片") == "阿司匹林"
    assert L.snap_phrase("阿斯匹林肠溶片", "服用阿司匹林肠溶片") == "阿司匹林肠溶片" and L.snap_phrase("阿斯匹林", "服用阿司匹林") is None
    assert L.snap_phrase("布洛芬片", "服用阿司匹林") is None and L.snap_phrase("x", "abc") is None


def test_unicode_forms(spark):
    r = spark.createDataFrame([("１２ ｍｇ　x",), (None,)], "t string").select(L.nfkc_packed("t").alias("n"), L.nfc(F.lit("é")).alias("c"), L.canonical_json(F.lit('{"b":1,"a":"é"}')).alias("j")).collect()
    assert [x["n"] for x in r] == ["12mgx", None] and r[0]["c"] == "é" and r[0]["j"] == '{"a": "é", "b": 1}'


def plain_snap(phrase, text, least=0.75):
    """The rule, word for word: windows of length n, n - 1 and n + 1, the best ratio strictly above the limit, the first of equals."""
    import difflib

    if phrase and phrase in text:
        return phrase
    if len(phrase) < 2:
        return None
    best, top = None, least
    for size in (len(phrase), len(phrase) - 1, len(phrase) + 1):
        for i in range(max(1, len(text) - size + 1)) if size >= 2 else ():
            r = difflib.SequenceMatcher(None, phrase, text[i : i + size]).ratio()
            if r > top:
                best, top = text[i : i + size], r
    return best


def test_snap_equals_the_plain_rule():
    import random

    from sieveworks.functions.lexical import snap_phrase

    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    cases = [("", "abc"), ("a", "abc"), ("ab", ""), ("abcd", "ab"), ("ab", "ba")]
    cases += [(word(rng.randint(0, 7), "abc"), word(rng.randint(0, 14), "abc")) for _ in range(3000)]
    cases += [(word(rng.randint(5, 14), "abcdefgh"), word(rng.randint(0, 40), "abcdefgh")) for _ in range(300)]
    for phrase, text in cases:
        assert snap_phrase(phrase, text) == plain_snap(phrase, text), (phrase, text)


def test_terms_are_found_leftmost_and_longest():
    import random

    from sieveworks.functions.lexical import Lexicon

    rng = random.Random(6)
    for _ in range(200):
        terms = {"".join(rng.choice("ab(") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        text, lexicon, want, i = "".join(rng.choice("ab(") for _ in range(40)), Lexicon(chars=frozenset(), terms=frozenset(terms)), [], 0
        while i < len(text):
            n = next((n for n in range(4, 1, -1) if text[i : i + n] in terms and i + n <= len(text)), 0)
            if n:
                want.append((i, i + n))
            i += n or 1
        assert lexicon.spans(text) == want


def test_long_texts_are_scored_in_linear_time():
    import time

    from sieveworks.functions.lexical import Lexicon

    lexicon = Lexicon(chars=frozenset("病"), terms=frozenset(["窦性", "心律"]))
    began = time.time()
    found = lexicon.score("窦性心律 (a) 病。" * 50_000)
    assert found["n_scored"] == 200_000 and found["n_sentences"] == 50_000 and time.time() - began < 20


def test_tokens_of_a_batch_are_offsets_and_batches_are_bounded(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "高血压é😀 tion (a) 阿司匹林片abc", "x" * 50, "好" * 9 + "\n\0 é"])]
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    d = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in d.select("i", L.segments(spark, F.col("t"), LEX).alias("s")).collect()}
    assert got == {i: LEX.segment(t or "") for i, t in rows}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 8 << 20


def test_tallies_are_those_of_the_pieces():
    from collections import Counter

    rng = random.Random(8)
    latin = L.Lexicon(chars=frozenset(), terms=frozenset(["tion", "a b", "(x"]))
    for _ in range(800):
        t = "".join(rng.choice(["a", "b", " ", "(", "x", "tion", "\n", "\0", "9", "é", *(["好"] if _ % 2 else [])]) for _ in range(rng.randint(0, 30)))
        assert +latin.tally(t) == Counter(w for w, _, _ in latin.segment(t)), t


def test_judged_words_stay_few():
    lexicon = L.Lexicon(chars=frozenset(), terms=frozenset(["tion"]))
    lexicon.score(" ".join(f"w{i}" for i in range(60_000)), failures=False)
    lexicon.score("one more", failures=False)
    assert len(lexicon.judged) <= 50_001


def test_plain_readability_scores_each_text_once(spark):
    from sieveworks.plans import extended  # noqa: F401
    from sieveworks.plans.catalogue import QUERIES

    plan = QUERIES["readability_plain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].splitlines()[0].count("run(") == 1


def test_bounds_of_all_sizes_are_found_together():
    from collections import Counter

    text, phrase, sizes = "abcab😀bca", "abc😀", [4, 3, 5, 20]
    for size, found in zip(sizes, L.window_bounds(phrase, text, sizes), strict=True):
        width = min(size, len(text))
        windows = [text[i : i + width] for i in range(len(text) - width + 1)]
        assert found.tolist() == [2.0 * (Counter(phrase) & Counter(w)).total() / (len(phrase) + width) for w in windows]


def test_cases_are_sorted_before_they_are_scored(spark):
    from sieveworks.plans import scaled  # noqa: F401
    from sieveworks.plans.catalogue import QUERIES

    plan = QUERIES["merged_cases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("ArrowEvalPython") < plan.index("Sort [")
