"""Spans of an answer that its source does not support, and the labels that can be trusted for them.

Numbers are compared as whole matches ("12" is not supported by "112"), lexicon terms as substrings. Both texts are
normalised first: NFKC and no white space, so what spaces alone keep apart is read as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded
from ..functions.lexical import nfkc_packed
from .joins import contains_join
from .sampling import stratified_sample

#: Numeral characters and unit words.
NUMERALS = "零一二三四五六七八九十百千万两半"
UNITS = ["星期", "礼拜", "小时", "钟头", "分钟", "毫升", "毫克", "公斤", "天", "年", "月", "周", "秒", "斤", "克", "升", "片", "粒", "颗", "倍", "次", "岁", "分"]
DIGIT = r"[0-9]+(?:\.[0-9]+)?"


def numeral_pattern(numerals: str = NUMERALS, units: list[str] | None = None) -> str:
    """Numerals with a unit that no 之 follows, longest unit first."""
    words = "|".join(sorted(UNITS if units is None else units, key=lambda u: -len(u)))
    return rf"[{numerals}]+个?(?:{words})(?!之)"


def fraction_pattern(numerals: str = NUMERALS) -> str:
    return rf"[{numerals}]+分之[{numerals}]+"


def number_patterns() -> list[tuple[str, str, int]]:
    """(kind, pattern, red line) in the order in which kinds win."""
    return [("fraction", fraction_pattern(), 0), ("cn_numeral", numeral_pattern(), 0), ("digit", DIGIT, 2)]


def packed(text: Column, nfkc: bool = True) -> Column:
    return nfkc_packed(text) if nfkc else F.regexp_replace(text, r"(?U)\s+", "")


def infer_kind(text: Column) -> Column:
    """By the shape of the whole text: fraction, digit, numeral, else lexicon."""
    whole = lambda p: text.rlike(rf"\A(?:{p})\z")
    return F.when(whole(fraction_pattern()), "fraction").when(whole(DIGIT), "digit").when(whole(numeral_pattern()), "cn_numeral").otherwise("lexicon")


def split_case(text: Column, source_mark: str = "【原文】", answer_mark: str = "【回答】", points_mark: str = "【要点】") -> tuple[Column, Column]:
    """(source, answer) of a case text; the marks are literal."""
    source = F.replace(F.substring_index(text, answer_mark, 1), F.lit(source_mark), F.lit(""))
    answer = F.substring_index(F.get(F.split(text, answer_mark), F.lit(1)), points_mark, 1)
    return source, answer


def _tagged(order: int, kind: str, red: int):
    return lambda t: F.struct(F.lit(order).alias("o"), t.alias("candidate_text"), F.lit(kind).alias("kind"), F.lit(red).alias("red_line_guess"))


def extract_candidates(cases: DataFrame, terms: DataFrame | None = None, nfkc: bool = True) -> DataFrame:
    """(case_id, candidate_text, kind, red_line_guess): unsupported spans, one row a text, the first kind wins.

    cases: (case_id, source_text, answer), one row a case; terms: (term). All arms read each text where it lies; only candidates are shuffled.
    """
    norm = cases.select("case_id", packed(F.col("source_text"), nfkc).alias("src"), packed(F.col("answer"), nfkc).alias("ans"))
    found = []
    for order, (kind, pattern, red) in enumerate(number_patterns(), 1):
        spans = lambda c, p=pattern: F.regexp_extract_all(c, F.lit(p), F.lit(0))
        found.append(F.transform(F.array_except(spans(F.col("ans")), spans(F.col("src"))), _tagged(order, kind, red)))
    out = norm.select("case_id", F.explode(F.concat(*found)).alias("c")).select("case_id", "c.*")
    if terms is not None:
        named = terms.select(packed(F.col("term"), nfkc).alias("term")).where("term != ''").distinct()
        lexicon = contains_join(norm, named, text="ans", key="case_id", unless="src", unique=True)
        out = out.unionByName(lexicon.select("case_id", F.lit(0).alias("o"), F.col("term").alias("candidate_text"), F.lit("lexicon").alias("kind"), F.lit(0).alias("red_line_guess")))
    best = F.min(F.struct("o", "kind", "red_line_guess"))
    return out.groupBy("case_id", "candidate_text").agg(best.alias("b")).select("case_id", "candidate_text", "b.kind", "b.red_line_guess")


def flag_cases(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """cases with flag: whether there is any candidate."""
    hit = candidates.select("case_id", F.lit(True).alias("flag")).distinct()
    return cases.join(hit, "case_id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def derived_label(candidate: Column, kind: Column, red_lines: Column, covered: tuple[int, ...] = (0, 2)) -> Column:
    """Whether the evidence of a violated, covered red line holds the candidate: numbers as whole matches, terms as substrings."""
    def in_evidence(evidence: Column) -> Column:
        out = F.when(kind == "lexicon", evidence.contains(candidate))
        for k, pattern, _ in number_patterns():
            out = out.when(kind == k, F.array_contains(F.regexp_extract_all(evidence, F.lit(pattern), F.lit(0)), candidate))
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists(red_lines, lambda r: F.coalesce(r["violated"], F.lit(False)) & r["idx"].isin(*covered) & in_evidence(F.coalesce(r["evidence"], F.lit("")))), F.lit(False))


def label_pool(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate with its derived label. cases: (case_id, source_text, answer, verdict, red_lines)."""
    rows = candidates.join(cases, "case_id")
    return rows.withColumn("label", derived_label(F.col("candidate_text"), F.col("kind"), F.col("red_lines")))


def trusted_pool(pool: DataFrame) -> DataFrame:
    """Pass cases give negatives; fail cases only what the evidence names, as positives."""
    ok = (F.col("verdict") == "pass") | ((F.col("verdict") == "fail") & F.col("label"))
    return pool.where(ok).withColumn("label", F.col("verdict") == "fail").select("case_id", "source_text", "answer", "candidate_text", "kind", "red_line_guess", "label")


def uncertain_pool(pool: DataFrame) -> DataFrame:
    """What trusted_pool leaves out of fail cases."""
    return pool.where((F.col("verdict") == "fail") & ~F.col("label")).select("case_id", "source_text", "answer", "candidate_text", "kind", "red_line_guess")


def apply_labels(candidates: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """Judged rows (key, violated) give the label; rows without one are dropped."""
    return candidates.join(judged.select(key, F.col("violated").alias("label")), key)


def sample_by_label(pool: DataFrame, n: int, seed: str) -> DataFrame:
    return stratified_sample(pool, "label", F.concat_ws("|", "case_id", "candidate_text"), n, seed)


def candidate_order(seed: str) -> Column:
    return seeded("sample", F.col("case_id"), F.col("candidate_text"), F.lit(seed))
