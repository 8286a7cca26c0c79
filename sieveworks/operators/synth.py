"""Synthesis of matched counterexamples: positives with a planted value, negatives with a supported one in the same words.

All word lists, templates and phrases are in a SynthSpec. Positives are column expressions over the cases; negatives, whose rules
look at several spellings of each number, are one Arrow pass; quotas, caps and unions around them are DataFrame operators.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_mod
from ..functions.lexical import nfkc_packed
from ..functions.text import contains_any
from .candidates import DIGIT, UNITS, fraction_pattern, numeral_pattern
from .sampling import cap_source_share

#: Digits with one usual numeral each, and the second reading of two.
NUMERAL_OF = {1: "一", 2: "两", 3: "三", 4: "四", 5: "五", 6: "六", 7: "七", 8: "八", 9: "九", 10: "十"}
DIGIT_OF = {**{c: d for d, c in NUMERAL_OF.items()}, "二": 2}
#: Units of equivalent forms, time and dose, without the ambiguous 分.
FORM_UNITS = ["星期", "礼拜", "小时", "钟头", "分钟", "毫升", "毫克", "公斤", "天", "月", "周", "秒", "克", "升", "片", "粒", "颗", "次"]


def normal(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).split())


def hash_pick(key: str, n: int) -> int:
    return int(hashlib.sha256(key.encode()).hexdigest(), 16) % n


def numbers(text: str) -> dict[str, list[str]]:
    return {"digit": re.findall(DIGIT, text), "cn_numeral": re.findall(numeral_pattern(), text), "fraction": re.findall(fraction_pattern(), text)}


def word_pools(groups: list[tuple[str, ...]]) -> dict[str, str]:
    """The pool of each word, holdout or train, one for all groups that it is in.

    A word is held out if some group gives it up: the last of the group's words that earlier groups do not train on, or the last of all
    if they train on each.
    """
    trained, given = set(), set()
    for group in groups:
        kept = ([w for w in group if w not in trained] or list(group))[-1]
        given.add(kept)
        trained |= set(group) - given
        trained.discard(kept)
    return {w: "holdout" if w in given else "train" for group in groups for w in group}


@dataclass(frozen=True)
class SynthSpec:
    categories: dict[str, tuple[str, ...]]
    default: tuple[str, ...]
    markers: tuple[str, ...]
    number_markers: tuple[str, ...]
    templates: tuple[str, ...]  # with {names}
    phrases: tuple[str, ...]  # each with a number
    wrapper: str = "（补充一句：{}。）"
    window: int = 15
    held_phrases: int = 3
    suffixes: tuple[str, ...] = field(default=("片", "胶囊", "颗粒", "注射液", "口服液", "软膏", "栓", "滴眼液", "喷雾剂", "丸", "散"))
    tails: str = ""
    weak_tails: str = ""

    @cached_property
    def pools(self) -> dict[str, str]:
        return word_pools([*self.categories.values(), self.default])

    @cached_property
    def bigrams(self) -> frozenset[str]:
        return frozenset(w[-2:] for g in [*self.categories.values(), self.default] for w in g if len(w) > 1)

    def examples(self, category: str | None, holdout: bool) -> tuple[str, ...]:
        """What a trigger of the category plants: the group's words of that pool, or the group's last (held out) or first one if it has none."""
        group = self.categories.get(category, self.default)
        pool = "holdout" if holdout else "train"
        return tuple(w for w in group if self.pools[w] == pool) or (group[-1 if holdout else 0],)

    def phrases_of(self, holdout: bool) -> tuple[str, ...]:
        return self.phrases[-self.held_phrases :] if holdout else self.phrases[: -self.held_phrases]

    def slots(self, holdout: bool) -> list[str]:
        """Phrases with exactly one number, a digit in front of a unit, as templates with {n} for both."""
        units, out = "|".join(sorted(UNITS, key=lambda u: -len(u))), []
        for phrase in self.phrases_of(holdout):
            found = [s for spans in numbers(phrase).values() for s in spans]
            if len(found) == 1 and found[0].isdigit() and re.search(rf"{found[0]}(?:{units})", phrase):
                out.append(re.sub(rf"{found[0]}(?:{units})", "{n}", phrase, count=1))
        return out

    def druglike(self, term: str) -> bool:
        return term.endswith(self.suffixes) or term[-2:] in self.bigrams or (term[-1:] in self.tails and bool(term) and term[-1:] not in self.weak_tails)

    def druglike_order(self, term: str) -> tuple:
        return (term[-2:] not in self.bigrams, -len(term), term)


def appended(answer: str, phrase: str) -> str:
    """The one way in which anything is planted, for both labels."""
    return answer.rstrip() + "\n\n" + phrase


def supported(phrase: str, source: str, forms: bool) -> bool:
    """Every number of the phrase is in the source (normalised), or, with forms, in its other spelling."""
    have = {k: set(v) for k, v in numbers(source).items()}
    if forms:
        have["cn_numeral"] |= {NUMERAL_OF[int(d)] + u for d, u in digit_units(source) if int(d) in NUMERAL_OF}
        have["digit"] |= {str(DIGIT_OF[c]) for c, _ in numeral_units(source)}
    return all(set(v) <= have[k] for k, v in numbers(phrase).items())


def digit_units(text: str) -> list[tuple[str, str]]:
    units = "|".join(sorted(FORM_UNITS, key=lambda u: -len(u)))
    return re.findall(rf"(?<![\d.\-])(\d+)({units})", text)


def numeral_units(text: str) -> list[tuple[str, str]]:
    units = "|".join(sorted(FORM_UNITS, key=lambda u: -len(u)))
    return re.findall(rf"(?<![0-9])([{''.join(DIGIT_OF)}])({units})", text)


EDITS = "case_id string, source_case_id string, source_text string, original_answer string, synthetic_answer string, injected_examples array<string>, red_line_idx int, verdict string"


def _contexts(source: Column, markers: tuple[str, ...], window: int) -> Column:
    """For each marker, longest first, the text up to its end from at most `window` characters before it."""
    words = "|".join(re.escape(m) for m in sorted(markers, key=lambda m: -len(m)))
    # what stands before a match is read by a look-behind: the whole window, or else all there is since the start (a group that Java may have left over from places before)
    pattern = rf"(?s)(?:(?<=(?=(.{{{window}}})).{{{window}}})|(?<=^(.{{0,{window - 1}}})))({words})"
    groups = [F.regexp_extract_all(source, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda m: F.concat(F.when(F.length(m["g0"]) > 0, m["g0"]).otherwise(F.coalesce(m["g1"], F.lit(""))), m["g2"]))


def _pick(key: Column, n: int) -> Column:
    """A place below n by the whole digest of a key."""
    return digest_mod(F.sha2(key.cast("binary"), 256), n).cast("int")


def _planted(answer: Column, phrase: Column) -> Column:
    return F.concat(F.regexp_replace(answer, r"(?U)\s+$", ""), F.lit("\n\n"), phrase)


def entity_edits(cases: DataFrame, spec: SynthSpec, holdout: bool) -> DataFrame:
    """A row for each trigger whose examples are in neither text: the first context of each category, or of none, in the order of the text.

    cases: (case_id, source_text, answer, __src, __ans), the last two normalised. A trigger that is skipped leaves a gap in the numbering.
    """
    if not spec.markers:
        return cases.sparkSession.createDataFrame([], EDITS)
    kinds = [*spec.categories, None]
    at = F.transform(_contexts(F.col("source_text"), spec.markers, spec.window), lambda c, i: F.struct(i.alias("place"), F.coalesce(*[F.when(c.contains(k), F.lit(n)) for n, k in enumerate(spec.categories)], F.lit(len(kinds) - 1)).alias("kind")))
    of_kind = lambda n: F.get(F.filter("__at", lambda x: x["kind"] == n), F.lit(0))
    first = F.array(*[of_kind(n) for n in range(len(kinds))])
    rows = cases.withColumn("__at", at).withColumn("__first", F.array_sort(F.filter(first, lambda x: x.isNotNull())))
    rows = rows.select("*", F.posexplode("__first").alias("__i", "__t"))
    named = F.array(*[F.array(*map(F.lit, spec.examples(k, holdout))) for k in kinds])
    rows = rows.withColumn("__names", F.get(named, F.col("__t.kind")))
    plain = F.array(*[F.array(*[F.lit(normal(w)) for w in spec.examples(k, holdout)]) for k in kinds])
    known = F.exists(F.get(plain, F.col("__t.kind")), lambda w: F.col("__src").contains(w) | F.col("__ans").contains(w))
    template = F.get(F.array(*map(F.lit, spec.templates)), _pick(F.concat_ws(":", "case_id", F.col("__i").cast("string")), len(spec.templates)))
    suffix = F.when(F.col("__i") > 0, (F.col("__i") + 1).cast("string")).otherwise("")
    return rows.where(~known).select(F.concat("case_id", F.lit("-synth"), suffix).alias("case_id"), F.col("case_id").alias("source_case_id"), "source_text", F.col("answer").alias("original_answer"), _planted(F.col("answer"), F.replace(template, F.lit("{names}"), F.array_join("__names", "、"))).alias("synthetic_answer"), F.col("__names").alias("injected_examples"), F.lit(0).alias("red_line_idx"), F.lit("fail").alias("verdict"))


def number_edits(cases: DataFrame, spec: SynthSpec, holdout: bool) -> DataFrame:
    """At most one row a case with a number marker: the first phrase, from a hashed start on, whose numbers the source lacks; none if the answer has one of them."""
    pool = spec.phrases_of(holdout)
    if not pool or not spec.number_markers:
        return cases.sparkSession.createDataFrame([], EDITS)
    values = lambda p: list(dict.fromkeys([*numbers(p)["digit"], *numbers(p)["cn_numeral"]]))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), strings(values(p)).alias("values"), strings([normal(v) for v in values(p)]).alias("plain")) for p in pool])
    start = _pick(F.concat(F.lit("numeric:"), "case_id"), len(pool))
    turned = F.transform(F.sequence(F.lit(0), F.lit(len(pool) - 1)), lambda o: F.get(phrases, (start + o) % len(pool)))
    holds = lambda text: lambda p: F.exists(p["plain"], lambda v: F.col(text).contains(v))
    rows = cases.where(contains_any(F.col("source_text"), spec.number_markers)).withColumn("__p", F.get(F.filter(turned, lambda p: ~holds("__src")(p)), F.lit(0)))
    rows = rows.where(F.col("__p").isNotNull() & (F.size("__p.values") > 0) & ~holds("__ans")(F.col("__p")))
    before, after = spec.wrapper.split("{}")
    return rows.select(F.concat("case_id", F.lit("-synthnum")).alias("case_id"), F.col("case_id").alias("source_case_id"), "source_text", F.col("answer").alias("original_answer"), _planted(F.col("answer"), F.concat(F.lit(before), "__p.phrase", F.lit(after))).alias("synthetic_answer"), F.col("__p.values").alias("injected_examples"), F.lit(2).alias("red_line_idx"), F.lit("fail").alias("verdict"))


def synthesize(cases: DataFrame, spec: SynthSpec, holdout: bool = False, source_share: float | None = 0.05) -> DataFrame:
    """Positives of all cases (case_id, source_text, answer); with a share, no source case gives more than that of them. Null texts count as empty."""
    filled = cases.select("case_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source_text", "answer")])
    rows = filled.withColumns({"__src": nfkc_packed("source_text"), "__ans": nfkc_packed("answer")})
    out = entity_edits(rows, spec, holdout).unionByName(number_edits(rows, spec, holdout))
    return out if source_share is None else cap_source_share(out, "source_case_id", "case_id", source_share)


def to_candidates(edits: DataFrame) -> DataFrame:
    """One positive candidate for each planted value."""
    return edits.select("source_case_id", "case_id", "source_text", F.col("synthetic_answer").alias("answer"), F.explode("injected_examples").alias("candidate_text"), F.col("red_line_idx").alias("red_line_guess"), F.lit(True).alias("label"))


def grounded_entity(spec: SynthSpec, terms: list[str], case_id: str, source: str, answer: str, most: int = 3) -> Iterator[dict]:
    """Terms of the source that the answer lacks, none inside another that was taken, in the usual templates."""
    src, ans, taken = normal(source), normal(answer), []
    for t in terms:
        if len(taken) < most and t in src and t not in ans and not any(t in p for p in taken):
            taken.append(t)
    if not taken:
        return
    phrase = spec.templates[hash_pick(f"groundedneg:{case_id}", len(spec.templates))].format(names="、".join(taken))
    if supported(phrase, src, forms=False):
        for t in taken:
            yield {"answer": appended(answer, phrase), "candidate_text": t, "kind": "lexicon", "red_line_guess": 0}


def grounded_number(spec: SynthSpec, case_id: str, source: str, answer: str, holdout: bool) -> Iterator[dict]:
    """The first number with unit of the source whose number the answer lacks."""
    src, have, slots = normal(source), set(numbers(normal(answer))["digit"]), spec.slots(holdout)
    for bare, unit in digit_units(src) if slots else ():
        phrase = spec.wrapper.format(slots[hash_pick(f"gnumneg:{case_id}", len(slots))].format(n=bare + unit))
        if bare not in have and supported(phrase, src, forms=False):
            yield {"answer": appended(answer, phrase), "candidate_text": bare, "kind": "digit", "red_line_guess": 2}
            return


def equivalent_form(spec: SynthSpec, case_id: str, source: str, answer: str, holdout: bool) -> Iterator[dict]:
    """A number of the source in its other spelling; the candidate is what an extractor would take from the answer."""
    src, ans, slots = normal(source), normal(answer), spec.slots(holdout)
    have = numbers(src)
    to_numeral = [(w, w) for d, u in digit_units(src) if int(d) in NUMERAL_OF for w in [NUMERAL_OF[int(d)] + u] if w not in have["cn_numeral"] and w not in src and w not in ans]
    to_digit = [(b + u, b) for c, u in numeral_units(src) for b in [str(DIGIT_OF[c])] if b not in have["digit"] and b + u not in src and b + u not in ans]
    ways = [to_digit, to_numeral] if hash_pick(f"eqdir:{case_id}", 2) else [to_numeral, to_digit]
    first = next((w[0] for w in ways if w), None)
    if first is None or not slots:
        return
    written, bare = first
    phrase = spec.wrapper.format(slots[hash_pick(f"eqformneg:{case_id}", len(slots))].format(n=written))
    if supported(phrase, src, forms=True):
        yield {"answer": appended(answer, phrase), "candidate_text": bare, "kind": "digit" if bare[0].isdigit() else "cn_numeral", "red_line_guess": 2}


NEGATIVES = "case_id string, source_text string, flavor string, answer string, candidate_text string, kind string, red_line_guess int, label boolean"


def injection_negatives(cases: DataFrame, spec: SynthSpec, terms: list[str], holdout: bool = False) -> DataFrame:
    """Negatives of pass cases in the words of the positives: grounded entities, and a number in its other spelling or, where there is none, as it stands."""
    ordered = sorted({t for t in map(normal, terms) if spec.druglike(t)}, key=spec.druglike_order)
    shared = cases.sparkSession.sparkContext.broadcast((spec, ordered))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in NEGATIVES.split(", ")]
        own, words = shared.value
        for batch in batches:
            rows = []
            for case_id, source, answer in batch.itertuples(index=False):
                text = (case_id, source or "", answer or "")
                other = list(equivalent_form(own, *text, holdout))
                as_is = [] if other else grounded_number(own, *text, holdout)
                for flavor, found in (("grounded", grounded_entity(own, words, *text)), ("equivalent", other), ("grounded_number", as_is)):
                    rows += [{**r, "case_id": case_id, "source_text": source, "flavor": flavor, "label": False} for r in found]
            yield pd.DataFrame(rows, columns=names)

    return cases.select("case_id", "source_text", "answer").mapInPandas(run, NEGATIVES)


def matched_negatives(negatives: DataFrame, positives: DataFrame, kind_of: Column) -> DataFrame:
    """As many negatives of each kind as there are positives of it, in order of their keys; shortages stay."""
    from .sampling import kind_quota

    quota = positives.withColumn("kind", kind_of).groupBy("kind").agg(F.count("*").alias("n"))
    return kind_quota(negatives, "kind", quota, [F.col("case_id"), F.col("candidate_text")])
