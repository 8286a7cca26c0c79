"""Text predicates and transformations that stay inside the JVM. Every word list, pattern and label is an argument."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years 19xx/20xx with month and day, month and day, clock times.
DATETIME = r"(?:19|20)\d{2}\s*年(?:\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*[日号])?)?|\d{1,2}\s*月\s*\d{1,2}\s*[日号]|\d{1,2}:\d{2}(?::\d{2})?"
SENTENCE_END = "[。！？；\n!?;]+"
CLAUSE_END = "[。；\n]"


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """False for an empty list."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def first_contained(text: Column, terms: Sequence[str]) -> Column:
    """The first term in list order that the text holds; null if none."""
    return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in terms], F.lit(None).cast("string"))


#: A list of single-quoted items, as it stands in prose.
LIST_LITERAL = r"\[\s*'[^']*'(?:\s*,\s*'[^']*')*\s*\]"


def clean(text: Column) -> Column:
    """List literals, wherever they stand, become their items joined by 、; tags go; runs of space, tab and U+3000 become one space, runs of line ends one; trimmed. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(LIST_LITERAL), F.lit(0))
    items = F.transform(found, lambda s: F.array_join(F.regexp_extract_all(s, F.lit("'([^']*)'"), F.lit(1)), "、"))
    between = F.split(text, LIST_LITERAL, -1)
    listed = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(items, i), F.lit("")))), "")
    out = F.when(F.size(found) > 0, listed).otherwise(text)
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"[ \t　]+", " ")
    out = F.regexp_replace(out, r"\n{2,}", "\n")
    return F.regexp_replace(out, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def join_fields(values: Sequence[tuple[str, Column]], labels: dict[str, str]) -> Column:
    """Several fields: lines `label：value`, bare where no label is known; one field: its value."""
    if len(values) == 1:
        return values[0][1]
    return F.array_join(F.array(*[F.concat(F.lit(labels[n] + "："), v) if n in labels else v for n, v in values]), "\n")


def all_filled(values: Sequence[Column]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & (F.length(F.coalesce(v, F.lit(""))) > 0)
    return out


def excluded_population(name: Column, text: Column | None, stop: Sequence[str], strong: Sequence[str], repeated: str, head: int = 160) -> Column:
    """A stop term in the name, or a text whose head has a strong term, or the repeated term twice."""
    out = contains_any(name, stop)
    if text is not None:
        top = F.substring(text, 1, head)
        body = contains_any(top, strong)
        if repeated:
            body = body | (F.regexp_count(top, F.lit(re.escape(repeated))) >= 2)
        out = out | ((F.length(text) > 0) & body)
    return out


def relevance(name: Column, text: Column, terms: Sequence[str]) -> Column:
    """`name:T` of the first term in the name, else `text:T` of the first in the text, else empty."""
    in_name, in_text = first_contained(name, terms), first_contained(text, terms)
    return F.coalesce(F.concat(F.lit("name:"), in_name), F.concat(F.lit("text:"), in_text), F.lit(""))


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], fallback: str, mark: str) -> Column:
    """struct(scenario, matched): the first rule in order with a keyword in the text, and that keyword."""
    hits = [F.when(contains_any(text, words), F.struct(F.lit(name).alias("scenario"), first_contained(text, words).alias("matched"))) for name, words in rules if words]
    return F.coalesce(*hits, F.struct(F.lit(fallback).alias("scenario"), F.lit(mark).alias("matched")))


def bucket_of(text: Column, thin: int, markers: Sequence[tuple[str, Sequence[str]]], other: str = "plain") -> Column:
    """`thin_source` below so many characters, else the first bucket with a marker, else other."""
    out = F.when(F.length(text) < thin, "thin_source")
    for name, words in markers:
        out = out.when(contains_any(text, words), name)
    return out.otherwise(other)


def mask_datetime(text: Column, pattern: str = DATETIME) -> Column:
    """Dates and clock times become one space; durations such as 20年 stay."""
    return F.regexp_replace(text, pattern, " ")


def sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    return F.filter(F.split(text, pattern), lambda s: F.length(F.regexp_replace(s, r"(?U)\s", "")) > 0)


def visible_length(text: Column) -> Column:
    """Characters that are not white space of any kind."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def key_points(text: Column, least: int = 12, most: int = 6, pattern: str = CLAUSE_END) -> Column:
    """Clauses of at least so many characters; of more than `most` an even choice with both ends."""
    clauses = F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: F.length(p) >= least)

    def choice(parts: Column) -> Column:
        n = F.size(parts)
        at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(most - 1))).cast("int")))
        return F.when(n <= most, parts).otherwise(F.transform(at, lambda i: F.get(parts, i)))

    # a transform over one element names the clauses, so that they are found once
    return F.element_at(F.transform(F.array(clauses), choice), 1)


def list_ordinal(candidate: Column, answer: Column) -> Column:
    """An all-digit candidate that starts a line in front of a dot, list comma or bracket."""
    starts = F.concat(F.lit(r"(?m)^\s*"), candidate, F.lit(r"[.、)]"))
    return candidate.rlike(r"\A[0-9]+\z") & F.when(candidate.rlike(r"\A[0-9]+\z"), F.regexp_like(answer, starts)).otherwise(False)


def numeric_spans(text: Column, digit: str = r"[0-9]+(?:\.[0-9]+)?", numeral: str | None = None, fraction: str | None = None) -> Column:
    """Digit spans, then numerals with units, then fractions."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (digit, numeral, fraction) if p]
    return F.concat(*found)


def last_index(text: Column, part: Column) -> Column:
    """Start (from 0) of the last occurrence; -1 if there is none."""
    at = F.instr(F.reverse(text), F.reverse(part))
    return F.when(at > 0, F.length(text) - at + 1 - F.length(part)).otherwise(F.lit(-1))


def section(text: Column, start: str, end: str | None = None) -> Column:
    """What stands after a literal marker, up to the next one."""
    after = F.when(F.instr(text, start) > 0, F.substring_index(text, start, -1)).otherwise(F.lit(""))
    return F.substring_index(after, end, 1) if end else after


def json_object(raw: Column, schema: str) -> Column:
    """Fenced or embedded JSON: from the first brace to the last one, read strictly; null if it is no whole object."""
    body = F.coalesce(F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), raw)
    body = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def stripped_json(raw: Column, schema: str) -> Column:
    """JSON whose text is an object once white space and a fence around it are gone; null otherwise."""
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    body = F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "^json", "")).otherwise(text)
    body = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    return F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def greedy_json(raw: Column, schema: str) -> Column:
    """JSON from the first brace to the last one, whatever is around; null where that is no object."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def strict_true(value: Column) -> Column:
    """Only a real true counts; null is false."""
    return F.coalesce(value, F.lit(False))


def grounded(evidence: Column, *texts: Column) -> Column:
    """Empty evidence, or an exact substring of one of the texts."""
    out = F.coalesce(evidence, F.lit("")) == ""
    for t in texts:
        out = out | t.contains(evidence)
    return out


def format_target(keep: Column, explain: Column, heads: tuple[str, str] = ("保留", "解释"), sep: str = "、", none: str = "-") -> Column:
    """A line for each of two lists, `none` for an empty one; `none` alone where both are empty."""
    line = lambda head, items: F.concat(F.lit(head + ": "), F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(F.lit(none)))
    return F.when((F.size(keep) == 0) & (F.size(explain) == 0), F.lit(none)).otherwise(F.concat_ws("\n", line(heads[0], keep), line(heads[1], explain)))


def parse_target(text: Column, heads: tuple[str, str] = ("保留", "解释"), sep: str = "、", none: str = "-") -> Column:
    """struct(keep, explain): the items of all lines of a head, in order; colons of both widths are read. Null and other texts have none."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", -1), trimmed)

    def items(head: str) -> Column:
        bodies = F.transform(F.filter(lines, lambda s: s.rlike(rf"^{head}[:：]")), lambda s: trimmed(F.substring(s, len(head) + 2, F.length(s))))
        parts = F.flatten(F.transform(F.filter(bodies, lambda s: ~s.isin("", none)), lambda s: F.split(s, sep, -1)))
        return F.filter(F.transform(parts, trimmed), lambda s: s != "")

    return F.struct(items(heads[0]).alias("keep"), items(heads[1]).alias("explain"))


def clean_terms(raw: Column, separators: str = "[,，、;；/\\s]+", han: str = r"^[\x{4E00}-\x{9FFF}]{2,}$") -> Column:
    """Terms of a field: split, bracket notes and quotes gone, Han only, two characters or more."""
    bare = F.regexp_replace(raw, r"[（(\[【][^）)\]】]*[）)\]】]", "")
    return F.filter(F.transform(F.split(bare, separators), lambda t: F.regexp_replace(t, "[\"'“”‘’ ]", "")), lambda t: t.rlike(han))


def mock_output(text: Column, case_id: Column, prefix: str = "", suffix: str = "", pattern: str = CLAUSE_END) -> Column:
    """A stand-in for a generated text: the first max(1, n - h % 3) clauses, h from the id's hash."""
    parts = F.filter(F.split(text, pattern), lambda p: F.trim(p) != "")
    h = F.conv(F.substring(F.sha2(case_id.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 3
    return F.concat(F.lit(prefix), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - h.cast("int"))), "。"), F.lit(suffix))


def numbered(items: Column) -> Column:
    """`1. a` lines of an array, for prompts."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def composite_id(case_id: Column, text: Column) -> Column:
    return F.concat(case_id, F.lit("::"), text)
