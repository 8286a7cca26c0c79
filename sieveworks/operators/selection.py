"""From an indexed corpus to candidate rows and packets: rule tables, relevance, first-wins, personas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import hex_to_long
from .sampling import first_wins


@dataclass(frozen=True)
class SourceRule:
    """Where a scenario's texts come from: a library, a logical table, the fields that must all be filled."""

    scenario: str
    lib: str
    logical: str
    fields: tuple[str, ...]
    terms: tuple[str, ...] | None = None
    simulated_note: str | None = None
    thin: bool = False


@dataclass(frozen=True)
class SelectionSpec:
    labels: dict[str, str]
    terms: tuple[str, ...]
    stop_population: tuple[str, ...] = ()
    strong_child: tuple[str, ...] = ()
    repeated_child: str = ""
    excluded_names: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by scenario
    length: tuple[int, int] = (40, 1200)


def select_candidates(corpus: DataFrame, test_ids: DataFrame, rules: Sequence[SourceRule], spec: SelectionSpec) -> DataFrame:
    """Candidates of all scenarios. corpus: (record_id, lib, logical, row_idx, name, fields map<string,string>).

    Rules are projections over the semi-joined corpus; a record counts once in a scenario, by the first rule that keeps it after
    all filters.
    """
    base = corpus.join(test_ids.select("record_id"), "record_id", "left_semi")
    out = None
    for order, r in enumerate(rules):
        rows = base.where((F.col("lib") == r.lib) & (F.col("logical") == r.logical))
        values = [(f, X.clean(F.coalesce(F.col("fields")[f], F.lit("")))) for f in r.fields]
        rows = rows.where(X.all_filled([v for _, v in values])).withColumn("source_text", X.join_fields(values, spec.labels))
        rows = rows.where(F.length("source_text").between(*spec.length))
        rows = rows.where(~X.excluded_population(F.col("name"), F.col("source_text"), spec.stop_population, spec.strong_child, spec.repeated_child))
        if names := spec.excluded_names.get(r.scenario):
            rows = rows.where(~X.contains_any(F.col("name"), names))
        rows = rows.withColumn("elder_match", X.relevance(F.col("name"), F.col("source_text"), r.terms or spec.terms)).where("elder_match != ''")
        rows = rows.select(F.lit(r.scenario).alias("scenario"), "record_id", "name", "source_text", F.length("source_text").alias("n_chars"), "elder_match", F.struct("lib", "logical", "row_idx", F.array(*map(F.lit, r.fields)).alias("fields"), "record_id").alias("provenance"), F.when(F.lit(r.simulated_note is not None), True).alias("simulated"), F.lit(r.simulated_note).alias("simulated_note"), F.when(F.lit(r.thin), True).alias("thin_source"), F.lit(order).alias("rule"))
        out = rows if out is None else out.unionByName(rows)
    return first_wins(out, ["scenario", "record_id"], [F.col("rule")])


def once_over_scenarios(candidates: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """A record counts once in all: by the order of scenarios, then of rules."""
    place = F.array_position(F.array(*map(F.lit, scenarios)), F.col("scenario"))
    return first_wins(candidates, ["record_id"], [place, F.col("rule")])


def forced_gender(name: Column, male: Sequence[str], female: Sequence[str]) -> Column:
    """By the record's name alone; the first list wins; null if neither fits."""
    return F.when(X.contains_any(name, male), "男").when(X.contains_any(name, female), "女")


def suggested_difficulty(position: Column, total: Column) -> Column:
    at = position / total
    return F.when(at < 0.40, "易").when(at < 0.85, "中").otherwise("难")


def condition_of(name: Column, match: Column, conditions: dict[str, str], generic: Sequence[str], fallback: Sequence[str], h: Column) -> Column:
    """The earliest, then longest, specific term in the name; else a generic one; else that of the recorded match; else by hash."""
    def earliest(terms: Sequence[str]) -> Column:
        hits = F.array(*[F.when(F.instr(name, t) > 0, F.struct(F.instr(name, t).alias("at"), F.lit(-len(t)).alias("n"), F.lit(conditions[t]).alias("c"))) for t in terms])
        return F.array_min(F.filter(hits, lambda x: x.isNotNull()))["c"] if terms else F.lit(None).cast("string")

    specific = [t for t in conditions if t not in generic]
    pairs = F.create_map(*[F.lit(x) for kv in conditions.items() for x in kv])
    recorded = F.try_element_at(pairs, F.substring_index(match, ":", -1))
    picked = F.get(F.array(*map(F.lit, fallback)), F.pmod(h, F.lit(len(fallback))).cast("int"))
    return F.coalesce(earliest(specific), earliest([t for t in generic if t in conditions]), recorded, picked)


@dataclass(frozen=True)
class PersonaSpec:
    ages: tuple[str, ...]
    genders: tuple[str, ...]
    education: tuple[str, ...]
    living: tuple[str, ...]
    helpers: tuple[str, ...]
    conditions: dict[str, str]
    generic: tuple[str, ...]
    fallback: tuple[str, ...]
    male: tuple[str, ...] = ()
    female: tuple[str, ...] = ()
    replace: dict[tuple[str, str], str] = field(default_factory=dict)  # (living, helper) that do not go together: another helper


def persona(record_id: Column, position: Column, name: Column, match: Column, spec: PersonaSpec) -> Column:
    """Struct of traits from 48 bits of the record's hash."""
    h = hex_to_long(F.substring(F.sha2(record_id.cast("binary"), 256), 1, 12))
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))
    living, helper = pick(spec.living, F.shiftright(h, 7)), pick(spec.helpers, F.shiftright(h, 17))
    for (where, who), instead in spec.replace.items():
        helper = F.when((living == where) & (helper == who), instead).otherwise(helper)
    return F.struct(
        pick(spec.ages, h + position).alias("age"),
        F.coalesce(forced_gender(name, spec.male, spec.female), pick(spec.genders, F.shiftright(h, 3))).alias("gender"),
        pick(spec.education, F.shiftright(h, 5)).alias("education"),
        living.alias("living"),
        helper.alias("helper"),
        condition_of(name, match, spec.conditions, spec.generic, spec.fallback, F.shiftright(h, 11)).alias("condition"),
    )


def packets(candidates: DataFrame, spec: PersonaSpec, modes: Sequence[str], prefix: str = "case") -> DataFrame:
    """Authoring packets of a small selected set: ids by scenario and rank, persona, suggested difficulty, mode options."""
    from pyspark.sql import Window

    w = Window.partitionBy("scenario")
    rows = candidates.withColumns({"position": F.row_number().over(w.orderBy("rank")) - 1, "total": F.count("*").over(w)})
    return rows.select(F.format_string(f"{prefix}-%s-%03d", "scenario", "position").alias("id"), "scenario", "source_text", F.col("name").alias("record_name"), persona(F.col("record_id"), F.col("position"), F.col("name"), F.col("elder_match"), spec).alias("persona"), suggested_difficulty(F.col("position"), F.col("total")).alias("suggested_difficulty"), F.array(*map(F.lit, modes)).alias("failure_mode_options"), "provenance")


def merge_authored(cases: DataFrame, lexicon, source: str = "source_text", **rules) -> DataFrame:
    """Authored cases of all files by id, with source_readability (strict, four places). rules: those of checks.case_problems; the first problems are raised, so a set is whole or absent."""
    from ..errors import DataContractError
    from ..functions.lexical import source_readability
    from .checks import case_problems

    if found := case_problems(cases, **rules).limit(40).collect():
        raise DataContractError(f"{len(found)} problems or more: {[tuple(r) for r in found[:5]]}")
    # sorted first: a sort by ranges runs what is before it twice, once for its borders
    return cases.orderBy("id").withColumn("source_readability", source_readability(cases.sparkSession, F.col(source), lexicon))
