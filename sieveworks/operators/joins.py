"""Joins with stated policies for what is missing, and the contains-join as an equi-join."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of terms that automata may hold in all, and one automaton.
MOST_BYTES, PART_BYTES = 64 << 20, 8 << 20

_automata: dict[str, ahocorasick.Automaton | None] = {}


def _automaton(key: str, terms: list[str]) -> ahocorasick.Automaton | None:
    """The automaton of the terms, built once a worker; None of no terms. A worker keeps the few of its last joins."""
    if key not in _automata:
        while len(_automata) > 8:
            del _automata[next(iter(_automata))]
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        made.make_automaton()
        _automata[key] = made if terms else None
    return _automata[key]


def _scan(rows: DataFrame, terms: DataFrame, key: str, text: str, unless: str | None, term: str) -> DataFrame:
    """(key, term), distinct in each row, by an automaton of all terms: each text is read once, and work grows with texts and hits."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(sorted(r[0] for r in terms.collect()))
    name = uuid.uuid4().hex
    schema = T.StructType([rows.schema[key], T.StructField(term, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(name, shared.value)
        for batch in batches:
            at, hits = [], []
            texts = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for i, t in enumerate(texts[0] if found is not None else []):
                if not t:
                    continue
                own = {w for _, w in found.iter(t)}
                if own and len(texts) > 1 and texts[1][i]:
                    own.difference_update(w for _, w in found.iter(texts[1][i]))
                at += [i] * len(own)
                hits += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(hits, pa.string())], [key, term])

    return rows.select(key, text, *([unless] if unless else [])).mapInArrow(run, schema)


def _by_substrings(texts: DataFrame, named: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """(key, term) for vocabularies beyond what tasks hold: substrings whose first two characters begin a term meet the terms by equality."""
    heads = named.groupBy(F.substring("__t", 1, 2).alias("__h")).agg(F.collect_set(F.length("__t")).alias("__n"))
    places = texts.select(F.col(key), F.filter(F.split(F.col(text), ""), lambda c: c != "").alias("__c")).where("size(__c) > 0").select(key, "__c", F.explode(F.sequence(F.lit(0), F.size("__c") - 1)).alias("__i"))
    first = F.get("__c", F.col("__i"))
    tried = places.select(key, "__c", "__i", F.explode(F.array(first, F.concat(first, F.get("__c", F.col("__i") + 1)))).alias("__h")).join(heads, "__h")
    grams = tried.select(key, "__c", "__i", F.explode("__n").alias("__l")).select(key, F.array_join(F.slice("__c", F.col("__i") + 1, F.col("__l")), "").alias("__t"))
    return grams.join(named, "__t").select(key, F.col("__t").alias(term))


def contains_join(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", key: str = "key", unless: str | None = None, unique: bool = False, most_bytes: int = MOST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Distinct (key, term) where the text contains the term, and, where a column `unless` is given, the text there does not (keys are unique then), without a cross join.

    Terms whose bytes were summed and are few become automata of at most some `part_bytes` each, terms dealt out by hash; every automaton reads
    each text once, and only hits are shuffled. Larger vocabularies meet the texts' substrings by a shuffled equi-join. Empty terms and null texts meet nothing; a null key is a key. unique: keys are, so
    an automaton's hits are distinct as they come.
    """
    named = terms.select(F.col(term).alias("__t")).where("__t != ''").distinct()
    held = named.agg(F.sum(F.octet_length("__t") + 64).alias("b")).first()["b"] or 0
    if held <= most_bytes:
        parts = max(1, -(-held // part_bytes))
        named = named.withColumn("__p", F.pmod(F.xxhash64("__t"), F.lit(parts)))
        found = reduce(DataFrame.unionByName, [_scan(texts, named.where(F.col("__p") == p).select("__t"), key, text, unless, term) for p in range(parts)])
        return found if unique else found.distinct()
    found = _by_substrings(texts, named, key, text, term).distinct()
    if unless:
        inside = _by_substrings(texts, named, key, unless, term).distinct().select(F.col(key).alias("__k"), F.col(term).alias("__t"))
        found = found.join(inside, F.col(key).eqNullSafe(F.col("__k")) & (F.col(term) == F.col("__t")), "left_anti")
    return found


def token_join(texts: DataFrame, terms: DataFrame, tokens: Column, key: str = "key", term: str = "term") -> DataFrame:
    """(key, term, n): how often a text has each term as a token."""
    return texts.select(key, F.explode(tokens).alias(term)).join(terms.select(term).distinct(), term).groupBy(key, term).agg(F.count("*").alias("n"))


def unless_present(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti-join by content keys, never by rank."""
    return rows.join(other.select(*keys).distinct(), list(keys), "left_anti")


def prefix_leak(rows: DataFrame, frozen: DataFrame, text: str, n: int = 60) -> DataFrame:
    """Rows whose first n characters do not begin any frozen text."""
    heads = frozen.select(F.substring(text, 1, n).alias("__head")).distinct()
    return rows.join(heads, F.substring(rows[text], 1, n) == heads["__head"], "left_anti")


def join_excluding_missing(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Left join; missing marks rows without a prediction, which every denominator must leave out."""
    return gold.join(pred.withColumn("__hit", F.lit(True)), key, "left").withColumn("missing", F.col("__hit").isNull()).drop("__hit")


def join_missing_is_wrong(gold: DataFrame, pred: DataFrame, key: str, gold_col: str, pred_col: str) -> DataFrame:
    """agrees: false where the prediction is missing."""
    return gold.join(pred, key, "left").withColumn("agrees", F.coalesce(F.col(pred_col) == F.col(gold_col), F.lit(False)))


def join_by_position(gold: DataFrame, pred: DataFrame, key: str, gold_array: str, pred_array: str) -> DataFrame:
    """(key, pos, gold, pred): a short prediction is false at the end; a case without one is left out."""
    both = gold.select(key, gold_array).join(pred.select(key, pred_array), key)
    return both.select(key, F.posexplode(gold_array).alias("pos", "gold"), pred_array).select(key, "pos", "gold", F.coalesce(F.get(pred_array, F.col("pos")), F.lit(False)).alias("pred"))


def join_by_index(left: DataFrame, right: DataFrame, key: str, array: str) -> DataFrame:
    """Elements of two arrays of structs with an idx meet by (key, idx); what the right side lacks is not compared."""
    of = lambda df, side: df.select(key, F.explode(array).alias(side)).withColumn("idx", F.col(f"{side}.idx"))
    return of(left, "a").join(of(right, "b"), [key, "idx"])


def arms(cases: DataFrame, a: DataFrame, b: DataFrame, judges: int, key: str = "id") -> DataFrame:
    """Cases with non-empty outputs of both arms, once for each judge."""
    side = lambda df, name: df.select(key, F.coalesce("output", F.lit("")).alias(name)).where(F.col(name) != "")
    return cases.join(side(a, "output_a"), key).join(side(b, "output_b"), key).withColumn("judge", F.explode(F.sequence(F.lit(0), F.lit(judges - 1))))
