"""Benchmark decontamination with DataFrame functions alone.

The normalised word windows of all benchmark items, keyed by a 64-bit hash, are broadcast once. A document's window starts are
generated and hashed inside one code-generated stage, looked up in that hash set, and a hit counts only where the window's words are
equal too; all other starts end there, so no window of a document is shuffled. The start -1 carries the document itself, so one pass
gives both its word count and its hits, which meet again by (hash of id and text).

The broadcast is bounded by its bytes (`most_bytes`, measured first). A larger benchmark goes another way: a bitmap of its hashes of fixed size
(BITMAP_ROWS rows) is broadcast, and the starts that it lets through meet the windows by a shuffled join, whose skewed keys Spark splits.

Defined results: null or empty text has no words and no hits; null or wordless items have no windows; items of the same id
are one item; an empty benchmark leaves every document clean; a window of several items counts for all of them; repeated rows give
one result each; rows of one id with unlike texts are told apart by their texts; a very long text is one row of starts after the
other, and only its hits are held together; the operator's output columns replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved, without

#: Fixed value: the words of the contract, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, by the characters that are left; Java matches this form some 20 times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Bytes of windows and item ids that may be broadcast; rows of 64 bits of the bitmap beyond; contaminated rows whose keys may be broadcast.
MOST_BYTES, BITMAP_ROWS, MOST_KEYS = 64 << 20, 1 << 20, 1_000_000
KEYS = ["__key", "__more"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, size, window): every run of n words; the whole item if it has fewer, but not none."""
    words = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.lit(n), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    return words.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i, size), " "))).alias("window"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with 128 bits of each row's id and text."""
    return docs.withColumns({"__key": F.xxhash64(F.col(id_col), F.col(text_col)), "__more": F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col))})


def _hash(size: int) -> Column:
    """Of the `size` words from `at` on; the loop over a slice is less generated code than ten arguments, and so is compiled."""
    return F.xxhash64(F.slice("words", F.col("at") + 1, F.lit(size)))


def known_windows(benchmark: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """(h, window, size, items): each distinct window with its hash and the sorted ids, as strings, of the items that hold it."""
    windows = item_windows(benchmark, item_id, item_text, n).groupBy("window", "size").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return windows.select(F.xxhash64(F.split("window", " ")).alias("h"), "window", "size", "items")


def starts_of(docs: DataFrame, id_col: str, text_col: str, sizes: list[int]) -> DataFrame:
    """(keys, id, n_words, words, at, size, h): a row for each start and size, and one with at = -1 for each document."""
    rows = keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).select(*KEYS, id_col, words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - (min(sizes) if sizes else 1)))))
    of = lambda s: F.when((F.col("at") >= 0) & (F.col("at") + s <= F.col("n_words")), _hash(s))
    if len(sizes) < 2:
        return rows.withColumns({"size": F.lit(sizes[0] if sizes else 1), "h": of(sizes[0]) if sizes else F.lit(None).cast("long")})
    every = F.array(*[F.struct(F.lit(s).alias("size"), of(s).alias("h")) for s in sizes])
    one = F.array(F.struct(F.lit(0).alias("size"), F.lit(None).cast("long").alias("h")))
    return rows.withColumn("w", F.explode(F.when(F.col("at") < 0, one).otherwise(every))).select(*rows.columns, "w.size", "w.h")


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, id, n_words, at, size, items): the verified hits, and one row with at = -1 for each document."""
    known = saved(known_windows(benchmark, item_id, item_text, n), "windows")
    held = known.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64 + 16 * F.size("items")).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    starts = starts_of(docs, id_col, text_col, sorted(held["sizes"]))
    text = F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ")
    kept = [*KEYS, id_col, "n_words", "at", "size", "items"]
    right = known.select(F.col("h").alias("__h"), F.col("window").alias("__window"), F.col("items"))
    if (held["bytes"] or 0) <= most_bytes:
        # equality of texts as two prefixes: as a second key it would be built for every start, not only for equal hashes
        same = text.startswith(F.col("__window")) & F.col("__window").startswith(text)
        joined = starts.join(F.broadcast(right), (F.col("h") == F.col("__h")) & same, "left")
        return joined.where("at = -1 OR items IS NOT NULL").select(*kept)
    word, bit = (lambda h: F.pmod(F.shiftright(h, 6), F.lit(BITMAP_ROWS))), (lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")))
    bitmap = known.groupBy(word(F.col("h")).alias("__word")).agg(F.bit_or(bit(F.col("h"))).alias("__mask"))
    passed = starts.join(F.broadcast(bitmap), word(F.col("h")) == F.col("__word"), "left").where(F.col("at").eqNullSafe(-1) | (F.col("__mask").bitwiseAND(bit(F.col("h"))) != 0))
    maybe = passed.where("at >= 0").select(*KEYS, id_col, "n_words", "at", "size", "h", text.alias("__text"))
    hits = maybe.join(right.hint("merge"), (F.col("h") == F.col("__h")) & (F.col("__text") == F.col("__window")))
    own = keyed(docs.select(id_col, text_col), id_col, text_col).select(*KEYS, id_col, F.size(words_of(F.col(text_col))).alias("n_words"), F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("items"))
    return hits.select(*kept).unionByName(own)


def with_spans(rows: DataFrame) -> DataFrame:
    """rows with __at, the sorted words inside any of __hits (at, size), and __spans, the merged (start, stop) ranges; work is linear in the hits."""
    rows = rows.withColumn("__at", F.expr("array_sort(array_distinct(flatten(transform(__hits, h -> sequence(h.at, h.at + h.size - 1)))))"))
    rows = rows.withColumn("__first", F.expr("filter(__at, (x, i) -> i = 0 OR get(__at, i - 1) < x - 1)"))
    rows = rows.withColumn("__last", F.expr("filter(__at, (x, i) -> i = size(__at) - 1 OR get(__at, i + 1) > x + 1)"))
    return rows.withColumn("__spans", F.expr("transform(arrays_zip(__first, __last), p -> struct(p.__first AS start, p.__last + 1 AS stop))")).drop("__first", "__last")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_words, n_hit, items, spans), one row for each row of docs.

    items: sorted distinct ids, as strings, of items with an occurring window. spans: merged (start, stop) word ranges, stop exclusive.
    """
    found = search(docs, benchmark, id_col, text_col, **how)
    hit = F.col("at") >= 0
    rows = found.groupBy(*KEYS).agg(
        F.first(id_col).alias(id_col),
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("at") == -1).alias("__copies"),
        F.collect_set(F.when(hit, F.struct("at", "size"))).alias("__hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("__items"),
    )
    rows = with_spans(rows)
    out = rows.select(id_col, "n_words", F.size("__at").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("__items"))).alias("items"), F.col("__spans").alias("spans"), *KEYS, "__copies")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop(*KEYS, "__copies", "__copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Drops every row with a hit; the rest keep their columns.

    The keys of contaminated rows are counted: few are broadcast; of more, texts are shuffled for the anti-join.
    """
    keys = saved(search(docs, benchmark, id_col, text_col, **how).where("at >= 0").select(*[F.col(k).alias(f"{k}_hit") for k in KEYS]).distinct(), "contaminated")
    few = keys.count() <= MOST_KEYS
    on = [F.col(k) == F.col(f"{k}_hit") for k in KEYS]
    return keyed(docs, id_col, text_col).join(F.broadcast(keys) if few else keys.hint("merge"), on, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Cuts the hit words out of the texts; what stands between two words that both go, goes with them."""
    found = search(docs, benchmark, id_col, text_col, **how).where("at >= 0").groupBy(*KEYS).agg(F.collect_set(F.struct("at", "size")).alias("__hits"))
    kept = with_spans(keyed(without(docs, *KEYS), id_col, text_col).join(found, KEYS, "left"))
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    kept = kept.withColumn("__words", F.regexp_extract_all(F.col(text_col), F.lit(word), F.lit(0))).withColumn("__gaps", F.split(F.col(text_col), word, -1))
    kept = kept.withColumn("__tokens", F.expr("transform(__words, (w, i) -> concat(w, __gaps[i + 1]))"))
    # the words before each span and the gap behind it, then the words after the last span
    piece = """concat(array_join(slice(__tokens, CASE WHEN i = 0 THEN 1 ELSE __spans[i - 1].stop + 1 END, (CASE WHEN i = size(__spans) THEN size(__tokens) ELSE __spans[i].start END) - (CASE WHEN i = 0 THEN 0 ELSE __spans[i - 1].stop END)), ''),
        CASE WHEN i = size(__spans) THEN '' ELSE __gaps[__spans[i].stop] END)"""
    cut = f"concat(__gaps[0], array_join(transform(sequence(0, size(__spans)), i -> {piece}), ''))"
    return kept.withColumn(text_col, F.when(F.col("__hits").isNotNull(), F.expr(cut)).otherwise(F.col(text_col))).select(*docs.columns)
