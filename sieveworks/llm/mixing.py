"""Mixing sources to target weights with DataFrame functions alone.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share all words of the table by weight. A target stops at `most` times
its source's words, and the excess goes to the others by weight until none is above.

The mix: a source's documents lie one behind the other, and its words are cut into blocks of `block` words (the last one may be shorter; a block may
span documents, and a document blocks). A source draws as many blocks as come nearest to its target (within a block and a half): whole passes over all its blocks, then the
first ones of one more pass. Draw j takes block permutation(j) of its pass, a pseudorandom permutation of the source's block numbers of its own for each pass,
so no block is drawn more than once a pass, and none more than `most` times.

Output shards hold `shard` slots. Their source counts are a multinomial draw given the sources' totals: all draws of all sources are numbered, one
pseudorandom permutation of those numbers gives each its slot, and slot // shard is its shard. (Independent draws for each shard would miss small sources'
targets by the square root of their blocks, and could draw a source at its limit too often; given the totals the counts of a shard
follow the multivariate hypergeometric law, near the multinomial one where there are many shards.) Drawn blocks meet the blocks by (source, block) number.

Permutations are swap-or-not shuffles: in each round i and (k - i) mod n change places or not, by a hash of the round and the larger one of the two. That is a
permutation for any n, needs no table, and each number is mapped on its own, so all that moves between tasks is rows of numbers.
Words are counted in the scan; texts are not shuffled until `mixed_texts` asks for them. A source of any size is spread over all tasks: its places are running totals over
ranges of rows, its draws are made in runs of `RUN`, and blocks meet by hash.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source; null ids are ids; repeated rows are documents of their own; documents
of one source and id are ordered by size and text, so ties change nothing; an empty table gives no rows; very long documents are cut into many blocks;
clashing columns are left out. Reruns over the same rows agree whatever the files' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running_totals
from .common import saved

#: The weights that sources take in turn.
WEIGHTS = [1, 2, 3]
WORD = r"[^\x20\x09-\x0D]++"
#: Rounds of a permutation, and draws that one row of a task unfolds into.
ROUNDS, RUN = 24, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(i: str, n: str, key: str) -> str:
    """SQL of the place of i, 0 <= i < n, in the pseudorandom permutation of 0..n-1 that `key` (any hashable SQL values) names."""
    turn = f"pmod(xxhash64({key}, r, 'turn') , {n})"
    swapped = f"pmod({turn} - a, {n})"
    return f"""aggregate(sequence(1, {ROUNDS}), CAST({i} AS BIGINT),
        (a, r) -> CASE WHEN xxhash64({key}, r, greatest(a, {swapped})) % 2 = 0 THEN {swapped} ELSE a END)"""


def source_targets(sizes: DataFrame, weights: list[int] | None = None, most: int = 3) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds place (from 0, in code-point order, null last), weight and target.

    Each round is one sum over the sources and raises the words a unit of weight; it ends when no further source is above its limit.
    """
    weights = weights or WEIGHTS
    placed = running_totals(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    placed = saved(placed.withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    words, units = 0, 0  # of the sources that are not at their limit
    above = F.lit(False)
    while True:
        open_, closed = F.when(~above, F.col("weight")), F.when(above, limit)
        r = placed.agg(F.sum("source_size").alias("all"), F.sum(open_).alias("units"), F.sum(closed).alias("closed")).first()
        new = ((r["all"] or 0) - (r["closed"] or 0), r["units"] or 0)
        if new == (words, units):
            break
        words, units = new
        above = F.col("weight") * float(words) > limit.cast("double") * float(units)
    share = F.col("weight") * float(words) / float(units) if units else F.lit(0.0)
    return placed.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, mark, row) of each row of docs, saved; row is unique, and names it in the mix."""
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("mark"))
    return saved(narrow.withColumn("row", F.monotonically_increasing_id()), "sized")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[int] | None = None, most: int = 3, block: int = 128, shard: int = 1024, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, rows, sources). pieces: (shard, slot, source_place, pass, block, row, doc_id, start, length), `length` words of a document from word `start`, of each drawn block, in the order of start_in_block.

    rows: sized(docs); sources: (source, source_size, place, weight, target, blocks, draws).
    """
    rows = sized(docs, id_col, text_col, source_col)
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")).cast("long"), F.lit(most))).otherwise(F.lit(0))
    rest = F.when(passes < most, F.least(F.round((F.col("target") - passes * F.col("source_size")) / block).cast("long"), blocks)).otherwise(F.lit(0))
    sources = sources.withColumn("blocks", blocks).withColumn("draws", passes * F.col("blocks") + rest)
    sources = saved(running_totals(sources, [F.col("place")], {"first_draw": F.col("draws")}), "targets")
    total = sources.agg(F.sum("draws").alias("n")).first()["n"] or 0

    runs = sources.where("draws > 0").select("place", "blocks", "draws", "first_draw", F.explode(F.expr(f"sequence(0L, draws - 1, {RUN}L)")).alias("from"))
    runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "from")  # few rows, of much work each
    drawn = runs.select("place", "blocks", "first_draw", F.explode(F.expr(f"sequence(from, least(from + {RUN}, draws) - 1)")).alias("draw"))
    drawn = drawn.select("place", "blocks", (F.col("first_draw") + F.col("draw")).alias("card"), F.expr("draw DIV blocks").alias("pass"), (F.col("draw") % F.col("blocks")).alias("i"))
    drawn = drawn.select("place", "pass", F.expr(permuted("i", "blocks", f"{seed}, place, pass")).alias("block"), F.expr(permuted("card", f"{max(total, 1)}L", f"{seed}, 'deck'")).alias("slot"))
    drawn = saved(drawn, "draws")  # a table's size is known, so it is only broadcast where it is small

    at = running_totals(rows, [F.col("doc_id"), F.col("size"), F.col("mark")], {"offset": F.col("size")}, by=["source"]).where("size > 0")
    placed = at.join(sources.select(F.col("source").alias("__s"), "place"), F.col("source").eqNullSafe(F.col("__s")))
    cut = placed.select("place", "row", "doc_id", "size", "offset", F.explode(F.expr(f"sequence(offset DIV {block}, (offset + size - 1) DIV {block})")).alias("block"))
    begin, end = F.greatest(F.col("offset"), F.col("block") * block), F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.select("place", "block", "row", "doc_id", (begin - F.col("offset")).alias("start"), (end - begin).alias("length"), (begin - F.col("block") * block).alias("start_in_block"))
    pieces = drawn.join(cut, ["place", "block"]).select(F.expr(f"slot DIV {shard}").alias("shard"), (F.col("slot") % shard).alias("slot"), F.col("place").alias("source_place"), "pass", "block", "start_in_block", "row", "doc_id", "start", "length")
    return pieces, rows, sources


def taken(docs: DataFrame, **how) -> DataFrame:
    """A row for each of docs: (doc_id, size, source_size, target, taken, source), taken: the words the mix takes of it, repeats counted."""
    pieces, rows, sources = mix(docs, **how)
    words = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    per_source = sources.select(F.col("source").alias("__s"), "source_size", "target")
    out = rows.join(words, "row", "left").join(per_source, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: (shard, slot, source_place, words), a drawn block's words in order.

    Texts are cut into their blocks before they move, and a block's words are at most `block` of them.
    """
    pieces, rows, _ = mix(docs, id_col, text_col, source_col, **how)
    text = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__mark"), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))
    pieces = saved(pieces.join(rows.select("row", "mark"), "row"), "pieces")
    cuts = pieces.select("doc_id", "mark", "start", "length").distinct()
    held = text.dropDuplicates(["__id", "__mark"])  # repeated rows are one text here
    cuts = cuts.join(held, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("start").alias("__start"), F.col("length").alias("__length"), F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("words"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")) & (F.col("start") == F.col("__start")) & (F.col("length") == F.col("__length"))
    used = pieces.join(cuts, same).groupBy("shard", "slot", "source_place").agg(F.array_sort(F.collect_list(F.struct("start_in_block", "words"))).alias("parts"))
    return used.select("shard", "slot", "source_place", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))
