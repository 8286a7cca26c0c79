"""Hard-negative mining by a two-dimensional block matrix multiply.

Rows that take part are ranked by (label, vec_id) and cut into blocks of `rows` rows; anchors are ranked alike and cut into blocks of `anchors`. Dimensions are cut
into chunks of `dims`. A block's chunk is one small integer matrix. Each pair of an anchor block and a row block is a tile of the score matrix: the chunks of both meet by
exchanges on block and chunk, a task multiplies them to a partial int64 tile, and partial tiles are shuffled by tile and added. Components are floor(256 x), so scores are exact.

Blocks are ranges of labels, so tiles tell where they can help. Tiles whose labels overlap give each anchor's best rows of its own label, `positives` of them a tile; the
best over all tiles are the anchor's positives. Then tiles that hold different labels give, for each anchor and positive, the best `negatives` rows of another label whose score
lies in the positive's window, and again the best over all tiles count. A tile is made twice only where labels meet inside blocks. A task holds a tile and its factors, whatever
the sizes of labels; what is shuffled after the sums is top rows. A label that holds a third of the rows is so many blocks more.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null id is no anchor, and comes last among ties; a row that
is repeated is another row, so a copy of an anchor is among its positives, and repeated anchors give their rows each; vectors of different lengths multiply as if the shorter
ended in zeros; anchors without positives, and windows without rows, give no rows; an empty table gives no rows. Scores of 2^55 and beyond raise an error. Labels are whole numbers. Input columns
other than the three are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import with_rank
from .common import saved

#: A null id inside tasks: the largest number, so it comes last.
NO_ID = int(np.iinfo(np.int64).max)
#: Scores must stay below, so that a hundred of them are whole 64-bit numbers.
MOST = 2.0**55
BLOCK = "block long, chunk int, n int, wide boolean, matrix binary, ids binary, labels binary, at binary, least long, most long"
META = ["ids", "labels", "at"]
TOP = "l long, anchor_at long, anchor_id long, positive_rank int, score long, id long, at long"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def whole_components(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale x) of vectors of any lengths, as int64; shorter ones end in zeros."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(values[offsets[0] : offsets[-1]] * scale)
    if np.abs(out).max(initial=0) >= MOST:
        raise ValueError("a component is too large for exact scores")
    return out.astype(np.int64)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y.T as int64, over the columns that both have."""
    k = min(x.shape[1], y.shape[1])
    x, y = x[:, :k].astype(np.float64), y[:, :k].astype(np.float64)
    bound = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * k
    if bound >= MOST:
        raise ValueError("scores are too large to be exact")
    if bound < 2.0**53:  # every sum is a whole number that a double holds
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The n columns of the highest scores, ties by smaller id and then by place."""
    if len(columns) > n:
        border = np.partition(scores[columns], len(columns) - n)[len(columns) - n]
        columns = columns[scores[columns] >= border]
    return columns[np.lexsort((at[columns], ids[columns], -scores[columns]))][:n]


def blocks(rows: DataFrame, size: int, dims: int, scale: int) -> DataFrame:
    """rows (rank, at, id, label, vector) as one row for each block and chunk, saved; ids, labels and places stand with chunk 0."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        whole = whole_components(table.column("vector").chunk(0), scale)
        ids, labels, at = table.column("id").fill_null(NO_ID).to_numpy(), table.column("label").to_numpy(), table.column("at").to_numpy()
        out = []
        for c in range(max(1, -(-whole.shape[1] // dims))):
            part = whole[:, c * dims : (c + 1) * dims]
            wide = bool(np.abs(part).max(initial=0) >= 1 << 15)
            meta = [x.astype(np.int64).tobytes() if c == 0 else None for x in (ids, labels, at)]
            out.append((key[0].as_py(), c, len(whole), wide, part.astype(np.int64 if wide else np.int16).tobytes(), *meta, int(labels[0]), int(labels[-1])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, pa.int64(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in BLOCK.split(", ")])

    return saved(rows.withColumn("block", F.expr(f"rank DIV {size}")).groupBy("block").applyInArrow(build, BLOCK), "blocks")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def score_tiles(left: DataFrame, right: DataFrame, pairs: DataFrame, reduce_tile, schema: str) -> DataFrame:
    """reduce_tile(scores, left meta, right meta, windows) of the summed tile of each pair (left block, right block, windows)."""
    joined = pairs.join(_prefixed(left, "l_"), F.col("l") == F.col("l_block")).join(_prefixed(right, "r_"), (F.col("r") == F.col("r_block")) & (F.col("l_chunk") == F.col("r_chunk")))
    meta = [f"{side}_{m}" for side in "lr" for m in META]
    first = lambda c: F.when(F.col("l_chunk") == 0, F.col(c)).alias(c)
    factors = joined.select("l", "r", "l_n", "r_n", "l_wide", "r_wide", "l_matrix", "r_matrix", *map(first, ["windows", *meta]))
    partial = f"l long, r long, l_n int, r_n int, tile binary, windows array<bigint>, {', '.join(m + ' binary' for m in meta)}"
    names = [f.split()[0] for f in partial.split(", ")]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                of = lambda s: np.frombuffer(row[f"{s}_matrix"].as_buffer(), np.int64 if row[f"{s}_wide"].as_py() else np.int16).reshape(row[f"{s}_n"].as_py(), -1)
                row["tile"] = pa.scalar(product(of("l"), of("r")).tobytes(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row[n].as_py()], kind) for n, kind in zip(names, [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.binary(), pa.list_(pa.int64())] + [pa.binary()] * 6, strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, found = None, 0.0, {}
        for batch in batches:
            for row in range(batch.num_rows):
                part = np.frombuffer(batch.column("tile")[row].as_buffer(), np.int64).reshape(batch.column("l_n")[row].as_py(), batch.column("r_n")[row].as_py())
                total = part.copy() if total is None else np.add(total, part, out=total)
                size += float(np.abs(part).max(initial=0))
                found["l"] = batch.column("l")[row].as_py()
                found |= {m: batch.column(m)[row].as_py() for m in ["windows", *meta] if batch.column(m)[row].is_valid}
        if size >= MOST:
            raise ValueError("scores are too large to be exact")
        sides = [{m: np.frombuffer(found[f"{side}_{m}"], np.int64) for m in META} for side in "lr"]
        made = [(found["l"], *r) for r in reduce_tile(total, *sides, np.array(found.get("windows") or [], np.int64).reshape(-1, 3))]
        columns = zip(*made, strict=True) if made else [[]] * len(KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, KINDS, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return factors.mapInArrow(multiply, partial).groupBy("l", "r").applyInArrow(add, schema)


def _first(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("id"), F.col("at")]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, rows: int = 4096, anchors: int = 256, dims: int = 32) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchor: which rows of vectors are anchors.

    A negative's score, times 100, lies between the positive's times `low` and times `high`, ends included.
    """
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    part = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    part = part.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("__anchor"))
    order = [F.col("label"), F.col("id").asc_nulls_last()]
    ranked = saved(with_rank(part, order, "at"), "ranked")
    right = blocks(ranked.withColumn("rank", F.col("at")), rows, dims, scale)
    left = blocks(with_rank(ranked.where("__anchor"), [F.col("at")], "rank"), anchors, dims, scale)

    last = right.agg(F.max("block")).first()[0]
    spans = lambda df, side: df.where("chunk = 0").select(F.col("block").alias(side), F.col("least").alias(f"{side}_least"), F.col("most").alias(f"{side}_most"))
    every = spans(left, "l").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))).join(spans(right, "r"), "r")

    def own_label(scores, a, b, _):
        for i in range(len(scores)):
            columns = np.flatnonzero((b["labels"] == a["labels"][i]) & (b["at"] != a["at"][i]))
            for c in best(scores[i], b["ids"], b["at"], columns, positives):
                yield int(a["at"][i]), int(a["ids"][i]), 0, int(scores[i, c]), int(b["ids"][c]), int(b["at"][c])

    def in_windows(scores, a, b, windows):
        place = {at: i for i, at in enumerate(a["at"].tolist())}
        for at, rank, positive in windows.tolist():
            i = place[at]
            hundred = 100 * scores[i]
            columns = np.flatnonzero((b["labels"] != a["labels"][i]) & (low * positive <= hundred) & (hundred <= high * positive))
            for c in best(scores[i], b["ids"], b["at"], columns, negatives):
                yield at, int(a["ids"][i]), rank, int(scores[i, c]), int(b["ids"][c]), int(b["at"][c])

    alike = every.where("l_least <= r_most AND r_least <= l_most").select("l", "r", F.lit(None).cast("array<bigint>").alias("windows"))
    found = _first(score_tiles(left, right, alike, own_label, TOP).drop("positive_rank"), ["anchor_at"], positives, "positive_rank")
    found = saved(found, "positives")

    # each pair carries the windows of its anchors: place, rank and score of each positive
    windows = found.groupBy("l").agg(F.flatten(F.collect_list(F.array("anchor_at", F.col("positive_rank").cast("long"), "score"))).alias("windows"))
    others = every.where("NOT (l_least = r_most AND r_least = l_most)").select("l", "r").join(windows, "l").select("l", "r", "windows")
    below = _first(score_tiles(left, right, others, in_windows, TOP), ["anchor_at", "positive_rank"], negatives, "rank")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    above = found.select("anchor_at", "positive_rank", real("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return below.select("anchor_at", "anchor_id", "positive_rank", "rank", real("id").alias("negative_id"), F.col("score").alias("negative_score")).join(above, ["anchor_at", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
