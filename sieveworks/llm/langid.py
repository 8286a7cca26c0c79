"""Language identification by nearest centroid.

A text becomes a vector of hashed letter trigrams (word ends included), TF-IDF weighted and normalised. Each language
has several centroids, found by spherical k-means over a bounded sample of labelled rows: at most `per_lang` rows of a language, the
first by a hash. A text gets the language of the centroid with the largest cosine.

Rejection is by distance. Short texts lie further from any centroid than long ones, so the sample's texts, whole and in pieces of
several lengths, tell for each language and class of length which cosines its own texts have: a text is rejected if its
cosine is under `slack` times the `least` quantile of those, or under their `usual` quantile and hardly above that of another language.

Fitting sends only the sample's sparse counts to the driver, which makes vectors of one language at a time; predicting is one pass over the
texts with numpy and no shuffle, whatever the keys are like.

Defined results: null text, or text with no letter: `und`, score 0, rejected. No labelled rows or an empty table: the same for all.
Ties go to the language that sorts first. Very long texts are counted as a whole. Repeated rows are predicted each; output columns replace
input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import runs_of_rows, small_batches, text_buffers, without

UNKNOWN = "und"

#: Bytes to symbols: letters a-z are 1..26, bytes of longer characters 27 and up, all others 0 (a gap).
SYMBOL = np.zeros(256, dtype=np.uint32)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)


#: Lower ends of the classes of length, in trigrams, and the lengths in bytes of the pieces that are looked at.
LENGTHS = np.array([0, 12, 24, 48, 96, 192, 384, 768])
PIECES = (24, 48, 96, 192, 384)
QUANTILES = (0.005, 0.05)
#: Share of the least quantile that is still accepted; share of the best cosine above which another language is as near.
SLACK, AS_NEAR = 0.8, 0.95


@dataclass(frozen=True)
class CentroidModel:
    langs: list[str]
    owner: np.ndarray  # of each centroid, an index into langs
    centroids: np.ndarray  # (dim, n_centroids), idf already multiplied in
    idf2: np.ndarray  # squared idf, for the norm
    least: np.ndarray  # of each language and class of length, the least quantile of its own texts' cosines
    usual: np.ndarray  # the same for the usual quantile
    dim: int


def counts(data: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """(rows, dim) trigram counts of the texts between the offsets; a gap stands before and after each text."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    size = int(offsets[-1] - offsets[0])
    symbols = np.zeros(size + 2 * n, dtype=np.uint32)
    rows = np.repeat(np.arange(n, dtype=np.uint32), lengths)
    symbols[np.arange(size) + 2 * rows.astype(np.int64) + 1] = SYMBOL[data[offsets[0] : offsets[-1]]]
    of_row = np.repeat(np.arange(n, dtype=np.uint32), lengths + 2)
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    code = (a * np.uint32(2654435761) + b * np.uint32(2246822519) + c * np.uint32(3266489917)) >> np.uint32(7)
    code = (code ^ (code >> np.uint32(11))) % np.uint32(dim)
    # the middle symbol is a letter, all three belong to one text
    keep = (b > 0) & (of_row[:-2] == of_row[2:])
    return np.bincount(of_row[1:-1][keep].astype(np.int64) * dim + code[keep], minlength=n * dim).reshape(n, dim)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def pieces(raw: bytes) -> list[bytes]:
    """A piece of each length out of the middle of a longer text, cut at blanks."""
    out = []
    for n in PIECES:
        if len(raw) > 2 * n:
            start = raw.find(b" ", len(raw) // 2 - n // 2)
            stop = raw.find(b" ", start + n)
            if 0 <= start < stop < start + 2 * n:
                out.append(raw[start:stop])
    return out


def fit(labelled: DataFrame, text_col: str, lang_col: str, order: Column, dim: int = 8192, per_lang: int = 400, centroids: int = 4) -> CentroidModel:
    """labelled: the rows to learn from. order: an expression whose hash picks the sample. per_lang: at most so many rows of a language are learned from."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(order), 1).alias("__order"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    none = np.zeros((len(langs), len(LENGTHS)))
    if not langs:
        return CentroidModel([], np.zeros(0, int), np.zeros((dim, 0), np.float32), np.ones(dim, np.float32), none, none, dim)
    # a share of the hashes twice as large as needed thins the rows out, and the first per_lang of those are taken
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, 2 * per_lang / sizes[lang] + 1e-12) * ((1 << 63) - 1)) if 2 * per_lang < sizes[lang] else (1 << 63) - 1))])
    few = rows.where(F.col("__order") <= share[F.col("lang")])
    sample = few.withColumn("__rank", F.row_number().over(Window.partitionBy("lang").orderBy("__order", "text"))).where(F.col("__rank") <= per_lang).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                parts = [raw, *pieces(raw)]
                m = counts(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), dim)
                at = [np.flatnonzero(x) for x in m]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array([k == 0 for k in range(len(parts))]), pa.array([x.astype("<u4").tobytes() for x in at], pa.binary()), pa.array([r[x].astype("<u4").tobytes() for r, x in zip(m, at, strict=True)], pa.binary())], ["lang", "whole", "at", "n"])

    got = sorted((r["lang"], r["whole"], bytes(r["at"]), bytes(r["n"])) for r in sample.mapInArrow(sparse, "lang string, whole boolean, at binary, n binary").collect())
    seen, n_whole = np.zeros(dim), sum(r[1] for r in got)
    for _, whole, at, _ in got:
        if whole:
            seen[np.frombuffer(at, "<u4")] += 1
    idf = np.log((1 + n_whole) / (1 + seen)).astype(np.float32) + 1
    owner, centres, least, usual = [], [], none.copy(), none.copy()
    for k, lang in enumerate(langs):
        own = [r for r in got if r[0] == lang]
        x = np.zeros((len(own), dim), dtype=np.float32)
        for row, (_, _, at, n) in zip(x, own, strict=True):
            row[np.frombuffer(at, "<u4")] = np.frombuffer(n, "<u4")
        length, whole = x.sum(axis=1), np.array([r[1] for r in own])
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        if not (learn := whole & (length > 0)).any():
            continue
        c = spherical_kmeans(x[learn], centroids)
        centres.append(c)
        owner += [k] * len(c)
        cosine, of = (x @ c.T).max(1), length_class(length)
        for b in range(len(LENGTHS)):
            # a class that few texts show takes what shorter ones do
            at = cosine[of == b]
            least[k, b], usual[k, b] = np.quantile(at, QUANTILES) if len(at) >= 20 else (least[k, b - 1], usual[k, b - 1]) if b else (0.0, 0.0)
        for of_class in (least, usual):  # no class asks for more than a longer one does, and the shortest texts tell nothing
            of_class[k] = np.minimum.accumulate(of_class[k, ::-1])[::-1]
            of_class[k, 0] = 0.0
    c = np.concatenate(centres) if centres else np.zeros((0, dim), np.float32)
    return CentroidModel(langs, np.array(owner, dtype=int), np.ascontiguousarray((c * idf).T.astype(np.float32)), idf**2, least, usual, dim)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, side="right") - 1


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts from the mean's farthest rows, so the result is the same each time."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    c = unit(x.mean(0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.concatenate([c, x[[np.argmin((x @ c.T).max(1))]]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([unit(x[near == i].mean(0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def predict(model: CentroidModel, column: pa.Array, slack: float = SLACK) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    n = len(column)
    lang, score, rejected = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
    if not n or not model.centroids.shape[1]:
        return list(lang), score, rejected
    data, offsets = text_buffers(column)
    letters = has_letter(column)
    for i, j in runs_of_rows(offsets, 1 << 18):
        for i2 in range(i, j, 64):
            j2 = min(j, i2 + 64)
            m = counts(data, offsets[i2 : j2 + 1], model.dim).astype(np.float32)
            cosine = (m @ model.centroids) / np.maximum(np.sqrt((m * m) @ model.idf2), 1e-9)[:, None]
            best = cosine.argmax(1)
            top = np.clip(cosine[np.arange(j2 - i2), best], 0, 1).astype(float)
            k = model.owner[best]
            ok = letters[i2:j2]
            lang[i2:j2] = np.where(ok, np.array(model.langs, dtype=object)[k], UNKNOWN)
            score[i2:j2] = np.where(ok, top, 0.0)
            of = length_class(m.sum(axis=1))
            second = np.where(model.owner[None, :] == k[:, None], -1.0, cosine).max(axis=1)
            far = (top < slack * model.least[k, of]) | ((top < model.usual[k, of]) & (second > AS_NEAR * top))
            rejected[i2:j2] = ~ok | far
    return list(lang), score, rejected


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """docs with lang_pred, score and rejected in front of no column of theirs: the new ones come last."""
    kept = without(docs, "lang_pred", "score", "rejected")
    at = kept.columns.index(text_col)
    shared = kept.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = predict(shared.value, batch.column(at), slack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], schema.names)

    return kept.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: CentroidModel, text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~predict(shared.value, batch.column(at), slack)[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_from_documents(docs: DataFrame, per_lang: int = 400) -> CentroidModel:
    """The contract's rule: labelled documents that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return fit(rows, "text", "lang", F.col("doc_id"), per_lang=per_lang)
