"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and a perplexity for every document.

The model is over pairs of words. A word is a run of letters, digits and bytes of longer characters with A-Z lower-cased; ideographs
and kana are words of their own, and so is each other sign. The vocabulary is the `VOCABULARY` commonest words of the trusted texts (a
documented parameter of the model, which bounds the arrays that all tasks hold); every other word is one class, priced further by its spelling
(character 4-grams over 32 classes of bytes, spread evenly over the bytes of a class). Pairs are all those that the trusted texts hold, so
what scoring gathers grows with the corpus.

Pair counts are summed in each task and then by pair. They are dealt into shards by the first word. Documents are taken in blocks: a block's
distinct pairs, each with the documents that hold it, go to the shards, which look all counts up, add up what the known pairs give each
document and send back one number for each document of the block. So a pair is sent once for a block, not once for a document, and
texts are not shuffled. What needs no pair (back-off weights, the words' own continuation probabilities, spelling) is added in the block's task.

A fifth of the trusted texts, by a hash of the text, is held out of the model; its perplexities give the thresholds. A document is kept if its
perplexity (per byte of its words, with one for the end of each) is at most `slack` times the `quantile` of the held-out documents of its
language. Quantiles are merged sketches, a row a language.

Defined results: null, empty or letterless text has no perplexity and is rejected. A null or untrusted language takes the quantile over all
held-out documents; where none is held out, that of the trusted ones. Without trusted text no document has a threshold, and all with a perplexity are kept. An empty
table gives an empty result. Repeated rows are scored each; several labels of a document count once; a very long text is scored in pieces cut at
white space, which add up to the whole. Output columns replace input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, LOWER_TABLE, saved, small_batches, text_buffers, thin_batches

#: Size of the vocabulary, a power of two, with the class of all other words (0) and the start of a text (1); pairs in a shard, shards at least and at most;
#: documents whose requests meet one copy of a shard; bytes of text in a block; trusted ids that may be broadcast.
VOCABULARY, OTHER, FIRST = 1 << 15, 0, 1
BITS = VOCABULARY.bit_length() - 1
SHARD_PAIRS, SHARDS_LEAST, SHARDS_MOST, SALT_DOCUMENTS, BLOCK_BYTES, MOST_TRUSTED = 2_000_000, 16, 1000, 500_000, 16 << 20, 2_000_000

#: Bytes of text that are taken apart into words at once, which takes some 80 times as much memory.
PIECE_BYTES = 1 << 18

K, ORDER = 32, 4
CELLS = K**ORDER

#: Bytes to symbols.
SYMBOL = np.full(256, 28, dtype=np.int32)  # punctuation and the rest
SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[48:58] = 27
SYMBOL[128:192] = 29
SYMBOL[192:224] = 30
SYMBOL[224:] = 31

#: Lower-cased bytes in each class; the gap stands for the end of a word.
MEMBERS = np.bincount(np.delete(SYMBOL, np.arange(65, 91)), minlength=K)
MEMBERS[0] = 1
#: Lead bytes of characters that are words of their own: U+3000 to U+9FFF and beyond U+FFFF.
ALONE = np.zeros(256, dtype=bool)
ALONE[0xE3:0xEA] = ALONE[0xF0:] = True
#: White space 0, words 1, signs 2.
KIND = np.full(256, 2, dtype=np.int8)
KIND[48:58] = KIND[97:123] = KIND[128:] = 1
KIND[IS_SPACE] = 0
#: Odd multiplier of the word hashes, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram codes, row of each) of the texts between the offsets; three gaps stand before each text."""
    n, lengths, first = len(offsets) - 1, np.diff(offsets), int(offsets[0])
    size = int(offsets[-1]) - first
    rows = np.repeat(np.arange(n), lengths)
    symbols = np.zeros(size + 3 * n, dtype=np.int32)
    at = np.arange(size) + 3 * (rows + 1)
    symbols[at] = SYMBOL[data[first : first + size]]
    code = symbols[at]
    for back in range(1, ORDER):
        code = code + symbols[at - back] * K**back
    return code, rows


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each word with a blank behind it, offsets of the words, row of each, hash of each) of the texts between the offsets."""
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    low = LOWER_TABLE[data[first : first + size]]
    kind, rows = KIND[low], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    head = (low & 0xC0) != 0x80
    lead = np.maximum.accumulate(np.where(head, np.arange(size), 0))
    alone = ALONE[low[lead]]
    begins = np.ones(size, dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (rows[1:] != rows[:-1]) | (head[1:] & (alone[1:] | alone[:-1]))
    keep = kind > 0
    low, rows = low[keep], rows[keep]
    at = np.flatnonzero(begins[keep])
    lengths = np.diff(np.append(at, len(low)))
    powers = np.ones(len(low) + 1, np.uint64)
    powers[1:] = BASE
    back = np.ones(len(low) + 1, np.uint64)
    back[1:] = INVERSE
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * np.cumprod(powers)[:-1], out=sums[1:])
    hashes = mixed((sums[at + lengths] - sums[at]) * np.cumprod(back)[at])
    spaced = np.full(len(low) + len(at), 32, np.uint8)
    spaced[np.arange(len(low)) + np.repeat(np.arange(len(at)), lengths)] = low
    return spaced, np.append(0, np.cumsum(lengths + 1)), rows[at], hashes


def pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(offsets, row of each piece) of runs of pieces of some `most` bytes; longer rows are cut at white space."""
    at, rows = [int(offsets[0])], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        first = True
        while first or a < b:
            stop = b
            if b - a > most:
                blanks = np.flatnonzero(IS_SPACE[data[a + most // 2 : a + most]])
                if len(blanks):
                    stop = a + most // 2 + int(blanks[-1]) + 1
                else:
                    later = np.flatnonzero(IS_SPACE[data[a + most : b]])
                    stop = a + most + int(later[0]) + 1 if len(later) else b
            if rows and stop - at[0] > most:
                yield np.array(at, np.int64), np.array(rows)
                at, rows = [a], []
            at.append(stop)
            rows.append(row)
            a, first = stop, False
    if rows:
        yield np.array(at, np.int64), np.array(rows)


class Words:
    """The words of rows: (row, id, id of the word before, spelling's log-probability, bytes) of each."""

    def __init__(self, vocabulary: np.ndarray | None = None, spell: np.ndarray | None = None) -> None:
        self.vocabulary, self.spell = vocabulary, spell  # sorted hashes; ids 2 and up in that order

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, OTHER)

    def of(self, data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        last, last_row = FIRST, -1
        for at, row_of in pieces(data, offsets, most):
            spaced, ends, piece, hashes = split_words(data, at)
            if not len(piece):
                continue
            now, row = self.ids(hashes), row_of[piece]
            before = np.append(last, now[:-1])
            before[row != np.append(last_row, row[:-1])] = FIRST
            last, last_row = int(now[-1]), int(row[-1])
            log = np.add.reduceat(self.spell[codes(spaced, ends)[0]], ends[:-1], dtype=np.float64) if self.spell is not None else None
            yield row, now, before, log, np.diff(ends) - 1


def count_cells(trusted: DataFrame, text_col: str) -> DataFrame:
    """(cell, n) over the words of all rows; each task sends the cells that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for at, _ in pieces(data, offsets, PIECE_BYTES):
                spaced, ends, _, _ = split_words(data, at)
                total += np.bincount(codes(spaced, ends)[0], minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    return trusted.select(text_col).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (natural) of the last symbol of each cell, given the ones before it."""
    table = counts.reshape((K,) * ORDER).astype(np.float64)
    tables = [table]
    for _ in range(ORDER - 1):  # continuation counts: how many symbols stand before
        tables.append((tables[-1] > 0).sum(axis=0).astype(np.float64))
    p = np.full(K, 1 / K)
    for c in reversed(tables):
        n1, n2, n3, n4 = (float((c == i).sum()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = np.array([0.0, 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)])
        d[1:] = np.clip(d[1:], 0.1, [1, 2, 3])
        take = d[np.minimum(c, 3).astype(int)]
        sums = c.sum(axis=-1, keepdims=True)
        held = take.sum(axis=-1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(sums > 0, (np.maximum(c - take, 0) + held * p) / np.maximum(sums, 1), p)
    return np.log(np.maximum(p, 1e-12)).reshape(-1)


def spelling(trusted: DataFrame, text_col: str = "text") -> np.ndarray:
    """The spelling model's log-probabilities, 4 MB; at most CELLS rows reach the driver."""
    got = count_cells(trusted, text_col).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return (kneser_ney(counts) - np.log(np.resize(MEMBERS, CELLS))).astype(np.float32)


def vocabulary_of(trusted: DataFrame, text_col: str) -> np.ndarray:
    """The sorted hashes of the commonest words; at most VOCABULARY rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for at, _ in pieces(data, offsets, PIECE_BYTES):
                held.append(split_words(data, at)[3])
                size += len(held[-1])
                if size >= 1_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = trusted.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - 2).select("word").toArrow()
    return np.sort(got["word"].to_numpy().view(np.uint64))


def count_pairs(trusted: DataFrame, shared, text_col: str) -> DataFrame:
    """(code, n) of every pair of words over all rows; code: the id of the word before, then that of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(shared.value[0]), [], 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n.astype(np.int32))], ["code", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for _, now, before, *_ in words.of(data, offsets, PIECE_BYTES):
                held.append((before << BITS | now).astype(np.uint32))
                size += len(now)
                if size >= 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return trusted.select(text_col).mapInArrow(run, "code int, n int").groupBy("code").agg(F.sum("n").alias("n"))


def packed(x: np.ndarray) -> tuple[bytes, bytes]:
    """Small numbers as a byte each; 255 stands for one that is in the second part."""
    return np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype("<u4").tobytes()


def unpacked(low: bytes, wide: bytes) -> np.ndarray:
    x = np.frombuffer(low, np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(wide, "<u4")
    return x


@dataclass(frozen=True)
class PairModel:
    """What every task holds; all arrays are of fixed size."""

    vocabulary: np.ndarray
    spell: np.ndarray
    log_p: np.ndarray  # of each id: its continuation probability
    log_b: np.ndarray  # of each id as the word before: the weight of what backs off
    c1: np.ndarray  # of each id as the word before: its count
    discounts: list[float]

    def bonus(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a known pair adds to the log-probability that backing off alone gives."""
        v, w = code >> BITS, code & (VOCABULARY - 1)
        less = n - np.array([0.0, *self.discounts])[np.minimum(n, 3)]
        return np.log1p(less / self.c1[v] * np.exp(-self.log_b[v] - self.log_p[w]))


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney's three discounts, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = (1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1))
    return [min(max(d, 0.1), i + 0.99) for i, d in enumerate(raw)]


def discounts(counts: DataFrame, column: str) -> list[float]:
    r = counts.agg(*[F.count_if(F.col(column) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    return _discounts([r[f"n{i}"] for i in (1, 2, 3, 4)])


def learn(trusted: DataFrame, text_col: str = "text") -> tuple[PairModel, DataFrame]:
    """The model and its table of pairs (code, n)."""
    small_batches(trusted.sparkSession)
    thin_batches(trusted.sparkSession)
    shared = trusted.sparkSession.sparkContext.broadcast((vocabulary_of(trusted, text_col), spelling(trusted, text_col)))
    pairs = saved(count_pairs(trusted, shared, text_col), "pairs")
    d = discounts(pairs, "n")
    n_of = lambda i: F.count_if(F.col("n") == i)
    by = lambda code: pairs.groupBy(code.alias("id")).agg(F.sum("n").alias("c"), F.count("*").alias("kinds"), (n_of(1) * d[0] + n_of(2) * d[1] + F.count_if(F.col("n") > 2) * d[2]).alias("held")).toArrow()  # noqa: E731  VOCABULARY rows at most
    first, second = by(F.shiftright("code", BITS)), by(F.col("code").bitwiseAND(VOCABULARY - 1))
    c1, b, cont = np.zeros(VOCABULARY), np.ones(VOCABULARY), np.zeros(VOCABULARY)
    at = first["id"].to_numpy()
    c1[at], b[at] = first["c"].to_numpy(), first["held"].to_numpy() / first["c"].to_numpy()
    cont[second["id"].to_numpy()] = second["kinds"].to_numpy()
    known, total = 2 + len(shared.value[0]), cont.sum()
    e = np.array([0.0, *_discounts([int((cont == i).sum()) for i in (1, 2, 3, 4)])])[np.minimum(cont, 3).astype(int)]
    p = (cont - e + e.sum() / known) / total if total else np.full(VOCABULARY, 1 / known)
    return PairModel(*shared.value, np.log(np.maximum(p, 1e-300)), np.log(b), np.maximum(c1, 1), d), pairs


def requests(docs: DataFrame, shared, carried: list[str], text_col: str, shards: int, salts: int) -> DataFrame:
    """Rows of blocks: requests (role 1) to a shard, with codes and their documents, and documents (role 2) with what needs no pair."""
    names = ["key", "role", "block", "place", "size", "words", "log", "codes", "many", "many_wide", "docs", "docs_wide", *carried]
    plain = docs.select(*carried, text_col)
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, [T.LongType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), *[T.BinaryType()] * 5], strict=False)] + [T.StructField(f.name, f.dataType) for f in plain.schema.fields[: len(carried)]])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 5]
    local_bits = 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, made = shared.value, 0
        words = Words(model.vocabulary, model.spell)
        first = TaskContext.get().partitionId() << 32
        held, rows, kept, size = [], 0, [], 0
        bytes_, n_words, log = [], [], []

        def row_batch(columns: list, n: int, kept_columns: list | None = None) -> pa.RecordBatch:
            arrays = [pa.array(c, k) if c is not None else pa.nulls(n, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, *(kept_columns or [pa.nulls(n, t) for t in types])], names)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, kept, size, made, bytes_, n_words, log
            block, out, salt = first + made, [], made % salts
            if held:
                key = np.concatenate(held)  # shard, code, document
                held = []
                key.sort()
                edges = np.searchsorted(key, np.arange(shards + 1, dtype=np.uint64) << np.uint64(BITS * 2 + local_bits))
                for s in range(shards):
                    own_key = key[edges[s] : edges[s + 1]]
                    if not len(own_key):
                        continue
                    c, d = (own_key >> np.uint64(local_bits)) & np.uint64((1 << 2 * BITS) - 1), (own_key & np.uint64((1 << local_bits) - 1)).astype(np.int64)
                    begins = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                    delta = np.diff(d, prepend=0)
                    delta[begins] = d[begins]
                    out.append((s + shards * salt, c[begins].astype("<u4").tobytes(), *packed(np.diff(np.append(begins, len(c)))), *packed(delta)))
            if out:
                cols = list(zip(*out, strict=True))
                yield row_batch([cols[0], [1] * len(out), [block] * len(out), None, [rows] * len(out), None, None, *cols[1:]], len(out))
            columns = [pa.concat_arrays(c) for c in zip(*kept, strict=True)]
            for i in range(0, rows, 10_000):
                n = min(10_000, rows - i)
                own = [c.slice(i, n) for c in columns]
                part = slice(i, i + n)
                yield row_batch([[block % shards + shards * salt] * n, [2] * n, [block] * n, np.arange(i, i + n), np.concatenate(bytes_)[part], np.concatenate(n_words)[part], np.concatenate(log)[part], None, None, None, None, None], n, own)
            held, rows, kept, size, made, bytes_, n_words, log = [], 0, [], 0, made + 1, [], [], []

        for batch in batches:
            types = [c.type for c in batch.columns[: len(carried)]]
            data, offsets = text_buffers(batch.column(len(carried)))
            n = batch.num_rows
            total, words_, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for row, now, before, spell, length in words.of(data, offsets, PIECE_BYTES):
                part = model.log_b[before] + model.log_p[now] + np.where(now == OTHER, spell, 0.0)
                logs += np.bincount(row, part, n)
                words_ += np.bincount(row, minlength=n)
                total += np.bincount(row, length, n).astype(np.int64)
                shard = (before % shards).astype(np.uint64) << np.uint64(BITS * 2 + local_bits)
                held.append(shard | (before << BITS | now).astype(np.uint64) << np.uint64(local_bits) | (row + rows).astype(np.uint64))
                size += int(length.sum())
            kept.append(batch.columns[: len(carried)])
            bytes_.append(total)
            n_words.append(words_)
            log.append(logs)
            rows += n
            if size >= BLOCK_BYTES or rows >= 1 << 16:
                yield from settle()
        if rows:
            yield from settle()

    return plain.mapInArrow(run, schema)


def answers(asked: DataFrame, pairs: DataFrame, shared, carried: list[str], shards: int, salts: int) -> DataFrame:
    """Rows of blocks: what known pairs give the documents of a block (role 1), and the documents (role 2) as they came."""
    names = ["block", "role", "place", "size", "words", "log", "sums", *carried]
    copies = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda salt: (F.pmod(F.shiftright("code", BITS), F.lit(shards)) + shards * salt).cast("long"))
    model = pairs.select(F.explode(copies).alias("key"), F.lit(0).alias("role"), "code", F.col("n").alias("count"))
    both = asked.unionByName(model, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "role")
    fields = {f.name: f for f in asked.schema.fields}
    schema = T.StructType([*[fields[n] for n in names[:6]], T.StructField("sums", T.BinaryType()), *[fields[n] for n in carried]])
    order = ["key", "role", "code", "count", "block", "place", "size", "words", "log", "codes", "many", "many_wide", "docs", "docs_wide", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, held, table = shared.value, None, [], None
        for batch in batches:
            key, role = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (role[1:] != role[:-1]))) if len(key) else []
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                part = batch.slice(a, b - a)
                if key[a] != now:
                    now, held, table = key[a], [], None
                if role[a] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy()))
                    continue
                if role[a] == 2:
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in (4, 1, 5, 6, 7, 8)] + [pa.nulls(b - a, pa.binary()), *part.columns[14:]], names)
                    continue
                if table is None:
                    known = np.concatenate([c for c, _ in held]).astype(np.int64) if held else np.zeros(0, np.int64)
                    by_code = np.argsort(known)
                    known = known[by_code]
                    table = known, model.bonus(known, np.concatenate([n for _, n in held])[by_code]) if held else np.zeros(0)
                known, bonus = table
                if not len(known):
                    continue
                found = []
                for block, n, codes_, many, many_wide, docs_, docs_wide in zip(*(part.column(i).to_pylist() for i in (4, 6, 9, 10, 11, 12, 13)), strict=True):
                    c, counts = np.frombuffer(codes_, "<u4").astype(np.int64), unpacked(many, many_wide)
                    at = np.minimum(np.searchsorted(known, c), len(known) - 1)
                    value = np.where(known[at] == c, bonus[at], 0.0)
                    run_up = np.cumsum(unpacked(docs_, docs_wide))
                    ends = np.cumsum(counts)
                    doc = run_up - np.repeat(np.append(0, run_up[ends[:-1] - 1]), counts)
                    found.append((block, np.bincount(doc, np.repeat(value, counts), n).astype("<f4").tobytes()))
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([1] * m, pa.int32()), *[pa.nulls(m, k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.float64())], pa.array([x for _, x in found], pa.binary()), *[pa.nulls(m, c.type) for c in part.columns[14:]]], names)

    return both.select(*order).mapInArrow(run, schema)


def together(found: DataFrame, carried: list[str]) -> DataFrame:
    """(size, words, log, carried columns) of each document, with the sums of its block's answers added."""
    order = ["block", "role", "place", "size", "words", "log", "sums", *carried]
    fields = {f.name: f for f in found.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            block, role = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (role[1:] != role[:-1]))) if len(block) else []
            for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, total = block[a], None
                if role[a] == 1:
                    for x in part.column(6).to_pylist():
                        own = np.frombuffer(x, "<f4").astype(np.float64)
                        total = own if total is None else total + own
                else:
                    log = part.column(5).to_numpy()
                    if total is not None:
                        log = log + total[part.column(2).to_numpy()]
                    yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(log), *part.columns[7:]], ["size", "words", "log", *carried])

    schema = T.StructType([fields[n] for n in ("size", "words", "log", *carried)])
    return found.repartition("block").sortWithinPartitions("block", "role").select(*order).mapInArrow(run, schema)


def score(docs: DataFrame, trusted: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """(size, words, log, carried columns): the bytes in words, the number of words and the log-probability of all, for each row."""
    model, pairs = learn(trusted, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shards = min(SHARDS_MOST, max(SHARDS_LEAST, -(-pairs.count() // SHARD_PAIRS)))
    salts = max(1, -(-docs.count() // SALT_DOCUMENTS))
    asked = requests(docs, shared, carried, text_col, shards, salts)
    return together(answers(asked, pairs, shared, carried, shards, salts), carried)


def maybe_trusted(docs: DataFrame, ids: DataFrame, id_col: str, bits: int = 1 << 23) -> DataFrame:
    """The rows whose hashed id is set in a bitmap of all ids: fewer texts to shuffle, none lost. The bitmap's size is fixed, whatever the number of ids."""
    at = F.pmod(F.xxhash64(F.col("__id")), F.lit(bits))
    words = ids.groupBy(F.floor(at / 32).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("mask")).toArrow()
    table = np.zeros(bits // 32, np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32))
    hashed = docs.withColumn("__at", F.pmod(F.xxhash64(F.col(id_col)), F.lit(bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            hit = (shared.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit.astype(bool)))

    return hashed.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.25) -> DataFrame:
    """(id, lang, perplexity, threshold, keep) of every document. labels: (id, quality); quality 1 is trusted."""
    good = labels.where("quality = 1").select(F.col(id_col).cast(docs.schema[id_col].dataType).alias("__id")).where("__id IS NOT NULL").distinct()
    good = saved(good, "trusted")
    of_id = F.col(id_col) == F.col("__id")
    held_out = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(5)) == 0
    texts = docs.select(id_col, text_col).where(~held_out)
    few = good.count() <= MOST_TRUSTED
    trusted = texts.join(F.broadcast(good), of_id, "left_semi") if few else maybe_trusted(texts, good, id_col).join(good.hint("merge"), of_id, "left_semi")
    rows = docs.select(F.col(id_col).alias("__0"), F.col(lang_col).alias("__1"), F.coalesce(F.col(text_col).rlike(r"[A-Za-z]|[^\x00-\x7F]"), F.lit(False)).alias("__2"), held_out.alias("__3"), F.col(text_col).alias("__text"))
    got = score(rows, trusted.withColumnRenamed(text_col, "__text"), ["__0", "__1", "__2", "__3"], "__text")
    perplexity = F.when(F.col("__2") & (F.col("words") > 0), F.exp(-F.col("log") / (F.col("size") + F.col("words"))))
    scored = saved(got.select(F.col("__0").alias(id_col), F.col("__1").alias(lang_col), perplexity.alias("perplexity"), F.col("__3").alias("__held")), "perplexity")
    own = scored.join(F.broadcast(good) if few else good, of_id, "left_semi").where("perplexity IS NOT NULL")
    edge = lambda rows: F.percentile_approx(F.when(rows, F.col("perplexity")), quantile, 10_000)
    of = (F.coalesce(edge(F.col("__held")), edge(F.lit(True))) * slack).alias("__t")
    everywhere = own.agg(of).first()["__t"]
    by_lang = saved(own.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("__lang")).agg(of), "thresholds")
    known = by_lang.count() <= 100_000
    out = scored.join(F.broadcast(by_lang) if known else by_lang, scored[lang_col] == by_lang["__lang"], "left")
    out = out.withColumn("threshold", F.coalesce("__t", F.lit(everywhere).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(id_col, lang_col, "perplexity", "threshold", keep.alias("keep"))
