"""Sequence packing by best-fit decreasing.

A document's ids are cut into full windows first; each full window is a sequence of its own. The rests, all shorter
than a window, go into open windows by best-fit decreasing: longest first, each into the open window with the least
room that still holds it, which a segment tree over remaining capacities finds in O(log window).

Every input partition packs its own rests (in groups of `group` of them, which bounds a task's memory), so no text and no token
is ever shuffled, a hot source changes nothing, and a lost task gives the same sequences again: the sequence id is
made of the partition's number and a counter in it.

Defined results: null text counts as empty (one id, the end id); an empty table gives no rows; repeated rows are
packed once for each row; ties in length keep input order; null ids pass through; other columns are ignored, whatever their names; a very long
text is encoded as a whole and cut into full windows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, without


#: The vocabulary's only added token and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256


class CapacityTree:
    """Segment tree over capacities 0..limit; a leaf holds the open windows with just that much room."""

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity >= need that is open; None if there is none."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: list[int] | np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, all between 1 and limit; windows are numbered from 0."""
    tree, placed, opened = CapacityTree(limit), [(0, 0)] * len(lengths), 0
    for i in np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable"):
        need = int(lengths[i])
        if (found := tree.pop_tightest(need)) is None:
            found, opened = (limit, opened), opened + 1
        capacity, window = found
        placed[i] = (window, limit - capacity)
        if capacity > need:
            tree.push(capacity - need, window)
    return placed


@functools.lru_cache(2)
def byte_bpe(ranks_path: str, pattern: str):
    """Encoder of the public byte-level BPE vocabulary; added tokens are ordinary text to it, `encode` tells them apart."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> np.ndarray:
    """Ids as tokenizers gives them: texts are split at the added token, whose id stands between the parts."""
    if ADDED not in text:
        return encoder.encode_to_numpy(text)
    parts = [encoder.encode_to_numpy(part) for part in text.split(ADDED)]
    return np.concatenate([parts[0], *[x for part in parts[1:] for x in (np.array([ADDED_ID], parts[0].dtype), part)]])


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, group: int = 16384) -> DataFrame:
    """One row for each piece: id, start, length, token_ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    names = ["start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType()]
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe(ranks_path, pattern), np.array([end_id], dtype="<u4")
        first = TaskContext.get().partitionId() << 40
        kind_of_id, made, full, full_bytes, rests = None, 0, [], 0, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [kind_of_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, *names])

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal made, rests
            placed = best_fit_decreasing([len(r[2]) // 4 for r in rests], window)
            for i in range(0, len(rests), 2000):
                yield batch_of([(d, s, len(raw) // 4, raw, n, first + made + w, at) for (d, s, raw, n), (w, at) in zip(rests[i : i + 2000], placed[i : i + 2000], strict=True)])
            made += 1 + max((w for w, _ in placed), default=-1)
            rests = []

        for batch in batches:
            kind_of_id = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), np.append(encode(encoder, text.as_py() or ""), end).astype("<u4", copy=False)
                total, cut = len(ids), len(ids) // window * window
                for start in range(0, cut, window):
                    full.append((doc, start, window, ids[start : start + window].tobytes(), total, first + made, 0))
                    made += 1
                if cut < total:
                    rests.append((doc, cut, ids[cut:].tobytes(), total))
                if len(full) >= 1000:
                    yield batch_of(full)
                    full = []
                if len(rests) >= group:
                    yield from settle()
        if full:
            yield batch_of(full)
        if rests:
            yield from settle()

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(pack, schema)


def with_packing(docs: DataFrame, **how) -> DataFrame:
    """pack_documents over any table that has doc_id and text; clashing columns are left out."""
    return pack_documents(without(docs, "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"), **how)
