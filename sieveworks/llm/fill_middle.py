"""Fill-in-middle transformation over ropes.

A text is a rope: a balanced tree whose leaves are ranges of its UTF-8 bytes that begin and end between units, and whose nodes cache how many units and code
points lie below. Units are runs of white space with the run of other characters behind it, or white space at the end alone. The tree is split at two
unit ranks, the three parts and the sentinels are concatenated in their new order, and the bytes are read off the leaves once. A split walks down one path and takes
one leaf apart, so what it costs beside that path is a leaf's scan. The inverse takes the output as a rope, splits it before and behind each sentinel, and concatenates
what is left in the text's order.

Where a text is cut and which form it takes follows from sha256 of `seed:id` alone, so tasks that run again give the same rows. Each document is transformed
in its own task; nothing is shuffled, and hot sources or copies change nothing. A task holds a few texts at a time.

Defined results: null and empty texts are plain, with the empty output; texts that hold a sentinel stay plain, so an output can always be inverted; a null id hashes as
`seed:` alone; repeated rows are transformed each, and alike; a very long text is a rope of many leaves and is cut like any other; an empty table gives no rows; input columns that clash with
the operator's own are left out, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, runs_of_rows, small_batches, text_buffers, without

#: The sentinels before prefix, suffix and middle, in that order.
SENTINELS = ["<P>", "<S>", "<M>"]
#: The order of the parts in each form.
ORDERS = {"psm": "PSM", "spm": "SPM"}
#: Bytes of a leaf, about: it ends with the unit that reaches them.
LEAF = 4096
OWN = ["n", "form", "output", "prefix_chars", "middle_chars"]


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the units of some UTF-8 bytes, all of which begin at a unit's start."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = IS_SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data))


def n_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (data, no children) or the concatenation of two ropes; the counts cover all below."""

    units: int
    points: int
    size: int
    depth: int
    data: np.ndarray | None = None
    left: Rope | None = None
    right: Rope | None = None


def leaf(data: np.ndarray, units: int | None = None) -> Rope:
    return Rope(len(unit_ends(data)) if units is None else units, n_points(data), len(data), 0, data)


EMPTY = leaf(np.zeros(0, np.uint8))


def concat(a: Rope, b: Rope) -> Rope:
    if not a.size or not b.size:
        return a if a.size else b
    return Rope(a.units + b.units, a.points + b.points, a.size + b.size, 1 + max(a.depth, b.depth), None, a, b)


def rope_of(data: np.ndarray, bytes_a_leaf: int = LEAF) -> Rope:
    """A balanced rope; units are found a stretch at a time, so what is held beside the text is bounded."""
    leaves, start = [], 0
    while start < len(data):
        stop, stretch = start, bytes_a_leaf
        while stop == start:  # a unit longer than the stretch takes a longer one
            ends = unit_ends(data[start : start + stretch])
            if start + stretch >= len(data):
                stop, count = len(data), len(ends)
            elif len(ends) > 1:  # the last end is where the stretch ends, not where a unit does
                stop, count = start + int(ends[-2]), len(ends) - 1
            stretch *= 2
        leaves.append(leaf(data[start:stop], count))
        start = stop
    while len(leaves) > 1:
        leaves = [concat(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or bytes, by="size") and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if rope.data is not None:
        cut = int(unit_ends(rope.data)[rank - 1]) if by == "units" else rank
        counts = (rank, rope.units - rank) if by == "units" else (None, None)
        return leaf(rope.data[:cut], counts[0]), leaf(rope.data[cut:], counts[1])
    before = getattr(rope.left, by)
    if rank < before:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - before, by)
    return concat(rope.left, a), b


def bytes_of(rope: Rope) -> bytes:
    out, todo = [], [rope]
    while todo:
        node = todo.pop()
        if node.data is not None:
            out.append(node.data.tobytes())
        else:
            todo += [node.right, node.left]
    return b"".join(out)


def rearranged(text: Rope, first: int, second: int, form: str, sentinels: list[str]) -> tuple[Rope, int, int]:
    """The output's rope, and the code points of prefix and middle."""
    head, suffix = split(text, second)
    prefix, middle = split(head, first)
    parts = {k: concat(leaf(np.frombuffer(s.encode(), np.uint8), 0), part) for k, s, part in zip("PSM", sentinels, (prefix, suffix, middle), strict=True)}
    return reduce(concat, [parts[k] for k in ORDERS[form]]), prefix.points, middle.points


def restored(output: Rope, raw: bytes, form: str, sentinels: list[str]) -> Rope:
    """The text's rope, from the output's. raw: the output's bytes, in which each sentinel stands once."""
    rest, parts = output, {}
    marks = dict(zip("PSM", (s.encode() for s in sentinels), strict=True))
    for k in reversed(ORDERS[form]):  # from the end, so that places stay what they are
        at = raw.rindex(marks[k], 0, rest.size)
        rest, behind = split(rest, at, "size")
        _, parts[k] = split(behind, len(marks[k]), "size")
    if rest.size:
        raise ValueError("an output must begin with a sentinel")
    return concat(concat(parts["P"], parts["M"]), parts["S"])


def choices(id_col: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of sha256(seed:id), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(4)]


def _with_texts(rows: DataFrame, added: T.StructType, drop: list[str], work) -> DataFrame:
    """rows without `drop`, and `added`, which `work` computes from a batch, in runs of rows of a few MB."""
    keep = [f for f in rows.schema.fields if f.name not in drop]
    schema = T.StructType([*keep, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.schema.get_field_index("__t"))
            for i, j in runs_of_rows(text_buffers(size)[1], 4 << 20):
                part = batch.slice(i, j - i)
                made = work(part)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays([*columns, *made], [f.name for f in schema.fields])

    small_batches(rows.sparkSession, 500)
    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: list[str] | None = None, leaf_bytes: int = LEAF, keep_text: bool = True) -> DataFrame:
    """docs with n, form, output, prefix_chars and middle_chars. rate: per cent of the texts that are transformed; spm: per cent of these that take that form. keep_text=False leaves the text out."""
    marks = list(sentinels or SENTINELS)
    rows = without(docs, *OWN, *[f"__h{k}" for k in range(1, 5)], "__t").select("*", *choices(F.col(id_col), seed), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    rows = rows if keep_text else rows.drop(text_col)
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())])

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        data, at = text_buffers(part.column(part.schema.get_field_index("__t")))
        h = [part.column(part.schema.get_field_index(f"__h{k}")).to_pylist() for k in range(1, 5)]
        out = []
        for r in range(len(part)):
            own = data[at[r] : at[r + 1]]
            text, raw = rope_of(own, leaf_bytes), own.tobytes()
            n = text.units
            if not raw or h[2][r] % 100 >= rate or any(s.encode() in raw for s in marks):
                out.append((n, "plain", raw, None, None))
                continue
            form = "spm" if h[3][r] % 100 < spm else "psm"
            made, prefix, middle = rearranged(text, *sorted((h[0][r] % (n + 1), h[1][r] % (n + 1))), form, marks)
            out.append((n, form, bytes_of(made), prefix, middle))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        made = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return [*made[:2], made[2].cast(pa.string()), *made[3:]]

    return _with_texts(rows, added, ["__h1", "__h2", "__h3", "__h4", "__t"], work)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: list[str] | None = None, leaf_bytes: int = LEAF) -> DataFrame:
    """rows with `restored`, the text that an output was made of; null for a null output."""
    marks = list(sentinels or SENTINELS)
    rows = without(rows, "restored", "__t", "__f").select("*", F.col(output_col).alias("__t"), F.col(form_col).alias("__f"))

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        column, forms = part.column(part.schema.get_field_index("__t")), part.column(part.schema.get_field_index("__f")).to_pylist()
        (data, at), there, out = text_buffers(column), column.is_valid().to_pylist(), []
        for r, form in enumerate(forms):
            own = data[at[r] : at[r + 1]]
            raw = own.tobytes()
            text = raw if form not in ORDERS else bytes_of(restored(rope_of(own, leaf_bytes), raw, form, marks))
            out.append(text if there[r] else None)
        return [pa.array(out, pa.binary()).cast(pa.string())]

    return _with_texts(rows, T.StructType([T.StructField("restored", T.StringType())]), ["__t", "__f"], work)
