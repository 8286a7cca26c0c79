import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import fill_middle as M

from .fixtures import documents, empty

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """The contract's row, by plain slices: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def awkward(n=300, seed=4):
    rng = random.Random(seed)
    letters = ["a", "é", "\U0001f600", " ", " ", "\n", "\t", "\x0b", "\x0c", "\r", " ", "\x1c", "\x00", "<", "P", "S>", "M"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "has <M> inside", " ", "x" * 30_000, " " * 9000 + "y " * 9000, ("word " * 3000).strip() + "\n\n", "é" * 5000 + " z"]


def test_units_splits_and_order_equal_slices():
    rng = random.Random(1)
    for text in awkward():
        raw = text.encode()
        for leaf in (8, 64, 4096):
            rope = M.rope_of(np.frombuffer(raw, np.uint8), leaf)
            units = UNIT.findall(text)
            assert (rope.units, rope.points, rope.size) == (len(units), len(text), len(raw)) and M.bytes_of(rope) == raw
            k = rng.randint(0, len(units))
            a, b = M.split(rope, k)
            assert M.bytes_of(a) == "".join(units[:k]).encode() and a.units == k and b.units == len(units) - k and a.points + b.points == len(text)
            assert rope.depth <= 2 + np.log2(1 + len(raw) / min(leaf, 8))
    data = np.frombuffer(("ab " * 100_000).encode(), np.uint8)
    assert M.rope_of(data).depth <= 8


@pytest.mark.parametrize("leaf", [16, 4096])
def test_rows_equal_brute_force_and_outputs_invert(spark, leaf):
    rows = [(i, t) for i, t in enumerate(awkward())] + [(None, "a text without id"), (7, None), (8, ""), (9, "same text again"), (9, "same text again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).repartition(3)
    got = M.restore(M.fill_in_middle(docs, leaf_bytes=leaf), leaf_bytes=leaf).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == sorted(((i, t, *brute(i, t)) for i, t in rows), key=key)
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_other_sentinels_and_extra_columns(spark):
    docs = documents(spark).withColumn("tag", F.col("doc_id") * 2)
    made = M.fill_in_middle(docs, rate=100, spm=0, sentinels=["[pre]", "[suf]", "[mid]"])
    got = M.restore(made, sentinels=["[pre]", "[suf]", "[mid]"]).collect()
    assert {r["form"] for r in got if r["text"]} == {"psm"} and all(r["restored"] == (r["text"] or "") for r in got)
    assert all(r["tag"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in got)
    assert M.fill_in_middle(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        M.restored(M.rope_of(np.frombuffer(b"x<S>a<P>b<M>c", np.uint8)), b"x<S>a<P>b<M>c", "spm", M.SENTINELS)
