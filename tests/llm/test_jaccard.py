import re
from itertools import combinations

import pytest

from sieveworks.llm import jaccard_join as J

from .fixtures import documents, empty


def sets(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    by = {i: sets(t) for i, t in rows}
    parent = {i: i for i in by}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(by), 2):
        if by[a] and by[b] and 100 * len(by[a] & by[b]) >= 80 * len(by[a] | by[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(by[i]), root(i)) for i in by}


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_brute_force(spark, seed):
    docs = documents(spark, seed)
    rows = docs.select("doc_id", "text").collect()
    want = brute({(r[0], r[1]) for r in rows if r[0] is not None})
    got = J.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert len({c for _, c in want.values()}) < len(want) - 25


def test_small_blocks_and_salts_change_nothing(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(map(str, J.jaccard_components(docs).collect()))
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(J, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(J, "BLOCK_MEMBERS", 2)
    assert sorted(map(str, J.jaccard_components(docs).collect())) == want


def test_keep_one(spark):
    docs = documents(spark)
    want = {c for _, c in brute({(r[0], r[1]) for r in docs.select("doc_id", "text").collect() if r[0] is not None}).values()}
    kept = J.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_keep_one_tells_rows_of_one_id_apart_by_their_texts(spark):
    """A row goes only if its text equals, or is linked with, that of a row that stays."""
    a, b = "a b c d e f g", "unlike words of another kind here"
    rows = [(1, a, 1), (1, b, 2), (1, a, 3), (2, a.upper(), 4), (3, b + "", 5), (4, "", 6), (4, "", 7), (5, None, 8), (6, "", 9), (None, a, 10)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, H int")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("1", a), ("1", b), ("None", a)]
    assert sorted(r["doc_id"] for r in kept if not r["text"]) == [4, 5, 6]


def test_ids_of_any_type(spark):
    rows = [("x", "a b c d e f"), ("w", "A b c d e f"), ("y", None)]
    got = {r["name"]: r["component_id"] for r in J.jaccard_components(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect()}
    assert got == {"x": "w", "w": "w", "y": "y"}


def test_a_text_of_many_words(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (149_997, 1), 3: (got[3][0], 3)}


def test_empty_table(spark):
    assert J.jaccard_components(empty(spark)).collect() == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 9, 9, "x"), (2, "a b c d e f", 9, 9, "x")], "doc_id long, text string, n long, digest long, token string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
