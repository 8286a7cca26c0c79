import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import segment as G
from sieveworks.functions.lexical import Lexicon

COUNTS = {"中国": 40, "中国人": 9, "国人": 3, "人民": 30, "民": 5, "大学": 20, "大学生": 8, "生活": 12, "学生": 11, "的": 90, "天": 4, "a": 2}


@pytest.fixture(scope="module")
def segmenter(spark):
    return G.learn(spark.createDataFrame(list(COUNTS.items()), "word string, n long"), least=2)


def exhaustive(s, run):
    """The best of all paths, by trying each."""
    best = None
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        pieces = [run[a:b] for a, b in zip([0, *ends], ends)]
        score = 0
        for p in pieces:
            known = dict((k, v) for k, v in s.words.found(p, 0)).get(len(p))
            ways = [known] if known is not None else []
            if len(p) <= s.longest:
                ways.append(s.unseen + sum(s.chars.get(c, s.rare) for c in p))
            if not ways:
                break
            score += max(ways)
        else:
            key = (score, [len(p) for p in pieces])
            if best is None or key > best[0]:
                best = (key, pieces)
    return best[0][0], best[1]


def test_paths_equal_an_exhaustive_search(segmenter):
    rng = random.Random(3)
    letters = "中国人民大学生活的天x"
    for _ in range(150):
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        score, pieces = segmenter.best(run)
        assert (score, list(pieces)) == exhaustive(segmenter, run), run
    assert segmenter.best("中国人民的大学生活")[1] == ("中国", "人民", "的", "大学", "生活")
    assert segmenter.best("中国人民的大学生活的")[0] == segmenter.best("中国人民的大学生活")[0] + segmenter.best("的")[0]


def test_scores_are_shares_in_micro_nats(segmenter):
    total = sum(COUNTS.values()) + 1
    assert dict(segmenter.words.found("中国人", 0)) == {2: round(np.log(40 / total) * 1e6), 3: round(np.log(9 / total) * 1e6)}
    assert abs(segmenter.best("的")[0] - np.log(90 / total) * 1e6) <= 1


def test_trie_holds_its_words_and_no_others():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdé字") for _ in range(rng.randint(1, 7))): -rng.randint(0, 99) for _ in range(3000)}
    trie = G.DoubleArray.of(words)
    for _ in range(500):
        text = "".join(rng.choice("abcdé字z") for _ in range(12))
        assert trie.found(text, 2) == [(n, words[text[2 : 2 + n]]) for n in range(1, 11) if text[2 : 2 + n] in words]
    assert G.DoubleArray.of({}).found("abc", 0) == []


def test_whole_texts_are_their_pieces(spark, segmenter):
    texts = ["中国人民\n的 大学生活, ok 12", "", None, "x" * 9000, "中国人民的" * 3000, "天" * 500, "é😀中国"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", G.lattice_segments(spark, F.col("t"), segmenter).alias("p")).collect()
    assert all("".join(r["p"]) == (texts[r["i"]] or "") for r in rows)
    assert next(r["p"] for r in rows if r["i"] == 0) == ["中国", "人民", "\n", "的", " ", "大学", "生活", ",", " ", "ok", " ", "12"]
    nothing = G.learn(df.select(F.col("t").alias("word"), F.lit(1).cast("long").alias("n")).where("false"))
    assert nothing.best("中国人民大")[1] == ("中国人民", "大")


def test_lexicons_cut_on_lattice_borders(segmenter):
    plain, lattice = Lexicon(frozenset("中国人民大学的生活")), Lexicon(frozenset("中国人民大学的生活"), base=segmenter)
    text = "中国人民的大学生活"
    assert [t for t, *_ in plain.segment(text)] == ["中国人民", "的大学生", "活"]
    assert [t for t, *_ in lattice.segment(text)] == ["中国", "人民", "的", "大学", "生活"]
    assert [t for t, *_ in Lexicon(frozenset(), terms=frozenset(["民的"]), base=segmenter).segment(text)] == ["中国", "人", "民的", "大学", "生活"]


def test_workers_hold_twelve_bytes_a_state_and_few_runs():
    trie = G.DoubleArray.of({f"w{i:04d}x": -i for i in range(3000)})
    assert sum(v.nbytes for v in trie._views) <= 12 * len(trie.base) and trie.found("w0007x", 0) == [(6, -7)]
    s = G.Segmenter(trie, {}, -10, -20, run="[a-z0-9]+")
    for i in range(25_000):
        s.pieces(f"r{i}")
    assert len(s.known_runs) <= 20_001


def test_batches_of_pieces_are_bounded(spark):
    from pyspark.sql import functions as F

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    G.lattice_segments(spark, F.lit("a"), G.Segmenter(G.DoubleArray.of({}), {}, -10, -20))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 2 << 20
