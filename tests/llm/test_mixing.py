import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sieveworks.llm import mixing as M

from .fixtures import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by the rule: share what is left by weight, stop those above their limit, again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in done]
        units = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / units for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return done | share
        for s in over:
            done[s] = float(most * sizes[s])
            left -= most * sizes[s]


def test_permutations(spark):
    for n in (1, 2, 3, 7, 64, 129, 1000):
        got = [r[0] for r in spark.range(n).select(F.expr(M.permuted("id", f"{n}L", "42, 'x'"))).collect()]
        assert sorted(got) == list(range(n))
    near = sum(abs(a - b) < 10 for a, b in zip(got, got[1:]))
    assert near < 50 and sum(i == g for i, g in enumerate(got)) < 10


def test_targets_equal_the_rule(spark):
    for sizes in ({"a": 5, "b": 1000, "c": 1, None: 400, "é": 0, "Z": 77}, {"a": 0, None: 0}, {None: 3}, {f"s{i:02d}": 2**i for i in range(18)}):
        rows = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert {r["source"] for r in rows} == set(want)
        assert all(abs(r["target"] - want[r["source"]]) <= 1e-9 * (1 + want[r["source"]]) for r in rows)


def test_pieces_are_the_drawn_blocks_of_the_sources(spark):
    docs = documents(spark)
    how = {"block": 16, "shard": 32}
    pieces, rows, sources = M.mix(docs, **how)
    pieces, rows = pieces.collect(), {r["row"]: r for r in rows.collect()}
    at = {r["place"]: r for r in sources.collect()}
    draws, words, uses = defaultdict(list), Counter(), Counter()
    for p in pieces:
        draws[p["shard"] * 32 + p["slot"], p["source_place"], p["pass"], p["block"]].append((p["start_in_block"], p["length"]))
        assert 0 <= p["start"] and p["start"] + p["length"] <= rows[p["row"]]["size"] and rows[p["row"]]["source"] == at[p["source_place"]]["source"]
        for k in range(p["start"], p["start"] + p["length"]):
            uses[p["row"], k] += 1
    assert sorted(k[0] for k in draws) == list(range(sum(s["draws"] for s in at.values())))  # each slot once
    for (_, place, _, block), parts in draws.items():
        start = 0
        for s, n in sorted(parts):
            assert s == start
            start += n
        assert start == min(16, at[place]["source_size"] - 16 * block)
        words[place] += start
    assert len({k[1:] for k in draws}) == len(draws)  # no block twice a pass
    assert max(uses.values()) <= 3
    for place, s in at.items():
        assert abs(words[place] - s["target"]) <= 24  # half a block, and the short last one


def test_shards_hold_sources_by_chance_in_their_shares(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 160)).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    pieces, _, sources = M.mix(docs, block=16, shard=100)
    share = {s["place"]: s["draws"] for s in sources.collect()}
    counts = Counter((r["shard"], r["source_place"]) for r in pieces.select("shard", "slot", "source_place").distinct().collect())
    total = sum(share.values())
    a = [counts[k, 0] for k in range(total // 100)]
    mean = 100 * share[0] / total
    assert len(set(a)) > 5 and abs(sum(a) / len(a) - mean) < 2
    spread = sum((x - mean) ** 2 for x in a) / len(a) / (mean * (1 - share[0] / total))
    assert 0.4 < spread < 2.2


def test_reruns_agree_whatever_the_partitions(spark):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    one = Counter(map(tuple, M.taken(documents(spark, parts=3)).select(columns).collect()))
    other = Counter(map(tuple, M.taken(documents(spark, parts=7).orderBy(F.desc("doc_id"))).select(columns).collect()))
    assert one == other and sum(one.values()) == documents(spark).count()
    assert Counter((i, s) for i, s, *_ in one.elements()) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in documents(spark).collect())


def test_texts_of_the_mix_are_the_words_of_its_pieces(spark):
    docs = documents(spark).withColumn("words", F.lit(1)).withColumn("row", F.lit(2))
    got = {(r["shard"], r["slot"]): r["words"] for r in M.mixed_texts(docs, block=32).collect()}
    texts = {}
    pieces, rows, _ = M.mix(docs, block=32)
    marks = {r["mark"]: WORD.findall(r["text"] or "") for r in docs.select(F.xxhash64("text").alias("mark"), "text").collect()}
    row = {r["row"]: r["mark"] for r in rows.collect()}
    for p in pieces.collect():
        texts.setdefault((p["shard"], p["slot"]), []).append((p["start_in_block"], marks[row[p["row"]]][p["start"] : p["start"] + p["length"]]))
    assert got == {k: [w for _, ws in sorted(v) for w in ws] for k, v in texts.items()}


def test_nothing_to_mix(spark):
    assert M.taken(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " \n", "a")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in M.taken(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert M.mixed_texts(blank).collect() == []
