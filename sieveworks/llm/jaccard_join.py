"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents with equal sets form a class; classes
are what is compared. Two classes can only reach the threshold if their prefixes meet: the `n - ceil(t n) + 1` first shingles in
one global order, rarest first (frequent shingles are known from a summary of all partitions; the order affects
work, never results).

1. Partition: where the prefixes of several classes share a shingle, each class asks the two that come before it by size, and
   the two hubs of the list, those in whose order the shingle comes first (they have the fewest shingles of their own, as the origin of
   copies has). Of the four that a class asks most, the two likeliest are verified, and verified links make the groups of similar
   documents (connected components, so links inside a group need no more work).
2. Matrix: (shingle, group) rows over the shared prefixes name the groups that a class of another group may have a link with:
   sizes must fit, and what follows the shared shingle must be long enough. Parity bitmaps, which bound an overlap from above, thin out
   the questions to small groups.
3. Open: a group's members are dealt into blocks of bounded size, each with the union of its members' shingles. A query
   whose overlap with the union is below t times its size skips the block; the others open it and compare members one
   by one, up to the first link, as the group is connected already.

Steps 2 and 3 see every pair that could qualify outside of the groups, so the components are exact, up to collisions
of 64-bit hashes. Nothing emits all pairs of a group: step 1 is linear in the postings, and step 2 pairs classes with groups.

Skew: copies collapse within each task before the shuffle; frequent shingles leave the prefixes; hot leaders are salted by their queries and
large groups by their members' sizes. Texts, not hashes, travel to the verification (they compress better), keyed
by block. Intermediate tables lie in the shared folder, so lost executors cost only their tasks.

Defined results: null, empty or blank text: no shingles, component is the document's own id. Fewer words than a shingle: the whole
sequence is one. Repeated rows give one result each, the same. A text whose every row lacks an id is linked with nothing (no text can be fetched
without an id); its component is null. Rows of one id with unlike texts each have the component of their text. Ids may be of any type that has an order. An empty
table gives an empty result; very long texts are sets like all others; ties do no harm, as the least id names a component. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER_TABLE, runs_of_rows, saved, small_batches, text_buffers

_rng = np.random.default_rng(20250101)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
#: Heavy-shingle summary: at most so many rows from a flush of a task, and in all.
HEAVY_PER_FLUSH, HEAVY_ALL, FLUSH = 4096, 1 << 18, 2_000_000
#: Rows (six numbers each) of texts to fetch that may be broadcast, after they were counted.
BROADCAST_NEEDS = 200_000
#: Longest parity bitmap of a class; groups of more members than SMALL_GROUP are opened by their blocks, without bitmaps.
MOST_BITS, SMALL_GROUP = 1 << 16, 64
#: A block's shingles and members, and queries to a copy of a block, in expectation.
BLOCK_SHINGLES, BLOCK_MEMBERS, BLOCK_QUERIES = 200_000, 250, 250


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 19)
            a, b = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            a[0] = b[0] = 1
            cls.up, cls.down = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts between the offsets, A-Z lower-cased."""
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw, rel = data[first : first + size], offsets - first
    inside = ~IS_SPACE[raw]
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[rel[:-1][rel[:-1] < size]] = False
    after[rel[1:][rel[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = Powers.to(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE[LOWER_TABLE[raw]] * up[:size], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(rel, starts, side="right") - 1


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column."""
    data, offsets = text_buffers(column)
    for i, j in runs_of_rows(offsets):
        words, row = word_hashes(data, offsets[i : j + 1])
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        full = max(0, len(words) - k + 1)
        rolled = np.zeros(full, np.uint64)
        for t in range(k):
            rolled += words[t : t + full] * PLACE[t]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + PLACE[8 + b - a])
            else:
                yield words[:0]


def digest(shingles: np.ndarray) -> int:
    """64 bits of a set, as a signed integer."""
    total = mix(shingles ^ np.uint64(BASE)).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * PLACE[15:]
    return int(mix(total).view(np.int64)[0])


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them has it. As many bits as a power of two at the set's size."""
    size = min(MOST_BITS, max(64, 1 << (len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """The overlap is this at most: each bit that differs needs a shingle that only one set has. The longer bits fold onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def profile(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows of documents (doc_id, h of the text, n, digest, bits) and, with null n, of frequent shingles (token, weight)."""
    input_rows = docs.select(F.col(id_col).alias("doc_id"), text_col, F.xxhash64(text_col).alias("h"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "digest", "bits", "token", "weight"]
        seen, held, size, kind = set(), [], 0, None

        def heavy() -> pa.RecordBatch:
            token, weight = np.unique(np.concatenate(held), return_counts=True)
            token, weight = token[weight > 2], weight[weight > 2]
            top = np.argsort(-weight, kind="stable")[:HEAVY_PER_FLUSH]
            none = pa.nulls(len(top), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(top), kind), none, none, none, pa.nulls(len(top), pa.binary()), pa.array(token[top].view(np.int64)), pa.array(weight[top].astype(np.int64))], names)

        for batch in batches:
            n, of, bits, kind = [], [], [], batch.column(0).type
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                of.append(digest(s))
                bits.append(parity_bits(s) if len(s) else None)
                if len(s) and of[-1] not in seen:
                    seen.add(of[-1])
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield heavy()
                    held, size = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(bits, pa.binary()), none, none], names)
        if held:
            yield heavy()

    return input_rows.mapInArrow(run, f"doc_id {id_type}, h long, n long, digest long, bits binary, token long, weight long")


def postings(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, heavy: list[tuple[int, int]]) -> DataFrame:
    """(token, digest, n, rest) of each class's prefix; a class once for each task. rest: shingles from this one on, in the global order."""
    token = np.array([t for t, _ in heavy], np.int64).view(np.uint64)
    weight = np.array([w for _, w in heavy], np.int64)
    by_token = np.argsort(token)
    shared = docs.sparkSession.sparkContext.broadcast((token[by_token], weight[by_token]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, weights = shared.value
        seen: set[int] = set()
        for batch in batches:
            out, of, sizes, rests = [], [], [], []
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, weights[at], 0)
                    if rank.any():
                        s = s[np.argsort(rank, kind="stable")]
                p = s[: len(s) - least_overlap(len(s), percent) + 1]
                out.append(p)
                of.append(d)
                sizes.append(len(s))
                rests.append(np.arange(len(s), len(s) - len(p), -1, dtype=np.int32))
            if out:
                many = [len(p) for p in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(of, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate(rests))], ["token", "digest", "n", "rest"])

    return docs.select(text_col).mapInArrow(run, "token long, digest long, n int, rest int")


def within_bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (digest, n, od, on, ...) that their bitmaps do not rule out, with the bound on their overlap."""
    of = lambda d, n, name: bits.select(F.col("digest").alias(d), F.col("n").alias(n), F.col("bits").alias(name))
    rest = pairs.columns
    joined = pairs.join(of("digest", "n", "__a"), ["digest", "n"]).join(of("od", "on", "__b"), ["od", "on"]).select(*rest, "__a", "__b")
    i, j = rest.index("n"), rest.index("on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (i, j, len(rest), len(rest) + 1)]
            bound = np.array([overlap_bound(a, n, b, m) for n, m, a, b in zip(*columns, strict=True)], np.int64)
            n = np.array(columns[0], np.int64) + np.array(columns[1], np.int64)
            keep = pa.array((100 + percent) * bound >= percent * n)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(bound)], [*rest, "bound"])
            yield out.filter(keep)

    schema = joined.select(*rest, F.lit(0).cast("long").alias("bound")).schema
    return joined.mapInArrow(run, schema)


def open_groups(docs: DataFrame, queries: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between query and member classes.

    queries, members: (g, digest, n, doc); members of groups that no query asks are left out. The first link of a query in each block of a group is enough.
    """
    sizes = members.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    asked = queries.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("salts"))
    plan = saved(asked.join(sizes, "g"), "plan")  # a join of two tables by the group alone, so that Spark can split a large group
    hashed = F.xxhash64("digest")
    m = members.join(plan, "g").select("g", "doc", F.pmod(hashed, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "digest")
    q = queries.join(plan, "g").select("g", "doc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(hashed, "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "digest")
    needs = m.unionByName(q).withColumn("key", F.xxhash64("g", "block", "salt"))
    needs = saved(needs, "needs")
    few = needs.count() <= BROADCAST_NEEDS  # else both sides are shuffled
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(needs) if few else needs, "doc").select("key", "role", "digest", "text").repartition("key").sortWithinPartitions("key", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, union = None, {}, None
        for batch in batches:
            links = []
            for at, role, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3), k), strict=True):
                if at != key:
                    key, held, union = at, {}, None
                if digest(s) != d:  # another text under the same id
                    continue
                if role == 0:
                    held[d] = s
                    continue
                if not held:
                    continue
                if union is None:
                    union = np.unique(np.concatenate(list(held.values())))
                need = least_overlap(len(s), percent)
                place = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if int((union[place] == s).sum()) < need:
                    continue
                for other, o in held.items():
                    if other == d or len(o) < need or len(s) < least_overlap(len(o), percent):
                        continue
                    place = np.minimum(np.searchsorted(o, s), len(o) - 1)
                    both = int((o[place] == s).sum())
                    if 100 * both >= percent * (len(s) + len(o) - both):
                        links.append((d, other))
                        break
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp is the component's least node. Alternates large and small stars."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = saved(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def with_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, h, n, digest, comp, component_id), one row for each row of docs; comp is the least digest of the component, null without words. Its steps run at once, the result is lazy."""
    small_batches(docs.sparkSession)
    found = saved(profile(docs, id_col, text_col, k), "profile")
    rows = found.where("n IS NOT NULL")
    bits = saved(rows.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("doc"), F.max("bits").alias("bits")), "classes")
    classes = bits.drop("bits")
    heavy = [(r["token"], r["w"]) for r in found.where("token IS NOT NULL").groupBy("token").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "token").limit(HEAVY_ALL).collect()]

    near = Window.partitionBy("token").orderBy("n", "digest")
    other = lambda f: F.coalesce(f("digest").over(near) != F.col("digest"), F.lit(False))
    before = lambda k: F.lag(F.struct("digest", "n", "rest"), k).over(near)
    posted = postings(docs, id_col, text_col, k, percent, heavy).withColumns({"left": other(F.lag), "right": other(F.lead), "b1": before(1), "b2": before(2)})
    shared = saved(posted.where("left OR right").select("token", "digest", "n", "rest", F.array("b1", "b2").alias("before")), "shared")

    # the first shingle that two sets share bounds their overlap by what follows it in either set
    reach = lambda rest, n, other: (100 + percent) * rest >= percent * (n + other)

    # 1. leaders: neighbours by size, and hubs; no text under a null id can be fetched, so such a class stays out unless another row has it
    early = Window.partitionBy("token").orderBy(F.col("n") - F.col("rest"), "digest").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hubs = [F.nth_value(F.struct("digest", "n", "rest"), k).over(early) for k in (1, 2)]
    asks = F.concat(F.transform("before", lambda x: F.struct(x.alias("l"), F.lit(0).alias("hub"))), F.array(*[F.struct(h.alias("l"), F.lit(1).alias("hub")) for h in hubs]))
    posted = shared.select("digest", "n", "rest", asks.alias("asks")).select("digest", "n", "rest", F.explode("asks").alias("a")).select("digest", "n", "rest", "a.l", "a.hub")
    posted = posted.where((F.col("digest") != F.col("l.digest")) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")))
    posted = posted.where(reach(F.col("rest"), F.col("n"), F.col("l.n")) & reach(F.col("l.rest"), F.col("n"), F.col("l.n")))
    likely = posted.groupBy("digest", "n", F.col("l.digest").alias("od"), F.col("l.n").alias("on")).agg(F.count("*").alias("c"), F.max("hub").alias("hub"))
    likely = likely.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("hub"), F.desc("c"), "od"))).where("r <= 4").drop("c", "r", "hub")
    near = within_bound(likely, bits, percent).withColumnsRenamed({"od": "ld", "on": "ln"})
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("bound"), "ld"))).where("r <= 2")
    best = saved(best.join(classes, ["digest", "n"]).join(classes.select(F.col("digest").alias("ld"), F.col("n").alias("ln"), F.col("doc").alias("ldoc")), ["ld", "ln"]), "likely")
    queries = best.select(F.col("ld").alias("g"), "digest", "n", "doc")
    members = best.select(F.col("ld").alias("g"), F.col("ld").alias("digest"), F.col("ln").alias("n"), F.col("ldoc").alias("doc")).distinct()
    links = saved(open_groups(docs, queries, members, id_col, text_col, k, percent), "links")
    comps = saved(components(links), "groups")

    # 2. the matrix over shared prefixes, and what each class has to ask; the smaller group asks the larger
    named = comps.select(F.col("node").alias("digest"), "comp").join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp")
    at = saved(shared.select("token", "digest", "n", "rest").join(named, "digest", "left").withColumns({"comp": F.coalesce("comp", "digest"), "size": F.coalesce("size", F.lit(1))}), "placed")
    matrix = at.groupBy("token", F.col("comp").alias("g"), F.col("size").alias("g_size")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("g_rest"))
    matrix = matrix.withColumn("groups", F.count("*").over(Window.partitionBy("token"))).where("groups > 1").drop("groups")
    fits = (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n")) & reach(F.col("rest"), F.col("n"), F.col("low")) & reach(F.col("g_rest"), F.col("n"), F.col("low"))
    ask = at.join(matrix, "token").where((F.struct("size", "comp") < F.struct("g_size", "g")) & fits).select("g", "g_size", "digest", "n").distinct()
    ask = saved(ask.join(classes, ["digest", "n"]), "asked")
    everyone = saved(classes.join(comps.select(F.col("node").alias("digest"), "comp"), "digest", "left").select(F.coalesce("comp", "digest").alias("g"), "digest", "n", "doc"), "members")
    pairs = ask.where(F.col("g_size") <= SMALL_GROUP).join(everyone.select("g", F.col("digest").alias("od"), F.col("n").alias("on")), "g").where((100 * F.col("on") >= percent * F.col("n")) & (percent * F.col("on") <= 100 * F.col("n")))
    small = within_bound(pairs.select("g", "digest", "n", "doc", "od", "on"), bits, percent)
    ask = saved(small.select("g", "digest", "n", "doc").distinct().unionByName(ask.where(F.col("g_size") > SMALL_GROUP).select("g", "digest", "n", "doc")), "asked")

    # 3. open
    more = saved(open_groups(docs, ask, everyone, id_col, text_col, k, percent), "links")
    final = components(links.unionByName(more))
    named = classes.join(final.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "n", "doc", F.coalesce("comp", "digest").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    of_class = named.join(ids, "comp").select("digest", "n", "comp", "component_id")
    out = rows.select("doc_id", "h", "n", "digest").join(of_class, ["digest", "n"], "left")
    return out.select("doc_id", "h", "n", "digest", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of docs."""
    found = with_components(docs, id_col, text_col, k, percent)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: the one with the least id.

    Rows are told apart by id and text, so rows of one id with unlike texts stay both; a row goes only if its text is that of the row that
    stays, or linked with it. Texts without words are linked with nothing, so of them only rows equal in id and text fall together, as
    all such rows do (which one stays is not defined, as they differ in other columns at most). Rows without an id stay.
    """
    found = with_components(docs.where(F.col(id_col).isNotNull()), id_col, text_col, k, percent)
    least = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "h")).alias("s")).select("s.*")
    least = least.unionByName(found.where("comp IS NULL").select("doc_id", "h")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    marked = docs.where(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col), "__h": F.xxhash64(text_col)})
    kept = marked.join(least, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
