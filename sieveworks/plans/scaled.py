"""Queries of the operators that replace one task or one file: segmenter, seeded samples, ranges, budgets by event time, keyed tables, trees of hashes, marked files; and of readers and checks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as Lx
from ..functions import segment as Sg
from ..functions import text as X
from ..operators import merkle as Mk
from ..operators import probes as Pr
from ..operators import sampling as Sm
from ..operators import selection as Sl
from ..operators import sets as Se
from ..operators import synth as Sy
from ..sources import kpi_file as Kf
from ..sources import readers as Rd
from ..sources import sinks as Si
from ..sources import upsert as Up
from ..sources.tables import saved, spread
from .catalogue import LEXICON, query, r9
from .extended import SCORE_SQL, scratch

# --- base segmenter ---

#: Known words occur this often; a piece of other characters has this many at most.
LEAST, LONGEST = 3, 4
RUN = "[a-z]+"


def paths_sql(runs: str, last: str) -> str:
    """Best paths of runs of a-z, by word counts of the documents: scores of all pieces first, then the best rest from the end of each run to its start."""
    return f"""
WITH RECURSIVE
words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word),
total AS (SELECT sum(n) + 1 AS all_words, sum(n * length(word)) + 1 AS all_chars FROM words),
known AS (SELECT word, round(ln(n / all_words) * 1000000)::BIGINT AS score FROM words, total WHERE n >= {LEAST}),
letters AS (SELECT c, round(ln(sum(n) / any_value(all_chars)) * 1000000)::BIGINT AS score
            FROM (SELECT unnest(string_split(word, '')) AS c, n FROM words), total GROUP BY c),
unseen AS (SELECT round(ln(1 / all_words) * 1000000)::BIGINT AS score FROM total),
runs AS ({runs}),
places AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
own AS (SELECT run, i, letters.score FROM places JOIN letters ON letters.c = substr(run, i, 1)),
sums AS (SELECT run, i, sum(score) OVER (PARTITION BY run ORDER BY i) AS upto FROM own),
pieces AS (SELECT run, i, unnest(range(1, length(run) - i + 2)) AS k FROM places),
scored AS (SELECT p.run, p.i, p.k, CASE WHEN p.k <= {LONGEST} THEN unseen.score + b.upto - coalesce(a.upto, 0) END AS unknown, known.score AS score
           FROM pieces p CROSS JOIN unseen JOIN sums b ON b.run = p.run AND b.i = p.i + p.k - 1 LEFT JOIN sums a ON a.run = p.run AND a.i = p.i - 1
           LEFT JOIN known ON known.word = substr(p.run, p.i, p.k)),
ways AS (SELECT run, i, list({{'k': k, 's': greatest(coalesce(score, unknown), coalesce(unknown, score))}} ORDER BY k) AS w
         FROM scored WHERE score IS NOT NULL OR unknown IS NOT NULL GROUP BY run, i),
best AS (
    SELECT run, length(run) + 1 AS i, [0::BIGINT] AS rest, [''] AS paths FROM runs
    UNION ALL
    SELECT run, i, list_prepend(top.s, rest), list_prepend(substr(run, i, top.k) || '|' || paths[top.k], paths)
    FROM (SELECT b.run, w.i, b.rest, b.paths, list_max(list_transform(w.w, lambda x: {{'s': x.s + b.rest[x.k], 'k': x.k}})) AS top
          FROM best b JOIN ways w ON w.run = b.run AND w.i = b.i - 1)),
done AS (SELECT run, rest[1]::BIGINT AS score, rtrim(paths[1], '|') AS pieces FROM best WHERE i = 1)
{last}"""


def run_segmenter(read) -> tuple[DataFrame, Sg.Segmenter]:
    """(run, n) of the documents, and the segmenter of their words."""
    docs = spread(read("documents")).select(F.lower("text").alias("t"))
    counts = saved(Sg.word_counts(docs, F.col("t"), RUN), "word-counts")
    return counts.withColumnRenamed("word", "run"), Sg.learn(counts, LEAST, 10_000_000, LONGEST, RUN)


@query("segmented_words", paths_sql("SELECT word AS run FROM words", "SELECT run, n::BIGINT AS n, pieces, score FROM done JOIN words ON words.word = done.run"))
def segmented_words(read):
    """Every word of the documents cut along its likeliest path; rare ones fall into known words and characters."""
    runs, segmenter = run_segmenter(read)
    return runs.withColumn("p", Sg.best_paths(runs.sparkSession, F.col("run"), segmenter)).select("run", "n", F.array_join("p.pieces", "|").alias("pieces"), "p.score")


@query("lattice_segments", paths_sql("SELECT word AS run FROM words", """,
parts AS (SELECT doc_id, lower(text) AS t FROM documents),
others AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z]+|[a-z0-9]+|\\s+|(?s:.)')) AS p FROM parts),
cut AS (SELECT doc_id, p AS run, count(*) AS times FROM others WHERE regexp_full_match(p, '[a-z]+') GROUP BY ALL),
inside AS (SELECT doc_id, sum(times * len(string_split(pieces, '|'))) AS n, max(list_max(list_transform(string_split(pieces, '|'), lambda p: length(p)))) AS longest
           FROM cut JOIN done USING (run) GROUP BY doc_id),
outside AS (SELECT doc_id, count(*) AS n, max(length(p)) AS longest FROM others WHERE NOT regexp_full_match(p, '[a-z]+') GROUP BY doc_id)
SELECT doc_id, (coalesce(inside.n, 0) + coalesce(outside.n, 0))::BIGINT AS n, length(t)::BIGINT AS chars, greatest(coalesce(inside.longest, 0), coalesce(outside.longest, 0))::BIGINT AS longest
FROM parts LEFT JOIN inside USING (doc_id) LEFT JOIN outside USING (doc_id)"""))
def lattice_segments(read):
    """Whole texts, their runs of letters cut by the segmenter; the pieces joined are the text."""
    _, segmenter = run_segmenter(read)
    docs = spread(read("documents")).select("doc_id", F.lower("text").alias("t"))
    p = docs.select("doc_id", Sg.lattice_segments(docs.sparkSession, F.col("t"), segmenter).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.length(F.array_join("p", "")).cast("long").alias("chars"), F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


# --- seeded sample ---

#: The Mersenne twister in SQL: seeding in three chains, one turn of the state in three blocks, tempering; then numbers below the count, each place once.
TWISTER_SQL = """
WITH RECURSIVE
base AS (SELECT 0 AS i, 19650218::UBIGINT AS s UNION ALL
         SELECT i + 1, ((1812433253::UBIGINT * xor(s, s >> 30)) % 4294967296::UBIGINT + i + 1) % 4294967296::UBIGINT FROM base WHERE i < 623),
one AS (SELECT 0 AS k, 0 AS i, s, s AS first FROM base WHERE i = 0 UNION ALL
        SELECT k + 1, b.i, (xor(b.s, (xor(o.s, o.s >> 30) * 1664525::UBIGINT) % 4294967296::UBIGINT) + {seed}::UBIGINT) % 4294967296::UBIGINT, first
        FROM one o JOIN base b ON b.i = o.k + 1 WHERE k < 623),
wrapped AS (SELECT (xor(f.s, (xor(l.s, l.s >> 30) * 1664525::UBIGINT) % 4294967296::UBIGINT) + {seed}::UBIGINT) % 4294967296::UBIGINT AS s
            FROM one l, one f WHERE l.k = 623 AND f.k = 1),
mixed AS (SELECT CASE WHEN k = 0 THEN 0 ELSE k END AS i, CASE WHEN k = 1 THEN (SELECT s FROM wrapped) ELSE s END AS s FROM one WHERE k >= 1),
two AS (SELECT 1 AS i, s FROM mixed WHERE i = 1 UNION ALL
        SELECT m.i, (xor(m.s, (xor(t.s, t.s >> 30) * 1566083941::UBIGINT) % 4294967296::UBIGINT) + 4294967296::UBIGINT - m.i::UBIGINT) % 4294967296::UBIGINT
        FROM two t JOIN mixed m ON m.i = t.i + 1),
again AS (SELECT (xor(f.s, (xor(l.s, l.s >> 30) * 1566083941::UBIGINT) % 4294967296::UBIGINT) + 4294967296::UBIGINT - 1::UBIGINT) % 4294967296::UBIGINT AS s
          FROM two l, two f WHERE l.i = 623 AND f.i = 1),
old AS (SELECT 0 AS i, 2147483648::UBIGINT AS s UNION ALL SELECT 1, s FROM again UNION ALL SELECT i, s FROM two WHERE i >= 2),
part1 AS (SELECT a.i, xor(xor(c.s, y >> 1), CASE WHEN y % 2 = 1 THEN 2567483615::UBIGINT ELSE 0::UBIGINT END) AS s
          FROM (SELECT a.i, (a.s & 2147483648::UBIGINT) | (b.s & 2147483647::UBIGINT) AS y FROM old a JOIN old b ON b.i = a.i + 1) a JOIN old c ON c.i = a.i + 397 WHERE a.i < 227),
part2 AS (SELECT a.i, xor(xor(c.s, y >> 1), CASE WHEN y % 2 = 1 THEN 2567483615::UBIGINT ELSE 0::UBIGINT END) AS s
          FROM (SELECT a.i, (a.s & 2147483648::UBIGINT) | (b.s & 2147483647::UBIGINT) AS y FROM old a JOIN old b ON b.i = a.i + 1) a JOIN part1 c ON c.i = a.i - 227 WHERE a.i < 454),
part3 AS (SELECT a.i, xor(xor(c.s, y >> 1), CASE WHEN y % 2 = 1 THEN 2567483615::UBIGINT ELSE 0::UBIGINT END) AS s
          FROM (SELECT a.i, (a.s & 2147483648::UBIGINT) | (b.s & 2147483647::UBIGINT) AS y
                FROM old a JOIN (SELECT i, s FROM old WHERE i > 0 UNION ALL SELECT 624, s FROM part1 WHERE i = 0) b ON b.i = a.i + 1) a JOIN part2 c ON c.i = a.i - 227),
state AS (SELECT * FROM part1 UNION ALL SELECT * FROM part2 UNION ALL SELECT * FROM part3),
t1 AS (SELECT i, xor(s, s >> 11) AS y FROM state),
t2 AS (SELECT i, xor(y, (y * 128) & 2636928640::UBIGINT) AS y FROM t1),
t3 AS (SELECT i, xor(y, (y * 32768) & 4022730752::UBIGINT) AS y FROM t2),
words AS (SELECT i, xor(y, y >> 18) AS y FROM t3),
rows AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS place, count(*) OVER () AS population FROM {table}),
size AS (SELECT any_value(population) AS population, length(bin(any_value(population))) AS bits FROM rows),
drawn AS (SELECT i, (y >> (32 - bits))::BIGINT AS place FROM words, size WHERE (y >> (32 - bits)) < population),
firsts AS (SELECT place, min(i) AS i FROM drawn GROUP BY place),
picked AS (SELECT place, row_number() OVER (ORDER BY i) - 1 AS draw FROM firsts QUALIFY row_number() OVER (ORDER BY i) <= {n})
SELECT {key}, draw FROM picked JOIN rows USING (place)"""


@query("seeded_sample", TWISTER_SQL.format(seed=2026, key="doc_id", table="documents", n=12))
def seeded_sample(read):
    """Twelve documents as a seeded sample of the sorted ids takes them."""
    return Sm.seeded_sample(read("documents").select("doc_id"), "doc_id", 12, 2026)


# --- CSV by ranges ---


@query("ranged_records", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, coalesce(source, '') AS source FROM documents")
def ranged_records(read):
    """Whole documents as CSV with quoted line ends, read by ranges of 16 KB that cut through quoted fields."""
    rows = read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    root = scratch(rows.sparkSession, "ranged")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(f"{root}/docs")
    fields = Rd.read_libraries(rows.sparkSession, root, range_bytes=16 << 10).select("fields")
    text = lambda c: F.coalesce(F.col("fields")[c], F.lit(""))
    return fields.select(text("doc_id").try_cast("long").alias("doc_id"), F.sha2(text("text").cast("binary"), 256).alias("digest"), text("source").alias("source"))


@query("loaded_table", """
SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS row_idx, p_name AS name FROM part WHERE p_partkey % 2 = 1""")
def loaded_table(read):
    """The rows behind a logical name; of two files of that name the first by path counts."""
    part = read("part")
    root = scratch(part.sparkSession, "loaded")
    for folder, odd in (("lib/a", 1), ("lib/b", 0)):
        part.where(F.col("p_partkey") % 2 == odd).orderBy("p_partkey").coalesce(1).select("p_name").write.option("header", True).csv(f"{root}/{folder}")
    raw = Rd.read_libraries(part.sparkSession, root, range_bytes=1000).withColumn("stem", F.lit("parts"))
    return Rd.load_table(raw, "lib", "parts", {}).select("row_idx", F.col("fields")["p_name"].alias("name"))


# --- streams, keyed tables, trees of hashes, marked files ---


@query("ordered_budgets", """
SELECT key, event, spent, spent <= 300 AS submitted
FROM (SELECT user_id::VARCHAR AS key, event_id::VARCHAR AS event,
             round(coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100, 2) AS spent
      FROM events)
WHERE spent <= 300""")
def ordered_budgets(read):
    """A stream's budget for each key, in the order of the events' times whatever order they come in, over three runs from one checkpoint. Cents are whole, so sums are exact."""
    from ..streaming.budgets import ordered_budget

    events = read("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("event"), F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).alias("cost"))
    spark = events.sparkSession
    root = scratch(spark, "ordered")
    span = events.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    if span["a"] is None:
        return spark.createDataFrame([], "key string, event string, spent double, submitted boolean")
    third = (span["b"] - span["a"]) / 3
    parts = [events.where((F.col("at") >= span["a"] + k * third) & (F.col("at") < span["a"] + (k + 1) * third if k < 2 else F.lit(True))) for k in range(3)]
    tick = spark.createDataFrame([(None, None, span["b"] + 40 * third, 0.0)], events.schema)
    for part in (parts[0], parts[1], parts[2].unionByName(tick.where("false")), tick):
        part.orderBy(F.xxhash64("event")).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema(events.schema).json(f"{root}/in")
        out = ordered_budget(stream, "key", "event", "at", F.col("cost"), 30_000.0, f"{int(third.total_seconds()) + 1} seconds")
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{root}/out").where("event IS NOT NULL AND submitted")
    return done.select("key", "event", F.round(F.col("spent") / 100, 2).alias("spent"), "submitted")


@query("bucketed_upsert", "SELECT user_id, arg_max(event_id, (event_id % 3) * 1000000000000 + event_id) AS event_id FROM events GROUP BY user_id")
def bucketed_upsert(read):
    """Three batches into a keyed table; of a key's rows the last batch's last one stays."""
    events = read("events").select("user_id", "event_id")
    root = scratch(events.sparkSession, "upsert")
    for k in range(3):
        Up.upsert(events.where(F.col("event_id") % 3 == k), root, ["user_id"], [F.col("event_id")], buckets=16)
    return Up.read_table(events.sparkSession, root).select("user_id", "event_id")


def node_sql(depth: int) -> str:
    """Levels of the tree from its leaves to the root."""
    out = ""
    for d in range(depth - 1, -1, -1):
        out += f"l{d} AS (SELECT substr(prefix, 1, {d}) AS prefix, sum(n) AS n, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM l{d + 1} GROUP BY 1),\n"
    return out.rstrip(",\n")


WORD_SUMS_SQL = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


def field_sql(f: str) -> str:
    return f"coalesce(length({f}::VARCHAR) || ':' || {f}::VARCHAR, '~')"


@query("merkle_root", f"""
WITH r AS (SELECT substr(sha256('k' || doc_id), 1, 2) AS prefix, sha256({field_sql('doc_id')} || ',' || {field_sql('lang')} || ',' || {field_sql('text')}) AS h FROM documents),
l2 AS (SELECT prefix, count(*) AS n, sha256(count(*) || ':' || {WORD_SUMS_SQL}) AS hash FROM r GROUP BY prefix),
{node_sql(2)}
SELECT hash AS content_hash, n::BIGINT AS n_rows FROM l0""")
def merkle_root(read):
    """One hash of all documents, whatever their order and partitions; no task holds more than a leaf's sums."""
    return Mk.root(Mk.tree(spread(read("documents")), "doc_id", ["doc_id", "lang", "text"], 2))


@query("merkle_changes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'changed' ELSE 'removed' END AS status FROM orders WHERE o_orderkey % 1000 IN (7, 8)
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 1000 = 9""")
def merkle_changes(read):
    """Planted changes, found by going down two trees where their hashes differ."""
    one = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kind = F.col("o_orderkey") % 1000
    other = one.where(kind != 8).withColumn("o_custkey", F.when(kind == 7, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    other = other.unionByName(one.where(kind == 9).withColumn("o_orderkey", -F.col("o_orderkey")))
    return Mk.differing_keys(one, other, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"], 2)


@query("kpi_blocks", """
WITH c AS (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang AS block, 'n' AS field, n::VARCHAR AS value FROM c UNION ALL SELECT lang, 'chars', chars::VARCHAR FROM c UNION ALL SELECT lang, 'note', 'n: 0 stays' FROM c
UNION ALL SELECT NULL, 'documents', count(*)::VARCHAR FROM documents""")
def kpi_blocks(read):
    """Counts written into the marked blocks of a file, twice, and read again."""
    docs = read("documents")
    spark = docs.sparkSession
    spark.dataSource.register(Kf.KpiFile)
    by = docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    langs = sorted(r[0] for r in by.select("lang").collect())
    path = scratch(spark, "kpi") + ".yaml"
    fs, inner = Kf.file_system(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner) as f:
        f.write(("# counts\nmetrics:\n" + "".join(f"  - id: {x}\n    # by language\n    n: null\n    chars: 0\n    note: n: 0 stays\n" for x in langs)).encode())
    rows = by.select(F.col("lang").alias("block"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("n", "chars")])).alias("v")).select("block", "v.field", "v.value")
    rows = rows.unionByName(docs.agg(F.count("*").cast("string").alias("value")).select(F.lit(None).cast("string").alias("block"), F.lit("documents").alias("field"), "value"))
    for _ in range(2):
        rows.write.format("kpi_file").mode("append").save(path)
    return spark.read.format("kpi_file").load(path)


# --- readers ---


@query("json_by_suffix", "SELECT part, n_nationkey, n_name FROM nation, (SELECT unnest(['array', 'lines', 'checked']) AS part)")
def json_by_suffix(read):
    """The same rows from an array document, from lines, and from an array that must be one."""
    nation = read("nation").select("n_nationkey", "n_name")
    spark, schema = nation.sparkSession, nation.schema
    root = scratch(spark, "suffix")
    Si.write_jsonl(nation, f"{root}/lines.jsonl")
    array = nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))  # one document
    array.coalesce(1).write.text(f"{root}/array.json")
    found = [Rd.json_rows(spark, f"{root}/array.json", schema), Rd.json_rows(spark, f"{root}/lines.jsonl", schema), Rd.json_array(spark, f"{root}/array.json", schema)]
    return functools.reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(p)) for d, p in zip(found, ("array", "lines", "checked"), strict=True)])


@query("json_by_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def json_by_key(read):
    """Rows of array documents by key: the last one counts, in documents by name and inside a document. A document has some 200,000 rows."""
    events = read("events").select("user_id", "event_id")
    path = scratch(events.sparkSession, "by-key")
    for k in range(3):  # documents by ranges of events, whose names follow them
        part = events.where(F.floor(F.col("event_id") / 4000) == k if k < 2 else F.col("event_id") >= 8000)
        n = part.count() // 200_000 + 1
        Si.write_json_arrays(part.repartitionByRange(n, "event_id").sortWithinPartitions("event_id"), f"{path}/{k}")
    return Rd.json_array_by_key(events.sparkSession, f"{path}/*", events.schema, "user_id")


@query("lexicon_file", "SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)")
def lexicon_file(read):
    """The words of the items as a lexicon file, read again; its comments and count are no words."""
    words = read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term"))
    spark = words.sparkSession
    path = scratch(spark, "lexicon")
    text = Si.word_list_text("words", words, ["of the items"])
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.text(path)
    return Rd.word_list(spark, path)


@query("setting_lines", "SELECT 'KEY_' || p_partkey AS key, p_name AS value FROM part")
def setting_lines(read):
    """KEY=value lines between comments and blanks, quoted and bare."""
    quote = F.when(F.col("p_partkey") % 2 == 0, F.lit('"')).otherwise("")
    line = F.concat(F.lit("  KEY_"), F.col("p_partkey").cast("string"), F.lit(" = "), quote, "p_name", quote)
    return Rd.env_lines(read("part").select(F.explode(F.array(line, F.lit("# NO=1"), F.lit(""), F.lit("no sign"))).alias("value")))


# --- texts ---

LIST_SQL = r"\[\s*''[^'']*''(?:\s*,\s*''[^'']*'')*\s*\]"


@query("clean_lists", rf"""
WITH p AS (SELECT doc_id, '[''a' || doc_id || ''', ''b''] ' || replace(replace(replace(text, '<', ''), '[', ''), ']', '') || ' see [ ''c'' ]' AS t, text FROM documents),
s AS (SELECT doc_id, string_split_regex(t, '{LIST_SQL}') AS parts, list_transform(regexp_extract_all(t, '{LIST_SQL}'), lambda x: array_to_string(regexp_extract_all(x, '''([^'']*)''', 1), '、')) AS items FROM p)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(parts, lambda x, i: x || coalesce(items[i], '')), ''), '<[^>]+>', '', 'g'), '[ \t\x{{3000}}]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')) AS digest FROM s""")
def clean_lists(read):
    """List literals before and behind prose become their items, in place."""
    bare = F.regexp_replace(F.col("text"), r"[<\[\]]", "")
    t = F.concat(F.lit("['a"), F.col("doc_id").cast("string"), F.lit("', 'b'] "), bare, F.lit(" see [ 'c' ]"))
    return read("documents").select("doc_id", F.sha2(X.clean(t).cast("binary"), 256).alias("digest"))


@query("target_lines", """
SELECT doc_id, CASE WHEN len(k) = 0 AND len(e) = 0 THEN '-' ELSE '保留: ' || CASE WHEN len(k) > 0 THEN array_to_string(k, '、') ELSE '-' END || chr(10) || '解释: ' || CASE WHEN len(e) > 0 THEN array_to_string(e, '、') ELSE '-' END END AS line,
       array_to_string(k || ['x' || doc_id, 'y'], '|') AS keep, array_to_string(e, '|') AS explain
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE w[1:2] END AS k, CASE WHEN doc_id % 2 = 0 THEN [] ELSE w[3:5] END AS e
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM documents))""")
def target_lines(read):
    """Target texts as they are written; and parsed with a second line of one head behind them."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    none = F.array().cast("array<string>")
    rows = read("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.slice(w, 1, 2)).alias("k"), F.when(F.col("doc_id") % 2 == 0, none).otherwise(F.slice(w, 3, 3)).alias("e"))
    rows = rows.select("doc_id", X.format_target(F.col("k"), F.col("e")).alias("line"))
    p = rows.select("*", X.parse_target(F.concat("line", F.lit("\n 保留： x"), F.col("doc_id").cast("string"), F.lit(" 、、y "))).alias("p"))
    return p.select("doc_id", "line", F.array_join("p.keep", "|").alias("keep"), F.array_join("p.explain", "|").alias("explain"))


@query("numeric_spans", r"""
SELECT doc_id, array_to_string(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)?') || regexp_extract_all(t, '[一二三]+(?:天|次)') || regexp_extract_all(t, '[一二三]+分之[一二三]+'), '|') AS spans
FROM (SELECT doc_id, text || ' 二天 ' || doc_id || '.5 三分之一 一次' AS t FROM documents)""")
def numeric_spans(read):
    t = F.concat("text", F.lit(" 二天 "), F.col("doc_id").cast("string"), F.lit(".5 三分之一 一次"))
    return read("documents").select("doc_id", F.array_join(X.numeric_spans(t, numeral="[一二三]+(?:天|次)", fraction="[一二三]+分之[一二三]+"), "|").alias("spans"))


# --- sets, lexicons, pools ---


@query("same_sets", "SELECT 'languages' AS what, true AS same UNION ALL SELECT 'sources', false")
def same_sets(read):
    """Languages of the documents against those of their labelled half and the rest; sources against all but one of them."""
    d = read("documents")
    langs, sources = d.select("lang"), d.select("source")
    found = [("languages", Se.same_set(langs, langs.distinct())), ("sources", Se.same_set(sources, sources.where("source != 'src0'")))]
    return d.sparkSession.createDataFrame(found, "what string, same boolean")


@query("lexicon_integrity", """
SELECT c.n AS n_chars, m.n AS n_more, t.n AS n_terms, c.n = m.n AND t.n > 0 AS ok
FROM (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(string_split(text, '')) AS x FROM documents) WHERE x != '') c,
     (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(string_split(text, '')) AS x FROM benchmark) WHERE x != '') m,
     (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)) t""")
def lexicon_integrity(read):
    """Sizes of word lists that the tables give, against a demand."""
    chars = lambda name: spread(read(name)).select(F.explode(F.array_distinct(F.filter(F.split("text", ""), lambda x: x != ""))).alias("x"))
    one, more = chars("documents"), chars("benchmark")
    n = more.distinct().count()
    return Lx.integrity(one, more, read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))), n, n)


@query("lexicon_gap", f"""
WITH s AS (SELECT d.doc_id, d.source, coalesce(passed::DOUBLE / n, 0.0) AS strict
           FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(token IN ('kg', 'the', 'of', 'and')) AS passed FROM {SCORE_SQL} WHERE regexp_matches(token, '^[A-Za-z]') GROUP BY doc_id) USING (doc_id))
SELECT round(plain, 9) AS plain, round(hard, 9) AS hard, round(plain - hard, 9) AS gap, plain - hard >= 0.2 AS passed
FROM (SELECT avg(strict) FILTER (WHERE source = 'src0') AS plain, avg(strict) FILTER (WHERE source != 'src0') AS hard FROM s)""")
def lexicon_gap(read):
    """Mean strict scores of one source and of the others."""
    d = spread(read("documents"))
    scored = d.select("source", Lx.readability(d.sparkSession, F.col("text"), LEXICON, failures=False)["strict"].alias("strict"))
    return Lx.gap_of(scored, F.col("source") == "src0").select(r9("plain"), r9("hard"), r9("gap"), "passed")


@query("adversarial_subset", """
WITH r AS (SELECT doc_id AS case_id, substr(text, 1, 6) AS candidate_text, CASE WHEN n_chars < 900 THEN 'short' ELSE 'long' END AS kind, toxic = 1 AS positive FROM documents JOIN labels USING (doc_id)),
q AS (SELECT kind, count(*) AS n FROM r WHERE positive GROUP BY kind)
SELECT case_id, kind, true AS label FROM r WHERE positive
UNION ALL SELECT case_id, kind, false FROM (SELECT r.*, row_number() OVER (PARTITION BY kind ORDER BY case_id, candidate_text) AS k FROM r WHERE NOT positive) JOIN q USING (kind) WHERE k <= q.n""")
def adversarial_subset(read):
    """Positives held out, and as many negatives of each kind."""
    r = read("documents").join(read("labels"), "doc_id").select(F.col("doc_id").alias("case_id"), F.substring("text", 1, 6).alias("candidate_text"), F.when(F.col("n_chars") < 900, "short").otherwise("long").alias("kind"), (F.col("toxic") == 1).alias("label"))
    positives = r.where("label")
    return positives.unionByName(Sy.matched_negatives(r.where("NOT label"), positives, F.col("kind")).select(positives.columns)).select("case_id", "kind", "label")


@query("kind_mismatches", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'digit' ELSE 'lexicon' END AS kind FROM documents WHERE doc_id % 6 IN (0, 5, 1) AND doc_id % 6 != 0 OR doc_id % 6 = 0")
def kind_mismatches(read):
    """Candidates whose planted kind is not that of their shape: numbers stand at odd ids."""
    number = F.col("doc_id") % 2 == 1
    rows = read("documents").select("doc_id", F.when(number, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("w"), F.col("doc_id").cast("string"))).alias("candidate_text"), F.when(F.col("doc_id") % 3 == 0, "digit").otherwise("lexicon").alias("kind"))
    return Pr.kind_mismatches(rows).select("doc_id", "kind")


@query("merged_cases", f"""
SELECT 'case-' || d.doc_id AS id, round(coalesce(passed::DOUBLE / n, 0.0), 4) AS source_readability
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(token IN ('kg', 'the', 'of', 'and')) AS passed FROM {SCORE_SQL} WHERE regexp_matches(token, '^[A-Za-z]') GROUP BY doc_id) USING (doc_id)""")
def merged_cases(read):
    """Authored cases of several files, checked as a whole, with the readability of their sources."""
    d = spread(read("documents"))
    spark = d.sparkSession
    two = F.array(F.lit("a"), F.lit("b"))
    cases = d.select(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("id"),
        *[F.lit(v).alias(k) for k, v in {"scenario": "s", "parent_class": "p", "difficulty": "easy", "targets_failure_mode": "m", "query": "what does it say?"}.items()],
        two.alias("key_points"),
        two.alias("negative_rubric"),
        F.col("text").alias("source_text"),
        F.struct(F.col("doc_id").cast("string").alias("record_id")).alias("provenance"),
    )
    path = scratch(spark, "authored")
    cases.write.json(path)
    read_again = saved(spread(Rd.jsonl(spark, path, cases.schema)), "cases")
    merged = Sl.merge_authored(read_again, LEXICON, required=["id", "query", "key_points"], parents={"s": "p"}, difficulties=["easy"], modes=["m"])
    return merged.select("id", "source_readability")



