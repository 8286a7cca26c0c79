"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows where there is one.

Parameters are Latin-script stand-ins: the test tables hold invented prose in four European languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as Hs
from ..functions import stats as St
from ..functions import text as X
from ..functions.lexical import Lexicon, snap
from ..operators import candidates as Cd
from ..operators import checks as Ck
from ..operators import evaluate as Ev
from ..operators import joins as Jn
from ..operators import probes as Pr
from ..operators import sampling as Sm
from ..operators import sets as Se
from ..operators import synth as Sy
from ..sources.tables import spread

SEED = "20260810"
SHARES = [("test", 20), ("verifier_train", 60), ("reserve", 20)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules and words for the test tables.
RULES = [("license", ["license", "copyright"]), ("english", [" the ", " of "]), ("german", [" der ", " und "]), ("french", [" les ", " des "])]
BUCKETS = [("category", ["the", "und"]), ("negation", ["not", "nicht"]), ("conditional", ["que"])]
BUCKET_SHARES = {"category": 0.45, "plain": 0.30, "thin_source": 0.10, "negation": 0.10, "conditional": 0.05}
TERMS = ["tion", "ing", "lich", "eau", "ción"]
WORDS = r"[A-Za-z]+"
HARD_WORDS = ["with", "that", "from", "this", "nicht", "sich", "dans", "pour"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), whose type is that of count."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir, f=f: f(lambda n: t(spark, sf_dir, n))
        if sql:
            ORACLE_SQL[name] = plain_counts(sql)
        return f

    return put


def h8(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"


POOL_SQL = f"(SELECT doc_id, CASE WHEN b < 20 THEN 'test' WHEN b < 80 THEN 'verifier_train' ELSE 'reserve' END AS pool FROM (SELECT doc_id, {h8(f"'{SEED}:' || doc_id")} % 100 AS b FROM documents))"


def wilson_sql(k: str, n: str, sign: str) -> str:
    p, z = f"({k}::DOUBLE / {n})", "1.96::DOUBLE"
    side = f"({p} + {z} * {z} / (2 * {n}::DOUBLE)) {sign} {z} * sqrt({p} * (1 - {p}) / {n}::DOUBLE + {z} * {z} / (4 * {n}::DOUBLE * {n}::DOUBLE))"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({side}) / (1 + {z} * {z} / {n}::DOUBLE))) ELSE 0.0::DOUBLE END"


def rate_sql(k: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {k}::DOUBLE / {n} ELSE 0.0::DOUBLE END"


def r9(column: str):
    return F.round(F.col(column), 9).alias(column)


def contains_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def pools(read) -> DataFrame:
    return Sm.split_records(read("documents"), "doc_id", SEED, SHARES)


@query("split_pool_counts", f"""
SELECT pool, n, n::DOUBLE / total AS share, round({wilson_sql('n', 'total', '-')}, 9) AS lo, round({wilson_sql('n', 'total', '+')}, 9) AS hi
FROM (SELECT pool, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total
FROM {POOL_SQL}
GROUP BY pool)""")
def split_pool_counts(read):
    n = pools(read).groupBy("pool").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ci = St.wilson(F.col("n"), F.col("total"))
    return n.select("pool", "n", (F.col("n").cast("double") / F.col("total")).alias("share"), F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))


@query("split_verify", """
SELECT id, rule, detail
FROM (SELECT doc_id::VARCHAR AS id, 'without pool' AS rule, '' AS detail
FROM documents
WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id::VARCHAR, 'repeated id', '2'
FROM documents
WHERE doc_id % 10 = 1
UNION ALL SELECT (doc_id + 1000000)::VARCHAR, 'without record', ''
FROM documents
WHERE doc_id % 10 = 2)""")
def split_verify(read):
    """Planted defects: ids without a pool, twice, and of no record."""
    s = pools(read)
    planted = s.where("doc_id % 10 != 0 AND doc_id % 10 != 2").unionByName(s.where("doc_id % 10 = 1"))
    strange = s.where("doc_id % 10 = 2").withColumn("doc_id", F.col("doc_id") + 1000000)
    records = read("documents").where("doc_id % 10 != 2")
    return Ck.split_problems(records, planted.unionByName(strange), [p for p, _ in SHARES], "doc_id")


@query("pool_overlap", f"""
WITH s AS (SELECT *
FROM {POOL_SQL}
UNION ALL SELECT doc_id, 'reserve'
FROM documents
WHERE doc_id % 7 = 0) SELECT a.pool AS a, b.pool AS b, count(DISTINCT x.doc_id) AS n
FROM (SELECT unnest(['test', 'test', 'verifier_train']) AS pool, unnest(['verifier_train', 'reserve', 'reserve']) AS other) a
JOIN (SELECT DISTINCT pool
FROM s) b ON b.pool = a.other
LEFT JOIN (SELECT y.doc_id, y.pool AS p, z.pool AS q
FROM s y
JOIN s z USING (doc_id)) x ON x.p = a.pool AND x.q = b.pool
GROUP BY ALL""")
def pool_overlap(read):
    s = pools(read).select("doc_id", "pool")
    return Se.overlap_counts(s.unionByName(read("documents").where("doc_id % 7 = 0").select("doc_id", F.lit("reserve").alias("pool"))), "doc_id", [p for p, _ in SHARES])


@query("index_stats", "SELECT source AS lib, count(*) AS n, count_if(trim(substr(text, 1, 20)) != '') AS named FROM documents GROUP BY source")
def index_stats(read):
    return read("documents").select(F.col("source").alias("lib"), F.trim(F.substring("text", 1, 20)).alias("name")).groupBy("lib").agg(F.count("*").alias("n"), F.count_if(F.col("name") != "").alias("named"))


@query("filled_fields", """
SELECT c_custkey, array_to_string(list_filter([CASE WHEN trim(c_name) != '' THEN 'c_name' END, CASE WHEN trim(c_mktsegment) != '' AND c_custkey % 3 != 0 THEN 'c_mktsegment' END], lambda x: x IS NOT NULL), '|') AS filled_fields
FROM customer""")
def filled_fields(read):
    c = read("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    names = F.filter(F.array(*[F.when(F.trim(F.col(x)) != "", F.lit(x)) for x in ("c_name", "c_mktsegment")]), lambda x: x.isNotNull())
    return c.select("c_custkey", F.array_join(names, "|").alias("filled_fields"))


@query("leak_check_prefix60", """
SELECT doc_id
FROM documents d
WHERE NOT EXISTS (SELECT 1
FROM documents f
WHERE f.doc_id % 5 = 0 AND f.doc_id != d.doc_id AND substr(f.text, 1, 60) = substr(d.text, 1, 60)) AND doc_id % 5 != 0""")
def leak_check_prefix60(read):
    d = read("documents").select("doc_id", "text")
    return Jn.prefix_leak(d.where("doc_id % 5 != 0"), d.where("doc_id % 5 = 0"), "text").select("doc_id")


@query("dedup_last_wins", """
SELECT conv_id, role, turn, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r
FROM conversations)
WHERE r = 1""")
def dedup_last_wins(read):
    return Sm.last_wins(read("conversations"), ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn", "text")


@query("dup_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def dup_keys(read):
    return read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 1")


CLASSIFY_SQL = "CASE " + " ".join(f"WHEN {contains_sql('text', w)} THEN '{n}'" for n, w in RULES) + " ELSE 'other' END"
MATCHED_SQL = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for _, ws in RULES for w in ws) + " ELSE '-' END"


@query("rule_classify", f"SELECT doc_id, {CLASSIFY_SQL} AS scenario, {MATCHED_SQL} AS matched FROM documents")
def rule_classify(read):
    return read("documents").select("doc_id", X.classify(F.col("text"), RULES, "other", "-").alias("c")).select("doc_id", "c.scenario", "c.matched")


ALLOCATE_SQL = """WITH f AS (SELECT {stratum} AS stratum, sum({weight})::BIGINT AS freq FROM {table} GROUP BY 1),
e AS (SELECT *, count(*) OVER () AS k, freq * (270 - 15 * count(*) OVER ())::DOUBLE / greatest(sum(freq) OVER (), 1)::DOUBLE AS exact FROM f),
b AS (SELECT *, floor(exact)::BIGINT AS base FROM e),
l AS (SELECT *, (270 - 15 * k - sum(base) OVER ())::BIGINT AS remain, row_number() OVER (ORDER BY exact - base DESC, stratum) AS r FROM b)
SELECT stratum, freq, (15 + base + floor(remain / k)::BIGINT + CASE WHEN r <= remain % k THEN 1 ELSE 0 END)::BIGINT AS n FROM l"""


def allocated(rows: DataFrame, stratum: str, weight: str) -> DataFrame:
    freq = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.sum(weight).cast("long").alias("freq"))
    return Sm.allocate(freq, "stratum", "freq", 270, 15)


@query("weighted_allocation", ALLOCATE_SQL.format(stratum="lang", weight="n_chars", table="documents"))
def weighted_allocation(read):
    return allocated(read("documents"), "lang", "n_chars")


@query("allocation_sensitivity", ALLOCATE_SQL.format(stratum="lang", weight="quality", table="(SELECT d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE contains(d.text, 'tion') OR contains(d.text, 'ing'))"))
def allocation_sensitivity(read):
    d = read("documents").where(X.contains_any(F.col("text"), ["tion", "ing"]))
    return allocated(d.join(read("labels"), "doc_id"), "lang", "quality")


@query("freq_rollup", f"""
SELECT scenario, lang, sum(n_chars)::BIGINT AS freq, count(*) AS n
FROM (SELECT *, {CLASSIFY_SQL} AS scenario
FROM documents)
WHERE scenario != 'other'
GROUP BY ROLLUP (scenario, lang)""")
def freq_rollup(read):
    rows = read("documents").withColumn("scenario", X.classify(F.col("text"), RULES, "other", "-")["scenario"]).where("scenario != 'other'")
    return rows.rollup("scenario", "lang").agg(F.sum("n_chars").alias("freq"), F.count("*").alias("n"))


@query("topn_per_stratum", f"""
SELECT lang, doc_id, r AS rank
FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN contains(text, 'license') THEN 0 ELSE 1 END, sha256('{SEED}:' || lang || ':' || doc_id), doc_id) AS r
FROM documents)
WHERE r <= 5""")
def topn_per_stratum(read):
    return Sm.top_n_per_stratum(read("documents").select("doc_id", "lang", "text"), "lang", "doc_id", 5, SEED, F.col("text").contains("license")).select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


BUCKET_SQL = "CASE WHEN length(text) < 150 THEN 'thin_source' " + " ".join(f"WHEN {contains_sql('text', w)} THEN '{n}'" for n, w in BUCKETS) + " ELSE 'plain' END"


@query("bucket_quota_sample", f"SELECT bucket, doc_id FROM (SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY sha256('{SEED}:' || bucket || ':' || doc_id), doc_id) AS r FROM (SELECT doc_id, {BUCKET_SQL} AS bucket FROM documents)) JOIN (VALUES " + ", ".join(f"('{b}', {round(40 * s)})" for b, s in BUCKET_SHARES.items()) + ") q(b, n) ON b = bucket AND r <= n")
def bucket_quota_sample(read):
    rows = read("documents").select("doc_id", X.bucket_of(F.col("text"), 150, BUCKETS).alias("bucket"))
    return Sm.quota_sample(rows, "bucket", "doc_id", 40, BUCKET_SHARES, SEED).select("bucket", "doc_id")


@query("stratified_label_sample", f"""
SELECT doc_id, quality
FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256('{SEED}:' || doc_id), doc_id::VARCHAR) AS r
FROM labels)
WHERE r <= 20""")
def stratified_label_sample(read):
    return Sm.stratified_sample(read("labels"), "quality", F.col("doc_id").cast("string"), 20, SEED).select("doc_id", "quality")


RULE_ROWS_SQL = "(" + " UNION ALL ".join(f"SELECT '{n}' AS scenario, {i} AS place, doc_id FROM documents WHERE {contains_sql('text', w)}" for i, (n, w) in enumerate(RULES)) + ")"
GREEDY_SQL = f"""WITH c AS (SELECT scenario, place, doc_id, sha256('{SEED}:' || scenario || ':' || doc_id) AS h
FROM {RULE_ROWS_SQL}), o AS (SELECT scenario, row_number() OVER (ORDER BY count(*), min(place)) AS i
FROM c
GROUP BY scenario)"""
for _i in range(1, len(RULES) + 1):
    _taken = " AND ".join(f"doc_id NOT IN (SELECT doc_id FROM p{j})" for j in range(1, _i)) or "true"
    GREEDY_SQL += f", p{_i} AS (SELECT scenario, doc_id FROM c WHERE scenario = (SELECT scenario FROM o WHERE i = {_i}) AND {_taken} ORDER BY h, doc_id LIMIT 10)"
GREEDY_SQL += " " + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, len(RULES) + 1))


@query("greedy_exclusive_sample", GREEDY_SQL)
def greedy_exclusive_sample(read):
    """Strata overlap: a document belongs to each rule that it fits."""
    rows = None
    for name, words in RULES:
        part = read("documents").where(X.contains_any(F.col("text"), words)).select(F.lit(name).alias("scenario"), "doc_id")
        rows = part if rows is None else rows.unionByName(part)
    return Sm.greedy_exclusive(rows, "scenario", "doc_id", {n: 10 for n, _ in RULES}, SEED).select("scenario", "doc_id")


@query("holdout_split", """
WITH x AS (SELECT l.doc_id, l.quality = 0 AS fail, sha256('holdout:' || substr(d.text, 1, 64)) AS h, d.text
FROM labels l
JOIN documents d USING (doc_id)), n AS (SELECT round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS size, count_if(fail) AS fails
FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY fail ORDER BY h, text, doc_id) AS k
FROM x, n) SELECT pool, fail, count(*) AS n
FROM (SELECT fail, CASE WHEN CASE WHEN fail THEN k <= least(fails, round_even(size * 0.3::DOUBLE, 0)::BIGINT) ELSE k <= size - least(fails, round_even(size * 0.3::DOUBLE, 0)::BIGINT) END THEN 'holdout' ELSE 'train' END AS pool
FROM r)
GROUP BY ALL""")
def holdout_split(read):
    rows = read("labels").join(read("documents").select("doc_id", "text"), "doc_id").withColumn("fail", F.col("quality") == 0)
    return Sm.holdout_split(rows, "fail", "text", 0.2, 0.3).groupBy("pool", "fail").agg(F.count("*").alias("n"))


@query("train_val_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('rx:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.05::DOUBLE)::BIGINT) THEN 'val' ELSE 'train' END AS pool
FROM documents""")
def train_val_split(read):
    return Sm.train_val_split(read("documents").select("doc_id"), "doc_id")


@query("oversample_positives", "SELECT doc_id, toxic FROM labels, unnest(range(CASE WHEN toxic = 1 THEN 3 ELSE 1 END))")
def oversample_positives(read):
    return Sm.oversample(read("labels"), F.col("toxic") == 1, 3).select("doc_id", "toxic")


@query("source_share_cap", """
WITH RECURSIVE sizes AS (SELECT list(n) AS s FROM (SELECT count(*) AS n FROM documents GROUP BY source)),
f AS (SELECT 0 AS i, s FROM sizes UNION ALL SELECT i + 1, list_transform(s, lambda n: least(n, floor(list_sum(s) * 0.06::DOUBLE)::BIGINT)) FROM f WHERE list_max(s) > floor(list_sum(s) * 0.06::DOUBLE)::BIGINT)
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= (SELECT list_max(s) FROM f ORDER BY i DESC LIMIT 1)""")
def source_share_cap(read):
    return Sm.cap_source_share(read("documents").select("doc_id", "source"), "source", "doc_id", 0.06)


@query("source_concentration", """
SELECT max(n)::BIGINT AS largest, sum(n)::BIGINT AS total, max(n)::DOUBLE / sum(n)::DOUBLE AS share
FROM (SELECT count(*) AS n
FROM documents
GROUP BY source)""")
def source_concentration(read):
    by = read("documents").groupBy("source").agg(F.count("*").alias("n"))
    return by.agg(F.max("n").alias("largest"), F.sum("n").alias("total"), (F.max("n").cast("double") / F.sum("n")).alias("share"))


@query("kind_quota", """
SELECT lang AS kind, doc_id
FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r
FROM documents)
JOIN (SELECT d.lang AS l, count(*) AS n
FROM documents d
JOIN labels USING (doc_id)
WHERE quality = 0
GROUP BY 1) ON l = lang AND r <= n""")
def kind_quota(read):
    d = read("documents").withColumnRenamed("lang", "kind")
    quota = d.join(read("labels").where("quality = 0"), "doc_id").groupBy("kind").agg(F.count("*").alias("n"))
    return Sm.kind_quota(d.select("kind", "doc_id"), "kind", quota, [F.col("doc_id")]).select("kind", "doc_id")


@query("dense_sample_ids", f"SELECT format('u-{{:03d}}', (row_number() OVER (ORDER BY h, conv_id, turn) - 1)::BIGINT) AS id, conv_id, turn FROM (SELECT conv_id, turn, sha256('sample:' || conv_id || ':' || turn || ':{SEED}') AS h FROM conversations WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = conv_id AND quality = 0) ORDER BY h, conv_id, turn LIMIT 30)")
def dense_sample_ids(read):
    used = read("labels").where("quality = 0").select(F.col("doc_id").alias("conv_id"))
    left = Jn.unless_present(read("conversations").where("role = 'user'"), used, ["conv_id"])
    order = [Hs.seeded("sample", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(SEED)), F.col("conv_id"), F.col("turn")]
    return Sm.dense_ids(left, order, "u", 30).select("id", "conv_id", "turn")


@query("clean_html", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\x{3000}]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+$', '', 'g') AS text
FROM pages""")
def clean_html(read):
    return read("pages").select("page_id", X.clean(F.col("html")).alias("text"))


@query("length_band_filter", f"""
SELECT doc_id, length(text)::BIGINT AS n
FROM documents
WHERE length(text) BETWEEN 40 AND 1200 AND NOT {contains_sql('text', ['password', 'AKIA'])} AND length(regexp_replace(text, '[^@]', '', 'g')) < 2""")
def length_band_filter(read):
    bad = X.excluded_population(F.col("text"), None, ["password", "AKIA"], [], "") | (F.regexp_count("text", F.lit("@")) >= 2)
    return read("documents").where(F.length("text").between(40, 1200) & ~bad).select("doc_id", F.length("text").cast("long").alias("n"))


@query("relevance", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(substr(text, 1, 20), '{w}') THEN 'name:{w}'" for w in TERMS) + " " + " ".join(f"WHEN contains(text, '{w}') THEN 'text:{w}'" for w in TERMS) + " ELSE '' END AS elder_match FROM documents")
def relevance(read):
    return read("documents").select("doc_id", X.relevance(F.substring("text", 1, 20), F.col("text"), TERMS).alias("elder_match"))


@query("sentence_stats", r"""
SELECT doc_id, n_sentences, chars::BIGINT AS n_visible, CASE WHEN n_sentences > 0 THEN chars::DOUBLE / n_sentences ELSE 0.0::DOUBLE END AS mean_sentence
FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?;\n]+'), lambda s: length(regexp_replace(s, '\s', '', 'g')) > 0))::BIGINT AS n_sentences, length(regexp_replace(text, '\s', '', 'g')) AS chars
FROM documents)""")
def sentence_stats(read):
    n, chars = F.size(X.sentences(F.col("text"), r"[.!?;\n]+")).cast("long"), X.visible_length(F.col("text")).cast("long")
    return read("documents").select("doc_id", n.alias("n_sentences"), chars.alias("n_visible")).withColumn("mean_sentence", F.when(F.col("n_sentences") > 0, F.col("n_visible").cast("double") / F.col("n_sentences")).otherwise(0.0))


@query("key_points", r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;\n]'), lambda s: trim(s)), lambda s: length(s) >= 12) AS parts
FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(parts) <= 6 THEN parts ELSE list_transform(list_sort(list_distinct(list_transform(range(6), lambda i: round_even(i * (len(parts) - 1) / 5.0::DOUBLE, 0)::BIGINT))), lambda i: parts[i + 1]) END, '|') AS points
FROM p""")
def key_points(read):
    return read("documents").select("doc_id", F.array_join(X.key_points(F.col("text"), pattern=r"[.;\n]"), "|").alias("points"))


DATE_LATIN = r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?"


@query("mask_datetime", rf"SELECT doc_id, regexp_replace(text, '{DATE_LATIN}', ' ', 'g') AS text FROM documents")
def mask_datetime(read):
    return read("documents").select("doc_id", X.mask_datetime(F.col("text"), DATE_LATIN).alias("text"))


PAIRS_SQL = """(SELECT u.conv_id || '-' || u.turn AS case_id, u.text AS source_text, a.text AS answer
FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def pairs(read) -> DataFrame:
    c = spread(read("conversations"))
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.col("text").alias("source_text"), "answer")


def planted(key):
    """The first 8 hex digits of the SHA-256 of a key, as in h8."""
    return Hs.hex_to_long(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8))


NUMBERED_SQL = f"""(SELECT case_id, k, source_text || ' take ' || (k % 7 + 100) || ' or ' || (k % 5) AS source_text, answer || ' take ' || (k % 3) || ' then ' || (k % 7 + 100) || ' plus 777' AS answer
    FROM (SELECT *, {h8('case_id')} AS k FROM {PAIRS_SQL}))"""


def numbered_pairs(read) -> DataFrame:
    """Pairs with numbers planted on both sides, as the prose has few: one that may be supported, one that is, one that is not."""
    k = planted(F.col("case_id"))
    return pairs(read).select(
        "case_id",
        F.concat("source_text", F.lit(" take "), (k % 7 + 100).cast("string"), F.lit(" or "), (k % 5).cast("string")).alias("source_text"),
        F.concat("answer", F.lit(" take "), (k % 3).cast("string"), F.lit(" then "), (k % 7 + 100).cast("string"), F.lit(" plus 777")).alias("answer"),
    )


PACKED = r"regexp_replace({}, '[\s\x{{85}}\x{{A0}}\x{{0B}}]+', '', 'g')"
DIGITS_SQL = rf"(SELECT case_id, k, source_text, answer, regexp_extract_all({PACKED.format('source_text')}, '[0-9]+(?:\.[0-9]+)?') AS s, regexp_extract_all({PACKED.format('answer')}, '[0-9]+(?:\.[0-9]+)?') AS a FROM {NUMBERED_SQL})"
CANDIDATES_SQL = f"""(SELECT case_id, k, source_text, answer, s, unnest(list_distinct(list_filter(a, lambda x: NOT list_contains(s, x)))) AS candidate_text
FROM {DIGITS_SQL})"""


@query("digit_grounding", f"SELECT case_id, candidate_text, 'digit' AS kind, 2::BIGINT AS red_line_guess FROM {CANDIDATES_SQL}")
def digit_grounding(read):
    """Unsupported numbers."""
    return Cd.extract_candidates(numbered_pairs(read), nfkc=False).select("case_id", "candidate_text", "kind", F.col("red_line_guess").cast("long").alias("red_line_guess"))


@query("flagged_cases", f"SELECT case_id, len(list_filter(a, lambda x: NOT list_contains(s, x))) > 0 AS flag FROM {DIGITS_SQL}")
def flagged_cases(read):
    cases = numbered_pairs(read)
    return Cd.flag_cases(cases, Cd.extract_candidates(cases, nfkc=False)).select("case_id", "flag")


@query("digit_grounding_plain", rf"WITH n AS (SELECT case_id, regexp_extract_all({PACKED.format('source_text')}, '[0-9]+(?:\.[0-9]+)?') AS s, regexp_extract_all({PACKED.format('answer')}, '[0-9]+(?:\.[0-9]+)?') AS a FROM (SELECT p.case_id, p.source_text || ' dose ' || length(p.source_text) AS source_text, p.answer || ' dose ' || (length(p.source_text) % 50) AS answer FROM {PAIRS_SQL} p)) SELECT case_id, candidate_text FROM (SELECT case_id, unnest(list_distinct(list_filter(a, lambda x: NOT list_contains(s, x)))) AS candidate_text FROM n)")
def digit_grounding_plain(read):
    cases = pairs(read).select("case_id", F.concat("source_text", F.lit(" dose "), F.length("source_text").cast("string")).alias("source_text"), F.concat("answer", F.lit(" dose "), (F.length("source_text") % 50).cast("string")).alias("answer"))
    return Cd.extract_candidates(cases, nfkc=False).where("kind = 'digit'").select("case_id", "candidate_text")


BENCH_TERMS_SQL = "(SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark))"


def bench_terms(read) -> DataFrame:
    return read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term")).distinct()


@query("lexicon_contains", f"SELECT case_id, term FROM {PAIRS_SQL} p, {BENCH_TERMS_SQL} b WHERE contains(p.answer, b.term)")
def lexicon_contains(read):
    """The contains-join as an equi-join on substrings."""
    return Jn.contains_join(pairs(read).select(F.col("case_id").alias("key"), "answer"), bench_terms(read), text="answer").withColumnRenamed("key", "case_id")


@query("lexicon_grounding", f"SELECT case_id, term AS candidate_text FROM {PAIRS_SQL} p, {BENCH_TERMS_SQL} b WHERE contains({PACKED.format('p.answer')}, b.term) AND NOT contains({PACKED.format('p.source_text')}, b.term)")
def lexicon_grounding(read):
    return Cd.extract_candidates(pairs(read), bench_terms(read), nfkc=False).where("kind = 'lexicon'").select("case_id", "candidate_text")


@query("list_ordinals", r"""
SELECT doc_id, c AS candidate
FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS c
FROM (SELECT doc_id, (doc_id % 4) || '. first' || chr(10) || text AS text
FROM documents))
WHERE regexp_matches(text, '(?m)^\s*' || c || '[.、)]')""")
def list_ordinals(read):
    d = read("documents").select("doc_id", F.concat((F.col("doc_id") % 4).cast("string"), F.lit(". first\n"), "text").alias("text"))
    rows = d.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))).alias("candidate"))
    return rows.where(X.list_ordinal(F.col("candidate"), F.col("text"))).select("doc_id", "candidate")


def labelled_pool(read) -> DataFrame:
    """A third of the cases fail, on evidence that names one of their numbers."""
    cases = numbered_pairs(read)
    fail = planted(F.col("case_id")) % 3 == 0
    evidence = F.concat(F.lit("says "), (planted(F.col("case_id")) % 3).cast("string"))
    lines = F.array(F.struct(F.lit(0).alias("idx"), F.lit(False).alias("violated"), F.lit("").alias("evidence")), F.struct(F.lit(2).alias("idx"), fail.alias("violated"), evidence.alias("evidence")))
    labelled = cases.withColumns({"verdict": F.when(fail, "fail").otherwise("pass"), "red_lines": lines})
    return Cd.label_pool(labelled, Cd.extract_candidates(cases, nfkc=False))


TRUSTED_SQL = f"(SELECT *, k % 3 = 0 AS label FROM {CANDIDATES_SQL} WHERE k % 3 != 0 OR candidate_text = '0')"


@query("label_pool", f"SELECT case_id, candidate_text, k % 3 = 0 AND candidate_text = '0' AS label FROM {CANDIDATES_SQL}")
def label_pool(read):
    return labelled_pool(read).select("case_id", "candidate_text", "label")


@query("trusted_pool", f"SELECT case_id, candidate_text, 'digit' AS kind, label FROM {TRUSTED_SQL}")
def trusted_pool(read):
    return Cd.trusted_pool(labelled_pool(read)).select("case_id", "candidate_text", "kind", "label")


@query("uncertain_pool", f"SELECT case_id, candidate_text, 'digit' AS kind FROM {CANDIDATES_SQL} WHERE k % 3 = 0 AND candidate_text != '0'")
def uncertain_pool(read):
    return Cd.uncertain_pool(labelled_pool(read)).select("case_id", "candidate_text", "kind")


LEXICON = Lexicon(chars=frozenset(), terms=frozenset(["tion", "tionally", "eau", "lich", "ción"]), units=frozenset(["kg", "the"]), common=frozenset(["of", "and"]))


HARD_SQL = ", ".join(f"'{w}'" for w in HARD_WORDS)


@query("term_density", f"""
SELECT doc_id, n_tokens, n_terms, CASE WHEN n_tokens > 0 THEN 100.0::DOUBLE * n_terms / n_tokens ELSE 0.0::DOUBLE END AS density
FROM (SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_filter(w, lambda x: x IN ({HARD_SQL})))::BIGINT AS n_terms
FROM (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS w
FROM documents))""")
def term_density(read):
    w = read("documents").select("doc_id", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("w"))
    n = w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.filter("w", lambda x: x.isin(HARD_WORDS))).cast("long").alias("n_terms"))
    return n.withColumn("density", F.when(F.col("n_tokens") > 0, 100.0 * F.col("n_terms") / F.col("n_tokens")).otherwise(0.0))


SCORED_SQL = f"""(SELECT d.doc_id, d.lang, l.quality, 1.0::DOUBLE - len(list_filter(w, lambda x: x IN ({HARD_SQL})))::DOUBLE * 4 / greatest(len(w), 1) AS score
FROM (SELECT *, regexp_extract_all(text, '{WORDS}') AS w
FROM documents) d
JOIN labels l USING (doc_id))"""


def scored(read) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    d = read("documents").select("doc_id", "lang", w.alias("w")).join(read("labels"), "doc_id")
    return d.select("doc_id", "lang", "quality", (1.0 - F.size(F.filter("w", lambda x: x.isin(HARD_WORDS))).cast("double") * 4 / F.greatest(F.size("w"), F.lit(1))).alias("score"))


@query("headroom_rollup", f"""
SELECT lang, (grouping(lang) = 1) AS is_total, count(*) AS n, count_if(score >= 0.9) AS passed, round({rate_sql('count_if(score >= 0.9)', 'count(*)')}, 9) AS pass_rate, count_if(score < 0.9) AS headroom, round(avg(score), 9) AS mean
FROM {SCORED_SQL}
GROUP BY ROLLUP (lang)""")
def headroom_rollup(read):
    out = scored(read).rollup("lang").agg((F.grouping("lang") == 1).alias("is_total"), F.count("*").alias("n"), F.count_if(F.col("score") >= 0.9).alias("passed"), F.count_if(F.col("score") < 0.9).alias("headroom"), F.round(F.avg("score"), 9).alias("mean"))
    return out.withColumn("pass_rate", F.round(St.rate(F.col("passed"), F.col("n")), 9))


@query("positional_quantiles", """
SELECT lang, count(*) AS n, list_sort(list(n_chars))[least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::BIGINT + 1] AS median, list_sort(list(n_chars))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1] AS p90
FROM documents
GROUP BY lang""")
def positional_quantiles(read):
    return Ev.positional_quantile(read("documents"), ["lang"], "n_chars", {"median": 0.5, "p90": 0.9}).withColumn("n", F.col("n").cast("long"))


RATES_SQL = f"""slice, tp, fp, fn, tn, round({rate_sql('fn', '(tp + fn)')}, 9) AS miss_rate, round({rate_sql('fp', '(fp + tn)')}, 9) AS false_alarm, round(CASE WHEN tp + fn > 0 THEN 1 - {wilson_sql('tp', '(tp + fn)', '-')} ELSE 1.0::DOUBLE END, 9) AS miss_rate_upper"""
FLAG_ROWS_SQL = """(SELECT l.doc_id, d.lang, l.quality = 0 AS label, contains(d.text, '!!') OR d.n_chars < 300 AS flag
FROM labels l
JOIN documents d USING (doc_id))"""


def flag_rows(read) -> DataFrame:
    return read("labels").join(read("documents").select("doc_id", "lang", "text", "n_chars"), "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("label"), (F.col("text").contains("!!") | (F.col("n_chars") < 300)).alias("flag"))


@query("confusion_slices", f"""
SELECT {RATES_SQL}
FROM (SELECT slice, count_if(label AND flag) AS tp, count_if(NOT label AND flag) AS fp, count_if(label AND NOT flag) AS fn, count_if(NOT label AND NOT flag) AS tn
FROM (SELECT 'overall' AS slice, label, flag
FROM {FLAG_ROWS_SQL}
UNION ALL SELECT 'lang:' || lang, label, flag
FROM {FLAG_ROWS_SQL}
UNION ALL SELECT 'negatives', label, flag
FROM {FLAG_ROWS_SQL}
WHERE NOT label)
GROUP BY slice)""")
def confusion_slices(read):
    slices = {"overall": F.lit(True), "negatives": ~F.col("label")} | {f"lang:{x}": F.col("lang") == x for x in ("en", "de", "fr", "es")}
    out = Ev.confusion_slices(flag_rows(read), F.col("label"), F.col("flag"), slices)
    return out.select("slice", "tp", "fp", "fn", "tn", r9("miss_rate"), r9("false_alarm"), r9("miss_rate_upper"))


@query("kappa", f"""
SELECT n, round(agreement, 9) AS agreement, round(CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN 1 ELSE (agreement - pe) / (1 - pe) END, 9) AS kappa
FROM (SELECT n, (tp + tn)::DOUBLE / n AS agreement, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / (n::DOUBLE * n::DOUBLE) AS pe
FROM (SELECT count(*) AS n, count_if(label AND flag) AS tp, count_if(NOT label AND flag) AS fp, count_if(label AND NOT flag) AS fn, count_if(NOT label AND NOT flag) AS tn
FROM {FLAG_ROWS_SQL}))""")
def kappa(read):
    rows = flag_rows(read)
    return Ev.with_rates(rows.agg(*Ev.confusion_counts(F.col("label"), F.col("flag")))).select("n", r9("agreement"), r9("kappa"))


@query("mixed_groups", """
SELECT conv_id, all_correct, n AS rows
FROM (SELECT conv_id, count(DISTINCT label) AS k, bool_and(label = flag) AS all_correct, count(*) AS n
FROM (SELECT conv_id, length(text) > 200 AS label, contains(text, '.') AND length(text) > 180 AS flag
FROM conversations)
GROUP BY conv_id)
WHERE k = 2""")
def mixed_groups(read):
    return Ev.mixed_groups(read("conversations").withColumn("long", F.length("text")), "conv_id", F.col("long") > 200, F.col("text").contains(".") & (F.col("long") > 180)).select("conv_id", "all_correct", "rows")


@query("miss_policies", """
WITH g AS (SELECT doc_id, quality = 1 AS gold
FROM labels), p AS (SELECT doc_id, toxic = 0 AS pred
FROM labels
WHERE doc_id % 4 != 0) SELECT (SELECT count(*)
FROM g
LEFT JOIN p USING (doc_id)
WHERE pred IS NULL) AS missing, (SELECT count(*)
FROM g
JOIN p USING (doc_id)
WHERE gold = pred) AS agree_evaluable, (SELECT count(*)
FROM g
JOIN p USING (doc_id)) AS evaluable, (SELECT count(*)
FROM g
LEFT JOIN p USING (doc_id)
WHERE coalesce(gold = pred, false)) AS agree_all, (SELECT count(*)
FROM g) AS all_rows""")
def miss_policies(read):
    gold = read("labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    pred = read("labels").where("doc_id % 4 != 0").select("doc_id", (F.col("toxic") == 0).alias("pred"))
    a = Jn.join_excluding_missing(gold, pred, "doc_id").agg(F.count_if("missing").alias("missing"), F.count_if(~F.col("missing") & (F.col("gold") == F.col("pred"))).alias("agree_evaluable"), F.count_if(~F.col("missing")).alias("evaluable"))
    b = Jn.join_missing_is_wrong(gold, pred, "doc_id", "gold", "pred").agg(F.count_if("agrees").alias("agree_all"), F.count("*").alias("all_rows"))
    return a.join(b)


@query("array_position_join", """
SELECT conv_id, pos, gold, pred
FROM (SELECT conv_id, unnest(range(len(g)))::BIGINT AS pos, unnest(g) AS gold, unnest(list_transform(range(len(g)), lambda i: coalesce(p[i + 1], false))) AS pred
FROM (SELECT conv_id, list(length(text) > 150 ORDER BY turn) AS g, list(contains(text, 'a') ORDER BY turn) FILTER (turn < 3) AS p
FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (turn < 3) > 0))""")
def array_position_join(read):
    c = read("conversations")
    of = lambda rows, value: F.transform(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))), lambda x: x["v"])
    gold = c.groupBy("conv_id").agg(of(c, F.length("text") > 150).alias("gold_array"))
    pred = c.where("turn < 3").groupBy("conv_id").agg(of(c, F.col("text").contains("a")).alias("pred_array"))
    return Jn.join_by_position(gold, pred, "conv_id", "gold_array", "pred_array").withColumn("pos", F.col("pos").cast("long"))


GRID = St.need_grid()


@query("positives_needed", f"""
WITH m AS (SELECT source, round(avg(toxic), 2) AS miss FROM labels JOIN documents USING (doc_id) GROUP BY source), g AS (SELECT unnest({GRID})::BIGINT AS n) SELECT source, miss, coalesce((SELECT min(n)
FROM g
WHERE 1 - {wilson_sql('round_even(n * (1 - miss), 0)', 'n', '-')} <= 0.2), -1) AS needed
FROM m""")
def positives_needed(read):
    """Positives that each source's rate of toxic documents, taken as a miss rate, asks for."""
    rows = read("labels").join(read("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(F.avg("toxic"), 2).alias("miss"))
    return rows.select("source", "miss", F.coalesce(St.positives_needed(F.col("miss"), F.lit(0.2)).cast("long"), F.lit(-1).cast("long")).alias("needed"))


PROBE_ROWS_SQL = """(SELECT doc_id, quality = 0 AS label, contains(text, '!!') AS shouting, n_chars < 300 AS short, contains(text, 'http') AS linked
FROM labels
JOIN documents USING (doc_id))"""


@query("probe_youden", "SELECT probe, tp, fp, fn, tn, round(abs(tpr - fpr), 9) AS j FROM (SELECT probe, tp, fp, fn, tn, " + rate_sql("tp", "(tp + fn)") + " AS tpr, " + rate_sql("fp", "(fp + tn)") + " AS fpr FROM (SELECT probe, count_if(label AND hit) AS tp, count_if(NOT label AND hit) AS fp, count_if(label AND NOT hit) AS fn, count_if(NOT label AND NOT hit) AS tn FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS probe, label, {p} AS hit FROM {PROBE_ROWS_SQL}" for p in ("shouting", "short", "linked")) + ") GROUP BY probe))")
def probe_youden(read):
    d = read("documents").select("doc_id", "text", "n_chars")
    rows = read("labels").join(d, "doc_id").select((F.col("quality") == 0).alias("label"), F.col("text").contains("!!").alias("shouting"), (F.col("n_chars") < 300).alias("short"), F.col("text").contains("http").alias("linked"))
    return Pr.score_probes(rows, ("shouting", "short", "linked"), structural=("shouting", "short")).select("probe", "tp", "fp", "fn", "tn", r9("j"))


FEATURES_SQL = rf"""(
    SELECT label, cut > 0 AS prefix_present, cut > 0 AND contains(inner_text, candidate_text) AS inside_bracket, place_at >= 0.85 * length(answer) AS in_tail, suffix(regexp_replace(answer, '\s+$', ''), '.') AS ends_with_bracket,
           NOT list_contains(s, candidate_text) AS not_grounded, false AS kind_is_lexicon, true AS kind_is_digit, cut > 0 AND contains(inner_text, candidate_text) AND NOT list_contains(s, candidate_text) AS inside_and_not_grounded
    FROM (SELECT *, CASE WHEN contains(after_text, ' or ') THEN left(after_text, strpos(after_text, ' or ') - 1) ELSE after_text END AS inner_text,
                 length(answer) - strpos(reverse(answer), reverse(candidate_text)) + 1 - length(candidate_text) AS place_at
          FROM (SELECT *, substr(answer, cut) AS after_text FROM (SELECT *, coalesce(least(nullif(strpos(answer, 'take '), 0), nullif(strpos(answer, 'then '), 0)), 0) AS cut FROM {TRUSTED_SQL}))))"""


@query("shortcut_probes", f"""
SELECT probe, tp, fp, fn, tn, round(abs({rate_sql('tp', '(tp + fn)')} - {rate_sql('fp', '(fp + tn)')}), 9) AS j, gated, gated AND abs({rate_sql('tp', '(tp + fn)')} - {rate_sql('fp', '(fp + tn)')}) > 0.3 AS failed
FROM (SELECT probe, gated, count_if(label AND hit) AS tp, count_if(NOT label AND hit) AS fp, count_if(label AND NOT hit) AS fn, count_if(NOT label AND NOT hit) AS tn
      FROM ({" UNION ALL ".join(f"SELECT '{p}' AS probe, {str(p in Pr.STRUCTURAL).lower()} AS gated, label, {p} AS hit FROM {FEATURES_SQL}" for p in Pr.PROBES)}) GROUP BY probe, gated)""")
def shortcut_probes(read):
    pool = Cd.trusted_pool(labelled_pool(read))
    scores = Pr.score_probes(Pr.with_probes(pool, ["take ", "then "], ".", close=" or ", nfkc=False))
    return scores.select("probe", "tp", "fp", "fn", "tn", r9("j"), "gated", "failed")


SWAP_SQL = "(('0x' || right(sha256('ab:' || conv_id || ':' || judge), 1))::BIGINT % 2 = 1)"
VOTES_SQL = f"""(SELECT conv_id, judge, CASE WHEN swapped AND raw IN ('A', 'B') THEN translate(raw, 'AB', 'BA') ELSE raw END AS vote
FROM (SELECT conv_id, judge, {SWAP_SQL} AS swapped, CASE (length(text) + judge) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'tie' ELSE 'unsure' END AS raw
FROM conversations, unnest(range(3)) j(judge)
WHERE turn = 1))"""


def votes(read) -> DataFrame:
    c = read("conversations").where("turn = 1").withColumn("judge", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = (F.length("text") + F.col("judge")) % 4
    raw = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "tie").otherwise("unsure")
    return c.select("conv_id", "judge", Ev.unswap(raw, Ev.swapped(F.col("conv_id"), F.col("judge"))).alias("overall"))


@query("ab_votes", f"SELECT 'overall' AS dim, count_if(vote = 'A') AS \"A\", count_if(vote = 'B') AS \"B\", count_if(vote NOT IN ('A', 'B')) AS tie FROM {VOTES_SQL}")
def ab_votes(read):
    return Ev.vote_tallies(votes(read), ["overall"])


@query("ab_majority", f"""
SELECT winner, count(*) AS cases
FROM (SELECT conv_id, CASE WHEN count_if(vote = 'A') > count_if(vote = 'B') THEN 'A' WHEN count_if(vote = 'B') > count_if(vote = 'A') THEN 'B' ELSE 'tie' END AS winner
FROM {VOTES_SQL}
GROUP BY conv_id)
GROUP BY winner""")
def ab_majority(read):
    return Ev.case_majority(votes(read), "conv_id", "overall")


@query("budget_cutoff", """
SELECT event_id, user_id, round(spent, 6) AS spent_before, spent <= 500 AS submitted
FROM (SELECT event_id, user_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent
FROM events)""")
def budget_cutoff(read):
    return Sm.budget_cutoff(read("events"), F.col("value"), [F.col("event_id")], 500.0, by=["user_id"]).select("event_id", "user_id", F.round("spent_before", 6).alias("spent_before"), "submitted")


@query("token_cost", """
SELECT event_type, round(sum((event_id % 97 * 9.5::DOUBLE + event_id % 31 * 1.0::DOUBLE) / 1000000.0::DOUBLE), 9) AS cost
FROM events
GROUP BY event_type""")
def token_cost(read):
    return read("events").groupBy("event_type").agg(F.round(F.sum(Ev.cost(F.col("event_id") % 31, F.col("event_id") % 97)), 9).alias("cost"))


@query("train_set_preflight", """
SELECT n, positives, round(positives::DOUBLE / n, 9) AS share, CASE WHEN positives = 0 THEN 'none' WHEN positives::DOUBLE / n <= 0.05 THEN 'low' WHEN positives::DOUBLE / n <= 0.5 THEN 'normal' ELSE 'high' END AS band
FROM (SELECT count(*) AS n, count_if(toxic = 1) AS positives
FROM labels)""")
def train_set_preflight(read):
    return Ev.train_set_preflight(read("labels"), F.col("toxic") == 1).select("n", "positives", r9("share"), "band")


@query("json_strict_bool", """
SELECT event_id, k, coalesce(k = 87, false) AS flagged
FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events)""")
def json_strict_bool(read):
    p = X.json_object(F.concat(F.lit("answer: "), "props", F.lit(" done")), "k BIGINT")
    return read("events").select("event_id", p["k"].alias("k")).withColumn("flagged", X.strict_true(F.col("k") == 87))


@query("target_roundtrip", """
SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS keep, '' AS explain
FROM (SELECT doc_id, w[1:3] AS list_distinct_ordered
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w
FROM documents))""")
def target_roundtrip(read):
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 3)
    line = X.format_target(words, F.array().cast("array<string>"))
    return read("documents").select("doc_id", X.parse_target(line).alias("p")).select("doc_id", F.array_join("p.keep", "|").alias("keep"), F.array_join("p.explain", "|").alias("explain"))


@query("sft_messages", f"""
SELECT case_id AS id, 'user: ' || source_text || chr(10) || 'assistant: ' || answer AS prompt, CASE WHEN row_number() OVER (ORDER BY sha256('rx:' || case_id), case_id) <= greatest(1, floor(count(*) OVER () * 0.05::DOUBLE)::BIGINT) THEN 'val' ELSE 'train' END AS pool
FROM {PAIRS_SQL}""")
def sft_messages(read):
    rows = pairs(read).select(F.col("case_id").alias("id"), F.concat(F.lit("user: "), "source_text", F.lit("\nassistant: "), "answer").alias("prompt"))
    return Sm.train_val_split(rows, "id").select("id", "prompt", "pool")


@query("shard_packets", """
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 14)::BIGINT AS shard, ((row_number() OVER (ORDER BY doc_id) - 1) % 14)::BIGINT AS position
FROM documents""")
def shard_packets(read):
    return Sm.shards(read("documents").select("doc_id"), [F.col("doc_id")], 14)


@query("case_problems", """
SELECT id, rule, detail
FROM (SELECT doc_id::VARCHAR AS id, 'short text' AS rule, n_chars::VARCHAR AS detail
FROM documents
WHERE n_chars < 60
UNION ALL SELECT doc_id::VARCHAR, 'language', lang
FROM documents
WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT doc_id::VARCHAR, 'count is off', ''
FROM documents
WHERE length(text) != n_chars)""")
def case_problems(read):
    return Ck.problems(read("documents"), "doc_id", {"short text": (F.col("n_chars") < 60, F.col("n_chars")), "language": (~F.col("lang").isin("en", "de", "fr"), F.col("lang")), "count is off": (F.length("text") != F.col("n_chars"), None)})


@query("repeated_texts", "SELECT text AS id, 'repeated text' AS rule, count(*)::VARCHAR AS detail FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(read):
    return Ck.repeated(read("documents"), "text", "repeated text")


@query("fail_rates", "SELECT bucket, n, fails, round(CASE WHEN n > 0 THEN fails::DOUBLE / n ELSE 0 END, 9) AS fail_rate, n >= 20 AS enough FROM (SELECT b.bucket, count(x.doc_id) AS n, count_if(x.quality = 0) AS fails FROM (SELECT unnest(['category', 'plain', 'thin_source', 'negation', 'conditional', 'none']) AS bucket) b LEFT JOIN (SELECT l.doc_id, l.quality, " + BUCKET_SQL + " AS bucket FROM labels l JOIN documents d USING (doc_id)) x USING (bucket) GROUP BY b.bucket)")
def fail_rates(read):
    labels = read("labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("verdict"))
    of = read("documents").select(F.col("doc_id").alias("case_id"), X.bucket_of(F.col("text"), 150, BUCKETS).alias("bucket"))
    return Ck.fail_rates(labels, of, [*BUCKET_SHARES, "none"]).select("bucket", "n", "fails", r9("fail_rate"), "enough")


@query("vocabulary_sets", """
WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS term
FROM documents
WHERE lang = 'en'), a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS term
FROM documents
WHERE lang = 'de'), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS term
FROM benchmark) SELECT term
FROM a
WHERE term NOT IN (SELECT term
FROM f) AND term NOT IN (SELECT term
FROM b) UNION SELECT term
FROM b
WHERE term IN (SELECT term
FROM f) AND term IN (SELECT term
FROM a)""")
def vocabulary_sets(read):
    of = lambda d: d.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    en, de, b = of(read("documents").where("lang = 'en'")), of(read("documents").where("lang = 'de'")), of(read("benchmark"))
    return de.subtract(en).subtract(b).union(b.intersect(en).intersect(de))


@query("section_forward_fill", """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS value
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls
FROM documents)), s AS (SELECT *, last_value(CASE WHEN length(value) > 60 THEN left(value, 10) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section
FROM l) SELECT doc_id, section, count(*) AS n
FROM s
GROUP BY ALL""")
def section_forward_fill(read):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    head = F.when(F.length("value") > 60, F.left("value", F.lit(10)))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


SPEC = Sy.SynthSpec(categories={"tion": ("Alphatin", "Betatin", "Gammatin"), "ing": ("Deltol", "Epsilol")}, default=("Zetan", "Etan"), markers=("tion", "ing", "lich"), number_markers=("the ", "der "), templates=("（补充一句：{names}。）", "（这类：{names}。）", "（顺带说一句，{names}。）"), phrases=("每3天一次", "一天吃2次", "至少2小时", "每半年一次", "不超过7天", "隔4小时以上", "连服5天后", "不超过2片"))


def digest_sql(text: str, k: int) -> str:
    """The whole SHA-256 of a text modulo k."""
    return f"(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({text}), ''), lambda c: ('0x' || c)::BIGINT)), lambda a, c: (a * 16 + c) % {k}))"


def pick_sql(items: list[str], at: str) -> str:
    return "CASE " + at + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


#: The words that training edits plant: all of a group but its last, which is held out.
PLANTED_SQL = "CASE category WHEN 'tion' THEN ['Alphatin', 'Betatin'] WHEN 'ing' THEN ['Deltol'] ELSE ['Zetan'] END"
#: The phrases of training and the numbers in each.
PHRASES_SQL = "(VALUES (0, '每3天一次', ['3', '一次']), (1, '一天吃2次', ['2', '一天']), (2, '至少2小时', ['2']), (3, '每半年一次', ['半年', '一次']), (4, '不超过7天', ['7'])) f(i, phrase, vals)"
TIGHT = "regexp_replace({}, '[\\s\\x{{85}}\\x{{A0}}\\x{{0B}}]+', '', 'g')"
SYNTH_SQL = f"""
WITH p AS (SELECT *, string_split(regexp_replace(source_text, '(tion|lich|ing)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {PAIRS_SQL}),
m AS (SELECT case_id, source_text, answer, k, length(array_to_string(parts[1:k - 1], '')) AS start, parts[k] AS marker FROM (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS k FROM p)),
c AS (SELECT *, substr(source_text, greatest(0, start - 15) + 1, start + length(marker) - greatest(0, start - 15)) AS context FROM m),
g AS (SELECT *, CASE WHEN contains(context, 'tion') THEN 'tion' WHEN contains(context, 'ing') THEN 'ing' ELSE '' END AS category FROM c),
t AS (SELECT case_id, any_value(source_text) AS source_text, any_value(answer) AS answer, category, min(k) AS k FROM g GROUP BY case_id, category),
e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k) - 1 AS i, {PLANTED_SQL} AS names FROM t),
entity AS (
    SELECT case_id AS source_case_id, case_id || '-synth' || CASE WHEN i > 0 THEN (i + 1)::VARCHAR ELSE '' END AS case_id, source_text, rtrim(answer, chr(10) || ' ') || chr(10) || chr(10) ||
           replace({pick_sql(list(SPEC.templates), digest_sql("case_id || ':' || i", 3))}, '{{names}}', array_to_string(names, '、')) AS answer, names AS vals, 0 AS red_line_guess
    FROM e),
first AS (SELECT *, {TIGHT.format('source_text')} AS src, {TIGHT.format('answer')} AS ans, {digest_sql("'numeric:' || case_id", 5)} AS first FROM {PAIRS_SQL} WHERE contains(source_text, 'the ') OR contains(source_text, 'der ')),
found AS (SELECT case_id, source_text, answer, ans, arg_min(phrase, (i - first + 5) % 5) AS phrase, arg_min(vals, (i - first + 5) % 5) AS vals FROM first, {PHRASES_SQL} WHERE len(list_filter(vals, lambda v: contains(src, v))) = 0 GROUP BY ALL),
num AS (
    SELECT case_id AS source_case_id, case_id || '-synthnum' AS case_id, source_text, rtrim(answer, chr(10) || ' ') || chr(10) || chr(10) || '（补充一句：' || phrase || '。）' AS answer, vals, 2 AS red_line_guess
    FROM found WHERE len(list_filter(vals, lambda v: contains(ans, v))) = 0)
SELECT source_case_id, case_id, source_text, answer, unnest(vals) AS candidate_text, red_line_guess, true AS label FROM (SELECT * FROM entity UNION ALL SELECT * FROM num)"""


@query("synth_edits", SYNTH_SQL)
def synth_edits(read):
    """Positives of training; the share of a source stays below its cap here."""
    return Sy.to_candidates(Sy.synthesize(pairs(read), SPEC, source_share=None))


NEGATIVES_SQL = f"""
WITH p AS (SELECT case_id, source_text || ' 每3天 共两周 Alphatin' AS source_text, answer, {TIGHT.format("source_text || ' 每3天 共两周 Alphatin'")} AS src, {TIGHT.format('answer')} AS ans FROM {PAIRS_SQL}),
e AS (SELECT *, {pick_sql(list(SPEC.templates), digest_sql("'groundedneg:' || case_id", 3))} AS template, NOT list_contains(regexp_extract_all(src, '[0-9]+(?:\\.[0-9]+)?'), '2') AS two, {digest_sql("'eqdir:' || case_id", 2)} AS dir, {pick_sql(['至少', '不超过'], digest_sql("'eqformneg:' || case_id", 2))} AS slot FROM p)
SELECT case_id, source_text, 'grounded' AS flavor, rtrim(answer, chr(10) || ' ') || chr(10) || chr(10) || replace(template, '{{names}}', 'Alphatin') AS answer, 'Alphatin' AS candidate_text, 'lexicon' AS kind, 0 AS red_line_guess, false AS label FROM e WHERE NOT contains(ans, 'Alphatin')
UNION ALL
SELECT case_id, source_text, 'equivalent', rtrim(answer, chr(10) || ' ') || chr(10) || chr(10) || '（补充一句：' || slot || CASE WHEN two AND dir = 1 THEN '2周' ELSE '三天' END || '。）', CASE WHEN two AND dir = 1 THEN '2' ELSE '三天' END, CASE WHEN two AND dir = 1 THEN 'digit' ELSE 'cn_numeral' END, 2, false FROM e"""


@query("injection_negatives", NEGATIVES_SQL)
def injection_negatives(read):
    cases = pairs(read).withColumn("source_text", F.concat("source_text", F.lit(" 每3天 共两周 Alphatin")))
    return Sy.injection_negatives(cases, SPEC, ["Alphatin", "Betatin", "Omegol"])


@query("snap_phrases")
def snap_phrases(read):
    d = spread(read("documents"))
    phrase = F.concat(F.substring("text", 11, 12), F.lit("x"))
    return d.select("doc_id", phrase.alias("phrase"), snap(phrase, F.col("text")).alias("snapped"))


@query("content_hash", """
SELECT sha256(string_agg(h, '' ORDER BY doc_id)) AS content_hash, count(*) AS n_rows
FROM (SELECT doc_id, sha256(doc_id || chr(31) || quality || chr(31) || toxic) AS h
FROM labels)""")
def content_hash(read):
    return Hs.content_hash(read("labels"), "doc_id", ["doc_id", "quality", "toxic"])


@query("digest_mod", """
SELECT doc_id, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda c: ('0x' || c)::BIGINT)), lambda a, c: (a * 16 + c) % 3))::BIGINT AS pick
FROM documents""")
def digest_mod(read):
    return read("documents").select("doc_id", Hs.digest_mod(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 3).alias("pick"))


@query("kpi_table", f"""
SELECT 'split' AS metric_id, pool AS field, n::DOUBLE AS value
FROM (SELECT pool, count(*) AS n
FROM {POOL_SQL}
GROUP BY pool)
UNION ALL SELECT 'labels', 'positives', count_if(toxic = 1)::DOUBLE
FROM labels
UNION ALL SELECT 'old', 'kept', 1.0::DOUBLE""")
def kpi_table(read):
    old = read("region").sparkSession.createDataFrame([("old", "kept", 1.0), ("labels", "positives", -1.0)], "metric_id string, field string, value double")
    counts = pools(read).groupBy("pool").agg(F.count("*").cast("double").alias("value")).select(F.lit("split").alias("metric_id"), F.col("pool").alias("field"), "value")
    labels = read("labels").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("value")).select(F.lit("labels").alias("metric_id"), F.lit("positives").alias("field"), "value")
    return Ev.upsert_kpi(old, counts.unionByName(labels))


@query("mock_outputs", "SELECT doc_id, array_to_string(parts[1:greatest(1, len(parts) - h % 3)], '。') AS output FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.;\n]'), lambda p: trim(p) != '') AS parts, " + h8("doc_id::VARCHAR") + " AS h FROM documents)")
def mock_outputs(read):
    return read("documents").select("doc_id", X.mock_output(F.col("text"), F.col("doc_id").cast("string"), pattern=r"[.;\n]").alias("output"))


@query("slot_replacement", """
WITH s AS (SELECT lang, doc_id AS slot, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k
FROM documents
WHERE n_chars < 200), p AS (SELECT lang, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k
FROM documents
WHERE n_chars BETWEEN 2000 AND 2500) SELECT s.lang, slot, coalesce(key, -1) AS key
FROM s
LEFT JOIN p ON s.lang = p.lang AND s.k = p.k""")
def slot_replacement(read):
    d = read("documents")
    return Sm.replace_slots(d.where("n_chars < 200").select("lang", F.col("doc_id").alias("slot")), d.where("n_chars BETWEEN 2000 AND 2500").select("lang", F.col("doc_id").alias("key")), "lang", [F.col("key")]).na.fill(-1, ["key"])


@query("event_windows", """
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total
FROM events
GROUP BY ALL""")
def event_windows(read):
    from ..streaming.resume import windowed_counts

    return windowed_counts(read("events"), "ts", "event_type", "value").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("total", F.round("total", 6))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return QUERIES["split_pool_counts"](spark, sf_dir)
