"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fill_middle, hard_negatives, html_extract, jaccard_join, langid, license_scan, media, mixing, packing, quality, secret_scan, url_filter
from .common import shared_path, table


def _joined_spans(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, CAST(s.start AS STRING), CAST(s.stop AS STRING))), ',')"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.expr(f"CAST(size(filter(secrets, s -> s.kind = '{kind}')) AS BIGINT)")
    base = F.expr(_joined_spans("filter(secrets, s -> s.rank < 3)"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.expr(_joined_spans("secrets")).alias("spans"), count("random").alias("n_random"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.with_packing(table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), parents=True, suffixes=[]).select("page_id", "host", "path", "rule", "verdict")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), folder)
    stored = media.read_archives(spark, folder)
    return stored.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.expr(media.tail_crc32("payload")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn_from_documents(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return fill_middle.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_main_text": op4_main_text,
    "op5_licenses": op5_licenses,
    "op6_media": op6_media,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_jaccard": op9_jaccard,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mixing": op12_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _host_sql(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules_sql(of: str) -> str:
    """The rule's text or verdict of the longest rule that fits; null if none does."""
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text if of == 'rule' else r.verdict}'" for r in ordered) + " END"


ORACLE_SQL: dict[str, str] = {
    # masses as the sum over walks of each length from the seeds, which the operator's rounds converge to
    "op3_url_filter": rf"""
WITH RECURSIVE u AS (
    SELECT page_id, html, {_host_sql('url')} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {_rules_sql('rule')} AS rule, {_rules_sql('verdict')} AS fit FROM u),
h AS (SELECT host, count_if(fit = 'allow') AS allowed, count_if(fit = 'block') AS blocked, count(*) AS n, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS parent FROM j WHERE host != '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*((?:https?:)?//[^"''\s<>]+)', 1)) AS link FROM j),
e AS (SELECT DISTINCT src, dst FROM (
        SELECT src, {_host_sql("regexp_replace(link, '^(?i:https?:)?//', 'x://')")} AS dst FROM l UNION ALL SELECT host, parent FROM h UNION ALL SELECT parent, host FROM h) WHERE src != '' AND dst != '' AND src != dst),
w AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e)),
s AS (SELECT 'trust' AS kind, host, allowed::DOUBLE / n AS mass FROM h WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked::DOUBLE / n FROM h WHERE blocked > 0),
p AS (SELECT 0 AS k, kind, host, mass FROM s UNION ALL SELECT k + 1, kind, dst, sum(mass / degree) FROM p JOIN w USING (kind) WHERE p.host = w.src AND k < 150 GROUP BY k, kind, dst),
m AS (SELECT kind, host, sum(0.15::DOUBLE * pow(0.85::DOUBLE, k) * mass) AS mass FROM p GROUP BY kind, host),
f AS (SELECT kind, (SELECT sum(mass) FROM s WHERE s.kind = m.kind) / sum(mass) AS scale FROM m GROUP BY kind),
r AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass * scale ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN mass * scale ELSE 0 END) AS distrust FROM m JOIN f USING (kind) GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(fit, CASE WHEN coalesce(distrust > trust AND distrust > 2 * trust AND distrust >= 0.001, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN r ON r.host = j.host""",
    "op13_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.r != b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE own
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.own AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op9_jaccard": r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
    FROM d),
t AS (SELECT r, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
    SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.r != b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT r AS x, r AS y FROM s UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y),
least AS (SELECT x, min(doc_id) AS component_id FROM reached JOIN s ON s.r = reached.y GROUP BY x)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON least.x = s.r""",
    "op7_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, i, dw.size, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)""",
}
