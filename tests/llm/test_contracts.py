"""Each registered query over awkward tables, every contract column computed again by plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import license_scan, queries, url_filter

from .fixtures import BENCH, SCHEMA, texts
from .test_fill_middle import brute as brute_middle
from .test_hard_negatives import brute as brute_negatives
from .test_hard_negatives import made
from .test_jaccard import brute as brute_components
from .test_mixing import WORD, brute_targets
from .test_native import base_spans, brute_contamination, brute_rule, brute_url

#: Names of the operators' own columns, as extra columns of the input.
CLASHING = ["n_assign", "secrets", "spans", "__text", "start", "length", "token_ids", "n_words", "labels", "score", "payload", "media", "n_hit", "items", "at", "size", "words", "lang_pred", "rejected", "n", "digest", "h", "component_id", "perplexity", "keep", "log", "key"]


def rows_of_documents():
    rng = random.Random(9)
    out = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts(9))]
    out += [out[12], (20, "another text under an id that is there, of some words", "en"), (20, out[20][1], "en"), (None, "a text without an id of more than five words", None)]
    secret = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:30]
    out.append((900, " ".join(f"token={secret(i)} words {BENCH[0][1]} <|endoftext|>" for i in range(1500)), "en"))
    out.append((901, license_scan.TEMPLATES["mit"] * 30 + " under the mit license" * 500, "en"))
    return out


PAGES = [
    (1, "http://A.example.com/en/x", "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>One <b>bold</b>\n text.<p>Two.</article><div class=comments>no</div></body></html>"),
    (2, "https://www.example.com/en/1?q", "<p>plain"), (3, "http://b.net/es/", ""), (4, None, None), (5, "nothing", "<article>" + "<p>row</p>" * 3000 + "</article>"),
    (1, "http://A.example.com/en/x", "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>One <b>bold</b>\n text.<p>Two.</article><div class=comments>no</div></body></html>"),
]
TEXTS = {1: "T & t\nOne bold text.\nTwo.", 2: "plain", 3: "", 4: "", 5: "\n".join(["row"] * 3000)}


def write(spark, folder, documents, pages, labels):
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in documents], SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("x"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "trust", "text", "paths")}).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(BENCH if documents else [], "item_id long, text string").withColumn("size", F.lit("x")).write.parquet(f"{folder}/benchmark.parquet")
    vectors = made() if documents else []
    spark.createDataFrame([(i, v, k) for i, k, v in vectors], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "at", "rank", "block", "score")}).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("keep", F.lit("x")).write.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    write(spark, folder, rows_of_documents(), PAGES, [(i, int(i % 3 > 0), 0) for i in range(100)] + [(None, 1, 0), (5, 1, 1)])
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    write(spark, folder, [], [], [])
    return folder


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert run(spark, name, nothing) == []


def test_secrets(spark, tables):
    rows = run(spark, "op1_secrets", tables)
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows)
    want = Counter()
    for i, t, _ in rows_of_documents():
        spans = base_spans(t)
        n = Counter(kind for *_, kind in spans)
        joined = ",".join(f"{kind}:{start}:{stop}" for start, _, stop, kind in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == want
    for r in rows:
        every = [s.split(":") for s in r["spans"].split(",") if s]
        order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
        assert [(int(a), order[k]) for k, a, _ in every] == sorted((int(a), order[k]) for k, a, _ in every)
        base = ",".join(":".join(s) for s in every if s[0] != "random")
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"] and all(int(a) < int(b) for _, a, b in every)


def test_packing(spark, tables):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, sequences, of = run(spark, "op2_packing", tables), {}, {}
    ids = {(i, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in rows_of_documents()}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of.setdefault((r["doc_id"], r["doc_tokens"]), Counter())[r["start"], r["length"], r["ids_crc32"]] += 1
    for pieces in sequences.values():
        stops = [0, *[o + n for o, n in sorted(pieces)]]
        assert [o for o, _ in sorted(pieces)] == stops[:-1] and stops[-1] <= 1024
    want = {}
    for i, t, _ in rows_of_documents():
        x = ids[i, t]
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            want.setdefault((i, len(x)), Counter())[a, len(part), zlib.crc32(part.tobytes())] += 1
    assert of == want
    # only the last sequence of each task's group may be far from full
    assert sum(r["length"] for r in rows) / (1024 * len(sequences)) > 0.8


def test_urls(spark, tables):
    rows = run(spark, "op3_url_filter", tables)
    assert sorted(r["page_id"] for r in rows) == sorted(p[0] for p in PAGES)
    for r in rows:
        host, path = brute_url(next(u for i, u, _ in PAGES if i == r["page_id"]))
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.RULES[0].text == "com/"


def test_main_text_rows(spark, tables):
    rows = run(spark, "op4_main_text", tables)
    assert Counter(r["page_id"] for r in rows) == Counter(p[0] for p in PAGES)
    assert all(r["text"] == TEXTS[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in rows)


def test_licenses(spark, tables):
    rows = run(spark, "op5_licenses", tables)
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows)
    want = Counter()
    for i, t, _ in rows_of_documents():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k] == p.split()[0] and w[k : k + len(p.split())] == p.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    for r in rows:
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels) and 0 <= r["score"] <= 1


def test_media(spark, tables):
    rows = run(spark, "op6_media", tables)
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    want = Counter()
    for i, t, _ in rows_of_documents():
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert got == want
    stored = {}
    for r in rows:
        stored.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in stored.values())


def test_decontamination(spark, tables):
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in run(spark, "op7_decontamination", tables))
    want = Counter()
    for i, t, _ in rows_of_documents():
        if i == 900:  # windows of the first item once in every 17 words; the plain search would take long
            words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
            want[i, words, 12 * 1500, 2, hashlib.sha256(b"1,5").hexdigest(), True] += 1  # item 5 begins as item 1 does
            continue
        n, hit, items = brute_contamination(t, BENCH)
        want[i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0] += 1
    assert {k: (got[k], want[k]) for k in got | want if got[k] != want[k]} == {}


def test_language(spark, tables):
    rows = run(spark, "op8_language", tables)
    texts_ = {}
    for i, t, _ in rows_of_documents():
        texts_.setdefault(i, []).append(t)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in rows_of_documents())
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
        if len(texts_[r["doc_id"]]) == 1:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", texts_[r["doc_id"]][0] or ""))


def test_components(spark, tables):
    rows = run(spark, "op9_jaccard", tables)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in rows_of_documents())
    docs = [(i, t) for i, t, _ in rows_of_documents() if i is not None]
    want = brute_components(list(enumerate(t for _, t in docs)))  # by place, as two rows share an id
    least = {}
    for k, (_, root) in want.items():
        least[root] = min(least.get(root, docs[k][0]), docs[k][0])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None) == Counter((docs[k][0], n, least[root]) for k, (n, root) in want.items())


def test_quality_rows(spark, tables):
    rows = run(spark, "op10_quality", tables)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in rows_of_documents())
    for r in rows:
        if r["perplexity"] is None:
            assert not r["keep"]
        else:
            assert r["perplexity"] >= 1 and r["keep"] == (r["perplexity"] <= r["threshold"])


def test_fill_in_middle(spark, tables):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in run(spark, "op11_fill_in_middle", tables))
    want = Counter()
    for i, t, _ in rows_of_documents():
        n, form, prefix, middle, output = brute_middle(i, t)
        want[i, n, form, prefix, middle, sha(output), sha(t or "")] += 1
    assert got == want


def test_mixing(spark, tables):
    rows = run(spark, "op12_mixing", tables)
    sizes = Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows_of_documents())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes
    total = sum(n * k for (_, n), k in sizes.items())
    want = brute_targets({"src": total})["src"]
    assert all(r["source_size"] == total and abs(r["target"] - want) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - want) <= 1.5 * 128
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, "op12_mixing", tables)))


def test_hard_negatives(spark, tables):
    moved = [(i, (k + 1) % 10 if i is not None and i % 7 == 0 and k is not None else k, v) for i, k, v in made()]
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in run(spark, "op13_hard_negatives", tables)]
    assert sorted(got, key=str) == brute_negatives(moved) and got
