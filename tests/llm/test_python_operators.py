import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import html_extract as H
from sieveworks.llm import langid as L
from sieveworks.llm import license_scan as C
from sieveworks.llm import media as M
from sieveworks.llm import packing as P
from sieveworks.llm import quality as Q

from .fixtures import documents, empty, texts, words

HOW = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_library(tokenizer):
    encoder = P.byte_bpe(**{"ranks_path": HOW["ranks_path"], "pattern": HOW["pattern"]})
    for t in [*texts(5), "<|endoftext|> a", "日本語‍🙂\r\n\t  x'll 12345", "\x00\x7f"]:
        assert list(encoder.encode_to_numpy(t or "")) == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_added_tokens_get_their_id(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {t.content: i for i, t in plain.get_added_tokens_decoder().items()} == {P.ADDED: P.ADDED_ID}
    cases = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  <|endoftext|>\n", "a<|endoftext|", "<<|endoftext|>> 1"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist() for r in P.pack_documents(docs, **HOW).collect()}
    assert got == {i: plain.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(cases)}


def test_packing_is_a_round_trip(spark, tokenizer):
    docs = documents(spark)
    rows = P.pack_documents(docs, **HOW, window=64).collect()
    want = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect())
    by_sequence, by_doc = {}, {}
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u4")
        assert len(ids) == r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(ids)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for (doc, total), pieces in by_doc.items():
        full = {ids for (d, ids), n in want.items() if d == doc and len(ids) == total}
        copies = Counter(pieces)
        assert len(full) == 1
        n = set(copies.values())
        joined = tuple(x for _, ids in sorted(copies) for x in ids)
        assert joined == full.pop() and len(n) == 1
    tokens = sum(r["length"] for r in rows)
    assert tokens / (64 * len(by_sequence)) > 0.85


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fit = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if not fit:
            room.append(100)
            fit = [(100, len(room) - 1)]
        r, w = min(fit)
        want[i] = 100 - r
        room[w] -= lengths[i]
    got = P.best_fit_decreasing(lengths, 100)
    assert [o for _, o in got] == [want[i] for i in range(300)]
    assert 1 + max(w for w, _ in got) == len(room)


def test_packing_nothing(spark):
    assert P.pack_documents(empty(spark), **HOW).collect() == []
    assert P.best_fit_decreasing([], 8) == []


def test_language_accuracy_and_rejection(spark):
    rng = random.Random(1)
    own = {"en": "the of and ing tion er th".split(), "de": "der sch ein ung lich keit ü".split(), "fr": "que é eau le ment ai oi".split()}
    rows = [(i, " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(["en", "de", "fr"] * 150)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, "the of and", None), (None, "the of and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn_from_documents(docs, per_lang=60)
    got = L.identify(docs, model).withColumn("held_out", L.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = bool(re.search(r"[^\W\d_]", r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(r["rejected"] for r in got if r["lang_pred"] == "und")
    assert sum(r["rejected"] for r in got if r["lang_pred"] != "und") <= 0.03 * len(got)
    strange = lambda: " ".join("".join(rng.choice("bcdfgjkmpqwxz") for _ in range(6)) for _ in range(40))
    rows = [(i, strange()) for i in range(20)] + [(50, "Съешь же ещё этих мягких французских булок да выпей чаю " * 4), (51, "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura " * 4)]
    assert all(r["rejected"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert {r["doc_id"] for r in L.keep_identified(docs, model).collect()} == {r["doc_id"] for r in got if not r["rejected"]}


def test_language_without_labels(spark):
    docs = documents(spark)
    model = L.learn_from_documents(docs.where("lang = 'none'"))
    assert {r["lang_pred"] for r in L.identify(docs, model).collect()} == {"und"}
    assert L.identify(empty(spark), model).collect() == []


def test_language_prediction_equals_brute_force(spark):
    """The cosine of every text with every centroid, from dictionaries of trigrams."""
    docs = documents(spark)
    model = L.learn_from_documents(docs, per_lang=20)
    assert L.fit(docs, "text", "lang", F.col("doc_id"), per_lang=3).centroids.shape[1] <= 9
    for r in L.identify(docs, model).collect():
        raw = (r["text"] or "").encode()
        symbols = [0, *[int(L.SYMBOL[b]) for b in raw], 0]
        seen = Counter()
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            if b:
                code = ((a * 2654435761 + b * 2246822519 + c * 3266489917) % 2**32) >> 7
                seen[(code ^ (code >> 11)) % model.dim] += 1
        norm = sum(n * n * float(model.idf2[k]) for k, n in seen.items()) ** 0.5
        cosine = [sum(n * float(model.centroids[k, j]) for k, n in seen.items()) / norm for j in range(model.centroids.shape[1])] if norm else []
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        assert abs(r["score"] - max(cosine)) < 1e-4
        near = {model.langs[model.owner[j]] for j, x in enumerate(cosine) if x > max(cosine) - 1e-4}
        assert r["lang_pred"] in near


def test_language_counts_equal_brute_force():
    data = "Ab cé, x".encode()
    m = L.counts(np.frombuffer(data + b"zz", np.uint8), np.array([0, len(data), len(data) + 2]), 1 << 20)
    assert m.sum(axis=1).tolist() == [2 + 3 + 1, 2]  # one trigram for each letter byte


def page(article, around=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav><!-- ad --><div class=ad>buy</div>{around}{article}<div id='comments'><p>a reader says</p></div><footer>foot</footer></body></html>"


def test_main_text(spark):
    art = "<article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>Four</p><form><input>ask</form><aside>side</aside><p>Fi<i>v</i>e</p></article>"
    cut = "<div class='body 7'><p>A long enough text in a container.</p><p>And more</p></div>"
    rows = [(1, "http://a.com/1", page(art)), (2, "http://b.com/1", page(cut)), (3, "http://b.com/2", page(cut.replace("body 7", "body 8"), "<div class=teaser><p>short</p></div>")), (4, None, None), (5, "http://a.com/2", ""), (6, "http://a.com/3", "<p>no article here"), (7, "http://a.com/4", page(art)[: page(art).index("</article>") + 6]), (1, "http://a.com/1", page(art))]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and "html" not in got[0].asDict()
    assert by[1] == "Head & more\nOne two three\nFour\nFive" == by[7]
    assert by[2] == by[3] == "A long enough text in a container.\nAnd more"
    assert by[4] == by[5] == "" and by[6] == "no article here"


def test_main_text_of_the_test_pages(spark):
    """The pages' articles, read by a plainer path: from the article's start tag to its end."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_wrappers_with_telling_names_keep_their_article(spark):
    """Names that only say that a part is there, and wrappers of the bulk of a page, drop nothing; the parts themselves go."""
    body = "<p>A first paragraph of the article, long enough.</p><p>And a second one of it, long as well.</p>"
    want = "A first paragraph of the article, long enough.\nAnd a second one of it, long as well."
    around = '<div class="sidebar"><p>side</p></div><div class="comment-list"><article class="comment">a reader</article></div><ul class=menu><li>m</ul><p class="cookie-notice">cookies</p>'
    rows = [(i, f"http://h{i % 6}.com/{i}", f'<body><div class="{c}"><div class="body">{body}</div>{around}</div></body>') for i, c in enumerate(["layout has-sidebar", "no-comments", "with-header page", "content-share-enabled", "sidebar", "wrap"] * 2)]
    rows += [(20, "http://a.org/1", f"<body><div class=content><div class=intro><p>Twenty percent.</p></div><div class=text>{body}</div><div class=outro>End.</div></div><div class=promo>Buy!</div></body>")]
    rows += [(21, "http://a.org/2", "<body><table><tr><td>Another layout <math><mi>x</mi></math> of the same host, longer than the rest of it.</td></tr></table></body>")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(12)} == {want}
    assert got[20] == "Twenty percent.\n" + want + "\nEnd."
    assert got[21] == "Another layout x of the same host, longer than the rest of it."


def test_main_text_of_deep_and_long_pages(spark):
    import time

    deep = "<div class=x>" * 30_000 + "<p>deep text</p>" + "</div>" * 30_000
    long = "<body>" + "<div class=row><b><p>some text in a row</b></div></span>" * 50_000 + "</body>"
    began = time.time()
    assert H.Page(deep).text(None) == "deep text"
    assert H.Page(long).text(None).count("\n") == 49_999
    assert time.time() - began < 20


def test_main_text_of_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def test_license_base_equals_brute_force(spark):
    docs = documents(spark)
    for r in C.scan_licenses(docs.withColumn("score", docs["doc_id"]).withColumn("raw", docs["text"])).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["raw"] or ""))
        at = [(i, label) for p, label in C.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r["n_words"] == len(w) and r["n_base"] == len(at)
        assert r["first_word"] == min((i for i, _ in at), default=None) and r["last_word"] == max((i for i, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_templates_are_found_with_gaps(spark):
    text = C.TEMPLATES["mit"].split()
    edited = "Intro. " + " ".join(text[:30]) + " EDITED WORDS " + " ".join(text[31:70]) + " outro " + " ".join(["noise"] * 50)
    docs = spark.createDataFrame([(1, edited), (2, C.TEMPLATES["apache-2"]), (3, "use of the software and the program is free"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.scan_licenses(docs).collect()}
    assert got[1]["labels"] == "mit" and 0.5 < got[1]["score"] < 1
    assert (got[1]["spans"][0]["start"], got[1]["spans"][0]["stop"]) == (1, 73)
    assert got[2]["labels"] == "apache-2" and got[3]["labels"] == "" and got[4]["n_words"] == 0
    assert C.scan_licenses(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_brute_force(seed):
    rng = random.Random(seed)
    templates = [[rng.randrange(4) for _ in range(rng.randint(5, 30))] for _ in range(3)]
    auto = C.SuffixAutomaton()
    for k, t in enumerate(templates):
        auto.add(t, k)
    auto.finish(3)
    model = C.LicenseModel({}, auto, ["a", "b", "c"], [len(t) for t in templates], [], 3)
    text = [rng.randrange(4) for _ in range(60)]
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    longest = [max((n for n in range(1, i + 2) if any(inside(text[i + 1 - n : i + 1], t) for t in templates)), default=0) for i in range(60)]
    want = {(i + 1 - n, n) for i, n in enumerate(longest) if n >= 3 and (i == 59 or longest[i + 1] != n + 1)}
    got = model.anchors(text, 0)
    assert {(at, n) for _, _, at, n in got} == want
    for t, pos, at, n in got:
        assert templates[t][pos : pos + n] == text[at : at + n]
    places = lambda s, t: [i for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
    assert sorted(got) == sorted((t, pos, at, n) for at, n in want for t in range(3) for pos in places(text[at : at + n], templates[t]))
    # the best chain of all anchors of a template, by the plain recurrence over matched words
    for t in range(3):
        pairs = {(at + i, pos + i) for k, pos, at, n in got if k == t for i in range(n)}
        best = [[0] * 31 for _ in range(61)]
        for i in range(60):
            for j in range(30):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + 1 if (i, j) in pairs else 0)
        own = [(at, pos, n) for k, pos, at, n in got if k == t]
        if own:
            first, last, length = C.longest_chain(own)
            assert length == best[60][30] and text[first] in templates[t] and length <= last - first + 1


def test_license_with_many_anchors_and_repeated_runs(spark):
    """A run that the template has twice, repeated inner runs, and a text of many anchors."""
    words_ = C.TEMPLATES["bsd"].split()
    inner = "the above copyright notice this list of conditions and the following disclaimer".split()
    at = next(i for i in range(len(words_)) if words_[i] == "disclaimer.")
    whole = len(C.words_of(C.TEMPLATES["bsd"].encode()))
    inserted = list(words_)
    for k in (60, 45, 30, 15):
        inserted.insert(k, "zzz")
    cover = {}
    docs = spark.createDataFrame([(0, " ".join(inserted)), (1, " ".join(words_[: at + 1] + inner + words_[at + 1 :])), (70, " ".join(words_[: at + 1] + inner * 70 + words_[at + 1 :])), (2, (C.TEMPLATES["mit"] + " ") * 3000)], "doc_id long, text string")
    for r in C.scan_licenses(docs).collect():
        cover[r["doc_id"]] = max(s["cover"] for s in r["spans"])
        assert r["labels"] == ("mit" if r["doc_id"] == 2 else "bsd")
    assert cover[0] == cover[1] == cover[70] == cover[2] == 1.0 and whole == 68


def test_media_round_trip(spark, tmp_path):
    docs = documents(spark)
    folder = str(tmp_path / "media")
    assert M.write_archives(docs, folder, members=7) == docs.count()
    got = M.read_archives(spark, folder, rangeBytes=400, batchBytes=1000).collect()
    want = sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["payload"])[: r["n_bytes"]]) for r in got) == want
    by_text = {}
    for r in got:
        raw = bytes(r["payload"])[: r["n_bytes"]]
        assert bytes(r["payload"]) == M.pad(raw) and len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0
        by_text.setdefault(raw, set()).add((hashlib.sha256(r["media"]).hexdigest(), r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())


def test_media_members_are_retried_alone(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0.png", M.encode_png(M.pad(b"hello")))
    info = zipfile.ZipFile(path).infolist()[0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return open(path, "rb")

    reader = M.MediaArchiveReader({"path": str(tmp_path)})
    assert reader.member(flaky, info)[1] == M.pad(b"hello") and len(tries) == 3
    damaged = bytearray(path.read_bytes())
    damaged[info.header_offset + 60] ^= 1
    path.write_bytes(bytes(damaged))
    reader.retries = 0
    with pytest.raises(ValueError):
        reader.member(lambda: open(path, "rb"), info)


def test_media_with_string_ids_ignores_archives_of_lost_attempts(spark, tmp_path):
    folder = tmp_path / "media"
    assert M.write_archives(spark.createDataFrame([("a", "x"), (None, "y" * 300_000)], "name string, text string"), str(folder), id_col="name") == 2
    lost = next(folder.glob("part-*.zip"))
    (folder / "part-000000-000000-lost.zip").write_bytes(lost.read_bytes())
    got = {r["doc_id"]: bytes(r["payload"])[: r["n_bytes"]] for r in M.read_archives(spark, str(folder), idType="string").collect()}
    assert got == {"a": b"x", None: b"y" * 300_000}
    with pytest.raises(Exception, match="(?i)scheme|protocol|unrecognized"):
        M.write_archives(empty(spark), "wasbs://x/y")


def test_media_of_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert M.write_archives(empty(spark), folder) == 0
    assert M.read_archives(spark, folder).collect() == []


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    counts = np.zeros(Q.CELLS, np.int64)
    at = rng.integers(0, Q.CELLS, 3000)
    np.add.at(counts, at, rng.integers(1, 9, 3000))
    p = np.exp(Q.kneser_ney(counts)).reshape(-1, Q.K)
    assert np.allclose(p.sum(axis=1), 1)
    assert p.reshape(-1)[at].mean() > 5 / Q.K


def test_codes_equal_brute_force():
    raw = ["Ab 1é", "", "zz"]
    data = "".join(raw).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in raw]])
    got = Q.codes(np.frombuffer(data, np.uint8), offsets)
    want = []
    for row, t in enumerate(raw):
        s = [0, 0, 0, *[int(Q.SYMBOL[b]) for b in t.encode()]]
        want += [(((s[i] * 32 + s[i + 1]) * 32 + s[i + 2]) * 32 + s[i + 3], row) for i in range(len(s) - 3)]
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_perplexity_equals_brute_force(spark, monkeypatch):
    """The model of word pairs from dictionaries, over all trusted texts; a small vocabulary, blocks, shards and pieces."""
    docs = documents(spark)
    texts_ = [r["text"] for r in docs.where("doc_id % 3 = 0").collect()]
    trusted = docs.where("doc_id % 3 = 0").select("text")
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[^\s]", t or "", re.A)]  # noqa: E731  no ideographs here
    model, pairs = Q.learn(trusted)
    shared = Counter(w for t in texts_ for w in split(t))
    ids = lambda t: [1, *[int(x) for x in Q.Words(model.vocabulary).ids(np.array([hash_of(w) for w in split(t)], np.uint64))]]

    def hash_of(w):
        raw = w.encode()
        return int(Q.split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3][0])

    assert len(model.vocabulary) == len(shared)
    n = Counter((v, w) for t in texts_ for v, w in zip(ids(t), ids(t)[1:], strict=False))
    assert {(r["code"] >> Q.BITS, r["code"] % Q.VOCABULARY): r["n"] for r in pairs.collect()} == dict(n)
    of = lambda counts: [0.0, *Q._discounts([sum(x == i for x in counts.values()) for i in (1, 2, 3, 4)])]
    cont, d = Counter(w for _, w in n), of(n)
    e, known = of(cont), 2 + len(shared)
    held = sum(e[min(x, 3)] for x in cont.values())
    p1 = lambda w: (cont[w] - e[min(cont[w], 3)] + held / known) / sum(cont.values())
    c1, owed = Counter(), Counter()
    for (v, _), x in n.items():
        c1[v] += x
        owed[v] += d[min(x, 3)]
    p2 = lambda v, w: (max(n[v, w] - d[min(n[v, w], 3)], 0) + owed[v] * p1(w)) / c1[v] if c1[v] else p1(w)
    assert abs(sum(p2(1, w) for w in range(2, known)) + p2(1, 0) + p2(1, 1) - 1) < 1e-9
    spell = lambda w: float(model.spell[Q.codes(np.frombuffer(w.encode() + b" ", np.uint8), np.array([0, len(w.encode()) + 1]))[0]].sum())
    for small in (False, True):
        if small:
            monkeypatch.setattr(Q, "BLOCK_BYTES", 3000)
            monkeypatch.setattr(Q, "SALT_DOCUMENTS", 40)
            monkeypatch.setattr(Q, "SHARDS_LEAST", 5)
        got = Q.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), trusted, ["doc_id"]).collect()
        by = {(r["doc_id"], r["size"], r["words"]): r["log"] for r in got}
        assert len(got) == docs.count()
        for r in docs.collect():
            w, t = ids(r["text"]), split(r["text"])
            log = sum(math.log(p2(v, x)) for v, x in zip(w, w[1:], strict=False)) + sum(spell(x) for x, i in zip(t, w[1:], strict=True) if i == 0)
            assert abs(by[r["doc_id"], sum(len(x.encode()) for x in t), len(t)] - log) < 1e-3 * (1 + abs(log))


def test_pieces_of_long_texts_add_up(spark):
    raw = [("ab cd " * 2000 + "x" * 5000 + " ef gh").encode(), b"", b" " * 9000 + b"ij kl", b"mn"]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = Q.Words(np.array([], np.uint64))
    one, many = (list(whole.of(data, offsets, most)) for most in (1 << 30, 100))
    join = lambda parts, i: np.concatenate([p[i] for p in parts]).tolist()
    assert len(many) > 50 and all(join(one, i) == join(many, i) for i in (0, 1, 2, 4))


def test_small_numbers_are_packed():
    x = np.array([0, 254, 255, 256, 70_000, 3])
    assert Q.unpacked(*Q.packed(x)).tolist() == x.tolist()


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(2)
    noise = lambda: "".join(rng.choice("qxzjkvwpbfgyumc#$%0 ") for _ in range(300))
    rows = [(i, " ".join(words(rng, rng.randint(10, 80))), ["en", "de", None][i % 3]) for i in range(300)] + [(1000 + i, noise(), "en") for i in range(20)] + [(2000, None, "en"), (2001, "", "de"), (2002, "12 34", "xx"), (None, "the sch", "en"), (0, rows_text := "ing tion er", "en")]
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(0, 1, 0), (1001, 0, 0), (None, 1, None), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), slack=1.1).collect()
    assert len(got) == len(rows)
    assert sum(r["keep"] for r in got if r["doc_id"] is not None and 0 < r["doc_id"] < 300) >= 290
    assert not any(r["keep"] for r in got if r["doc_id"] and r["doc_id"] >= 1000)
    none = Q.classify(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert none == []


def test_words_of_all_scripts_are_split_and_hashed_alike():
    raw = ["Ab, the 12.5 ab", "", "日本語 кот КОТ x日y", "ab"]
    data = "".join(raw).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in raw]])
    spaced, at, rows, hashes = Q.split_words(np.frombuffer(data, np.uint8), offsets)
    got = [(int(r), bytes(spaced[i : j - 1]).decode()) for r, i, j in zip(rows, at[:-1], at[1:], strict=True)]
    assert got == [(0, t) for t in ["ab", ",", "the", "12", ".", "5", "ab"]] + [(2, t) for t in ["日", "本", "語", "кот", "КОТ", "x", "日", "y"]] + [(3, "ab")]
    by_word = {w: h for (_, w), h in zip(got, hashes, strict=True)}
    assert [by_word[w] for _, w in got] == list(hashes) and len(set(by_word.values())) == len(by_word)


def test_quality_tells_cyrillic_prose_from_shuffled_letters(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(60)]
    prose = lambda: " ".join(rng.choice(lexicon) for _ in range(60))
    mixed = lambda: " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(60))
    rows = [(i, prose(), "ru") for i in range(120)] + [(1000 + i, mixed(), "ru") for i in range(20)]
    got = Q.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()
    assert sum(r["keep"] for r in got if r["doc_id"] < 1000) >= 115
    assert not any(r["keep"] for r in got if r["doc_id"] >= 1000)


def brute_labels(model, spans):
    """Spans that lose to none, by trying all pairs."""
    rank = {s: (model.sizes[s[0]] + (s[2] - s[1]) - 2 * s[3], -s[3]) for s in spans}
    half = lambda a, b: 2 * len(set(range(a[1], a[2])) & set(range(b[1], b[2]))) >= min(a[2] - a[1], b[2] - b[1])
    kept = []
    for s in sorted(spans, key=lambda s: (rank[s], s)):
        if not any(rank[k] < rank[s] and half(k, s) for k in kept):
            kept.append(s)
    return kept


def test_every_template_is_labelled_as_itself_and_neighbours_are_not():
    model = C.LicenseModel.build(C.TEMPLATES, C.BASE_PHRASES)
    assert len(C.TEMPLATES) >= 30
    for label, text in C.TEMPLATES.items():
        got = model.scan(f"Copyright 2020 A. Author. {text} And prose of some other words behind it.".encode())
        assert got["labels"] == label, (label, got["labels"])
    two = C.TEMPLATES["agpl-3"] + " here is some more " + "filler " * 60 + C.TEMPLATES["cc-by-sa"]
    assert model.scan(two.encode())["labels"] == "agpl-3,cc-by-sa"


def test_choice_between_templates_equals_brute_force():
    rng = random.Random(4)
    model = C.LicenseModel.build(C.TEMPLATES, C.BASE_PHRASES)
    names = list(C.TEMPLATES)
    for _ in range(60):
        words = []
        for name in rng.sample(names, 3):
            own = C.TEMPLATES[name].split()
            at = rng.randrange(len(own))
            words += [w for w in own if rng.random() > 0.05] + own[at : at + 9] + ["gap"] * rng.choice([0, 3, 50])
        known = [model.vocabulary.get(w.decode(), model.vocabulary.get(w, -1)) for w in C.words_of(" ".join(words).encode())]
        spans, anchors, start = [], [], 0
        for i, w in enumerate([*known, -1]):
            if w < 0:
                anchors += model.anchors(known[start:i], start) if i - start >= 5 else []
                start = i + 1
        spans = [s for s in model.chains(anchors) if s[3] / model.sizes[s[0]] >= 0.5]
        want = ",".join(sorted({model.labels[s[0]] for s in brute_labels(model, spans)}))
        got = model.scan(" ".join(words).encode())
        assert got["labels"] == ",".join(sorted(set(filter(None, [*want.split(","), *got["base_labels"].split(",")]))))


def test_what_only_one_page_has_beside_the_usual_place_is_kept(spark):
    text = lambda k, n: " ".join(f"word{k}x{i}" for i in range(n))
    pages = [(i, f"http://h.org/{i}", f"<body><div class=a><p>{text(i, 60)}</p></div></body>") for i in range(40)]
    pages.append((40, "http://h.org/40", f"<body><div class=a><p>{text(40, 60)}</p></div><div class=b><p>{text(41, 45)}</p></div></body>"))
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[40] == text(40, 60) + "\n" + text(41, 45) and got[3] == text(3, 60)
