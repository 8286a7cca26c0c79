import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.llm import decontam as D
from sieveworks.llm import secret_scan as S
from sieveworks.llm import url_filter as U

from .fixtures import BENCH, benchmark, documents, empty

BENCH_TEXT = BENCH[0][1]

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]


def base_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n)


def test_base_secrets_equal_brute_force(spark):
    rows = S.find_secrets(documents(spark)).collect()
    assert any(len(base_spans(r["text"])) > 1 for r in rows)
    for r in rows:
        assert [tuple(s) for s in r["secrets"] if s["rank"] < 3] == base_spans(r["text"])


def test_random_tokens_are_found_and_words_are_not(spark):
    secret = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(60)]
    plain = [f"report-of-the-year-{i}-{i}-{i}" for i in range(60)] + ["aaaaaaaaaaaaaaaaaaaaaaaa1"] * 20
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    got = {r["doc_id"]: any(s["kind"] == "random" for s in r["secrets"]) for r in S.find_secrets(docs).collect()}
    assert sum(got[i] for i in range(60)) >= 45
    assert sum(got[i] for i in range(60, 140)) <= 8


def token_p(token):
    """The battery again, in plain Python: (p, class)."""
    symbols = next(x for _, pattern, x in S.ALPHABETS if re.match(pattern, token))
    x = [symbols.index(c) for c in token.rstrip("=")]
    n, k, sf = len(x), len(symbols), lambda z: 1 - 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))
    chi = sum(v * v for v in Counter(x).values()) * k / n - n
    z_chi = ((max(chi, 0.0001) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = sum(2 * e >= k for e in x)
    runs = 1 + sum((2 * a >= k) != (2 * b >= k) for a, b in zip(x, x[1:]))
    m = 2 * high * (n - high)
    z_runs = 9.0 if high in (0, n) else abs(runs - (m / n + 1)) / math.sqrt(max(m * (m - n) / (n * n * (n - 1)), 0.01))
    mean = sum(x) / n
    power = sum((e - mean) ** 2 for e in x)
    z_serial = 9.0 if power == 0 else abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / power + 1 / n) * math.sqrt(n)
    length = max(i for i, low in enumerate(S.LENGTHS) if len(token) >= low)
    return min(1.0, 3 * min(sf(max(z_chi, -6.0)), 2 * sf(z_runs), 2 * sf(z_serial))), length + (0 if re.search("[0-9]", token) else len(S.LENGTHS))


KINDS = {"BASE36-40": (string.digits + string.ascii_uppercase, 40), "BASE36-64": (string.digits + string.ascii_uppercase, 64), "letters-32": (string.ascii_letters, 32), "base62-40": (string.ascii_letters + string.digits, 40), "base64-40": (string.ascii_letters + string.digits + "+/", 40), "base36-40": (string.digits + string.ascii_lowercase, 40)}


def test_secrets_of_all_kinds_are_found_and_thresholds_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(kind, "".join(rng.choice(symbols) for _ in range(n))) for kind, (symbols, n) in KINDS.items() for _ in range(200)]
    rows += [("plain", "".join(rng.choice(["the", "report", "final", "version", "of", "year"]) + rng.choice(["-", "_"]) for _ in range(6)) + str(i)) for i in range(300)]
    docs = spark.createDataFrame([(k, f"see {t} there") for k, t in rows], "kind string, text string").repartition(4)
    got = S.find_secrets(docs).collect()
    found = Counter((r["kind"]) for r in got if any(s["kind"] == "random" and s["start"] == 4 and s["stop"] == len(r["text"]) - 6 for s in r["secrets"]))
    assert all(found[kind] >= 190 for kind in KINDS), found
    counts = [[0.0] * S.BINS for _ in range(2 * len(S.LENGTHS))]
    for token in {t for _, text in rows for t in re.findall(S.TOKEN, text) if re.search("[A-Za-z]", t)}:
        p, c = token_p(token)
        counts[c][min(S.BINS - 1, int(p * S.BINS))] += 1
    least = S.thresholds_of(counts, 0.05)
    assert S.thresholds(docs) == least
    for r in got:
        want = {m.span() for m in re.finditer(S.TOKEN, r["text"]) if re.search("[A-Za-z]", m[0]) and token_p(m[0])[0] >= least[token_p(m[0])[1]]}
        assert {(s["start"], s["stop"]) for s in r["secrets"] if s["kind"] == "random"} == want


def test_one_token_more_moves_thresholds_little():
    """One function on both sides of any count."""
    for upper in (0, 5, 30):
        last = None
        for n in range(0, 80):
            counts = [[0.0] * S.BINS for _ in range(2 * len(S.LENGTHS))]
            counts[3][0], counts[3][40] = float(n), float(upper)
            now = S.thresholds_of(counts, 0.05)[3]
            assert last is None or abs(now - last) <= 0.021
            last = now


def test_copies_of_a_secret_do_not_raise_its_threshold(spark):
    secret = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(60)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(secret)], "doc_id long, text string")
    least = S.thresholds(docs)
    p = docs.selectExpr("doc_id", "text", "array(substring(text, 5, 40)) AS __tokens").selectExpr("text", f"{S.P_OF}[0] AS p").where("p BETWEEN 0.1 AND 0.4").orderBy("text").limit(1)
    copies = p.selectExpr("-1L AS doc_id", "explode(array_repeat(text, 3000)) AS text")
    assert S.thresholds(docs.unionByName(copies)) == least
    assert S.thresholds(copies)[S.LENGTHS.index(40)] <= 0.1


def test_values_behind_names_and_paths_are_scored_alone(spark):
    key = "wJalrXUtnFEMI/K7MDENG1bPxRfiCYq8Zs3T0vLd"
    bare = key.replace("/", "")
    cases = {f"AWS_ACCESS={key} x": key, f"http://h/p?sig={bare}&a=1": bare, f"my_dir/data-{bare}": bare, f"X={bare}== y": bare + "==", f"{bare}=z": bare, f"a {key} b": key}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["text"]: r["t"] for r in docs.selectExpr("text", "regexp_extract_all(text, r'" + S.TOKEN + "', 0) AS t").collect()}
    assert got == {text: [want] for text, want in cases.items()}
    found = S.find_secrets(docs, rate=0.0).collect()
    assert all((s := [x for x in r["secrets"] if x["kind"] == "random"]) and r["text"][s[0]["start"] : s[0]["stop"]] == cases[r["text"]] for r in found)


def test_redaction_cuts_spans_and_nothing_else(spark):
    docs = documents(spark)
    rows = {r["doc_id"]: r for r in S.find_secrets(docs).collect()}
    for r in S.redact(docs).collect():
        text, spans = rows[r["doc_id"]]["text"], [(s["start"], s["stop"]) for s in rows[r["doc_id"]]["secrets"]]
        if not spans:
            assert r["text"] == text
            continue
        covered = set().union(*[range(a, b) for a, b in spans])
        want, at = "", 0
        while at < len(text):
            if at in covered:
                end = at
                while True:
                    more = max((b for a, b in spans if a <= end), default=end)
                    if more == end:
                        break
                    end = more
                want, at = want + "[secret]", end
            else:
                want, at = want + text[at], at + 1
        assert r["text"] == want


def test_a_text_of_many_secrets_takes_linear_time(spark):
    import time

    tokens = [hashlib.sha256(str(i).encode()).hexdigest()[:24] for i in range(20_000)]
    docs = spark.createDataFrame([(1, "é " + " ".join(f"token={t} {t}" for t in tokens)), (2, "")], "doc_id long, text string").withColumn("SECRETS", F.lit(1)).withColumn("__m0", F.lit("x"))
    began = time.time()
    got = {r["doc_id"]: r["secrets"] for r in S.find_secrets(docs).collect()}
    assert [tuple(s) for s in got[1] if s["rank"] < 3] == base_spans("é " + " ".join(f"token={t} {t}" for t in tokens)) and got[2] == []
    masked = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    assert masked[1] == "é " + " ".join(["[secret] [secret]"] * 20_000) and masked[2] == ""
    assert time.time() - began < 90


def test_secrets_on_an_empty_table(spark):
    assert S.find_secrets(empty(spark)).collect() == []


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    w, hit, found = word_list(text), set(), set()
    for item, t in items:
        b = word_list(t)
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    docs, bench = documents(spark), benchmark(spark)
    items = [tuple(r) for r in bench.collect()]
    want = sorted((str(r["doc_id"]), *brute_contamination(r["text"], items)) for r in docs.collect())
    for most_bytes in (D.MOST_BYTES, 0):  # by a broadcast, and by a bitmap and a shuffle
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in D.find_contamination(docs, bench, most_bytes=most_bytes).collect())
        assert got == want
    assert sum(w[2] > 0 for w in want) >= 4
    assert D.remove_contaminated(docs, bench).count() == sum(w[2] == 0 for w in want)


def test_contamination_of_one_id_with_unlike_texts_and_of_long_texts(spark):
    item = BENCH_TEXT.split()
    long = " ".join((item + ["filler"]) * 10_000)
    docs = spark.createDataFrame([(1, BENCH_TEXT), (1, "clean"), (1, BENCH_TEXT), (None, BENCH_TEXT), (2, long)], "doc_id long, text string").withColumn("items", F.lit(9)).withColumn("AT", F.lit(1))
    rows = D.find_contamination(docs, benchmark(spark).withColumn("size", F.lit("x"))).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]][:2]) for r in rows) == sorted([("1", 12, 12, [(0, 12)]), ("1", 1, 0, []), ("1", 12, 12, [(0, 12)]), ("None", 12, 12, [(0, 12)]), ("2", 130_000, 120_000, [(0, 12), (13, 25)])])
    assert [(r["doc_id"], r["text"], r["items"]) for r in D.remove_contaminated(docs, benchmark(spark)).collect()] == [(1, "clean", 9)]


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. ALPHA beta gamma delta epsilon zeta eta theta iota kappa; and that"), (2, "clean text"), (3, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in D.remove_spans(docs, benchmark(spark)).collect()}
    assert got == {1: "Keep this. ; and that", 2: "clean text", 3: None}


def test_empty_benchmark_and_table(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = D.find_contamination(documents(spark), none).collect()
    assert {r["n_hit"] for r in found} == {0} and len(found) == documents(spark).count()
    assert D.find_contamination(empty(spark), benchmark(spark)).collect() == []
    assert D.remove_contaminated(empty(spark), benchmark(spark)).collect() == []


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def brute_rule(host, path):
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


URLS = ["http://a.example.com/en/x", "https://WWW.Example.com/en/1?q", "http://example.com", "http://b.net/es/", "http://b.net/de/", "http://c.net/fr/1#x", "http://com/", "xcom/", None, "", "http://notexample.com/en/", "x://y://z/", "http://spam.org/a", "http://spam.org/b", "http://good.org/a", "http://h:80/en/", "http:///p"]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, html string")
    rows = U.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = brute_url(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["verdict"] in ("allow", "block") if rule is None else r["verdict"] == rule.verdict


def solved(edges, seeds, damping=0.85):
    """Personalised PageRank by a direct solve; mass that leaves the graph goes back to the seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for s in hosts:
        out = [d for x, d in edges if x == s]
        for d in out:
            move[at[d], at[s]] += 1 / len(out)
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    mass = np.linalg.solve(np.eye(len(hosts)) - damping * move, (1 - damping) * seed)
    return dict(zip(hosts, mass / mass.sum() * seed.sum(), strict=True)) if seed.any() else {}


def test_propagation_equals_a_direct_solve_on_graphs_with_cycles(spark):
    rng, edges, seeds = random.Random(2), set(), []
    for g in range(6):
        names = [f"g{g}-{i}" for i in range(rng.randint(3, 15))]
        edges |= {tuple(rng.sample(names, 2)) for _ in range(rng.randint(3, 40))}
        seeds += [(rng.choice(names), kind, rng.choice([0.25, 1.0])) for kind in ("trust", "distrust")]
    edges |= {("a", "b"), ("b", "c"), ("c", "a"), ("lone", "a")}
    seeds += [("a", "trust", 1.0)]
    got = {(r["kind"], r["host"]): r["mass"] for r in U.propagate(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(seeds, "host string, kind string, mass double")).collect()}
    for kind, ways in (("trust", edges), ("distrust", {(d, s) for s, d in edges})):
        want = solved(sorted(ways), {h: m for h, k, m in seeds if k == kind})
        assert all(abs(got.get((kind, h), 0.0) - m) < 2e-5 for h, m in want.items())


@pytest.mark.parametrize("share", [8 << 20, -1])
def test_a_plan_has_one_join_a_round_and_few_ways_are_not_dealt_out(spark, monkeypatch, share):
    plans, save = [], U.saved

    def seen(df, name):
        if name == "host-mass":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(U, "saved", seen)
    monkeypatch.setattr(U, "SHARE_BYTES", share, raising=False)
    edges, seeds = [("a", "b"), ("b", "a"), ("b", "c"), ("d", "b"), ("a", "d"), ("c", "end")], [("a", "trust", 1.0), ("c", "distrust", 0.5), ("lone", "distrust", 1.0)]
    got = {(r["kind"], r["host"]): r["mass"] for r in U.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, kind string, mass double")).collect()}
    assert max(p.count("Join") for p in plans) == 4  # a cut's rounds; 15 where each names the masses before it twice
    assert any("Exchange" in p for p in plans) == (share < 0)
    for kind, ways in (("trust", edges), ("distrust", [(d, s) for s, d in edges])):
        want = solved(ways, {h: m for h, k, m in seeds if k == kind})
        assert {h for k, h in got if k == kind} <= set(want)
        assert all(abs(got.get((kind, h), 0.0) - m) < 2e-5 for h, m in want.items())


def test_neighbours_under_a_public_suffix_are_not_blocked(spark):
    pages = [(1, "http://evil.co.uk/x", ""), (2, "http://bank.co.uk/", ""), (3, "http://www.bank.co.uk/", ""), (4, "http://shop.co.uk/", ""), (5, "http://sub.evil.co.uk/", ""), (6, "http://me.github.io/", "")]
    rules = [U.Rule("block", "evil.co.uk", "/x"), U.Rule("block", "you.github.io", "/")]
    for parents in (False, True):
        got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, parents=parents).collect()}
        assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block" if parents else "allow", 6: "allow"}


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    pages = [(i, f"http://bad{i}.net/es/1", "") for i in range(3)] + [(10, "http://farm.org/1", '<a href="http://bad0.net/x">x</a><a href=//bad1.net>y</a><a href="/local">z</a>'), (11, "http://fine.org/1", '<a href="http://ok.com/">x</a>'), (12, "http://ok.com/", '<a href="http://fine.org/2">x</a>')]
    got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), floor=0.1).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 10: "block", 11: "allow", 12: "allow"}


def test_verdicts_do_not_depend_on_the_number_of_blocked_hosts(spark):
    for n in (3, 60):
        pages = [(i, f"http://bad{i}.net/es/1", "") for i in range(n)] + [(100, "http://farm.org/1", '<a href="http://bad0.net/x">x</a><a href=//bad1.net>y</a>'), (101, "http://fine.org/1", '<a href="http://ok.com/">x</a>'), (102, "http://ok.com/", '<a href="http://fine.org/2">x</a>'), (103, "http://bad2.net/de/", "")]
        got = {r["page_id"]: r["verdict"] for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in (100, 101, 102, 103)] == ["block", "allow", "allow", "block"]


def test_query_spreads_masses_between_hosts_and_their_parents(spark, tmp_path):
    from sieveworks.llm.queries import ORACLE_SQL, QUERIES

    duckdb = pytest.importorskip("duckdb")
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://a.bad.net/x", ""), (3, "http://b.gone.org/", '<a href="http://bad.net/x">x</a>'), (4, "http://c.gone.org/", ""), (5, "http://other.org/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["verdict"]) for r in QUERIES["op3_url_filter"](spark, str(tmp_path)).collect())
    assert dict(got) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}  # c.gone.org by way of a parent without pages
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.execute(f"SELECT page_id, verdict FROM ({ORACLE_SQL['op3_url_filter']})").fetchall()) == got


def test_empty_pages(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
