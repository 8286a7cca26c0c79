import importlib.util
import re
from collections import Counter

import numpy as np
import public_tokenizers
from sieveworks.llm import decontam, jaccard_join, langid, packing, secret_scan

from .fixtures import benchmark, documents
from .test_jaccard import brute as brute_components
from .test_native import base_spans, brute_contamination


def test_stages_chain_and_take_effect(spark, tmp_path):
    import corpus_pipeline as C

    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = now
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect() if r[0] is not None)
    model = langid.learn_from_documents(docs)
    assert ids(kept["language"]) == sorted(r["doc_id"] for r in langid.identify(docs, model).where("NOT rejected").collect() if r["doc_id"] is not None)
    assert ids(kept["near_duplicates"]) == ids(jaccard_join.keep_one(kept["language"]))
    assert len(ids(kept["near_duplicates"])) < len(ids(kept["language"])) - 25
    assert ids(kept["benchmark_decontamination"]) == ids(decontam.remove_contaminated(kept["near_duplicates"], benchmark(spark)))
    assert ids(kept["secrets"]) == ids(kept["benchmark_decontamination"])
    assert all(s["rank"] == 3 for r in secret_scan.find_secrets(kept["secrets"]).collect() for s in r["secrets"])
    encoder = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {}
    for r in now.collect():
        got.setdefault(r["doc_id"], {})[r["start"]] = r["token_ids"]
    for r in kept["secrets"].collect():
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"])
        want = [*encoder.encode_ordinary(r["text"]), 0]
        assert list(np.frombuffer(b"".join(bytes(x) for _, x in sorted(got[r["doc_id"]].items())), "<u4")) == want
    whole = C.run(spark, str(tmp_path))
    assert whole.count() == now.count()


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage by plain Python over awkward rows: unlike texts under one id, repeated rows, nulls, extra columns."""
    import corpus_pipeline as C

    stage = dict(C.STAGES)
    docs = documents(spark, 5)
    more = spark.createDataFrame([(3, "some other text under an id that is there", "en", "s", 5), (30, "some other text under an id that is there", "en", "s", 5), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(more).withColumn("h", docs["doc_id"]).withColumn("secrets", docs["text"])
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts_of = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    # one row of each component: rows of one component at most once, every component still there, nothing else changed
    kept = texts_of(stage["near_duplicates"](spark, docs, str(tmp_path)))
    with_id = sorted({r for r in rows if r[0] is not None}, key=str)
    root = {k: r for k, (_, r) in brute_components([(k, t) for k, (_, t) in enumerate(with_id)]).items()}
    least = {}
    for k, row in enumerate(with_id):
        least.setdefault(root[k], []).append(row[0])
    of = {row: root[k] for k, row in enumerate(with_id)}
    assert all(n == 1 for row, n in kept.items() if row[0] is not None)
    assert Counter(of[row] for row in kept if row[0] is not None) == Counter(dict.fromkeys(least, 1))
    assert all(row[0] == min(least[of[row]]) for row in kept if row[0] is not None)
    assert Counter({r: n for r, n in kept.items() if r[0] is None}) == Counter(r for r in rows if r[0] is None)

    clean = texts_of(stage["benchmark_decontamination"](spark, docs, str(tmp_path)))
    items = [tuple(r) for r in benchmark(spark).collect()]
    assert clean == Counter(r for r in rows if brute_contamination(r[1], items)[1] == 0)

    masked = stage["secrets"](spark, docs, str(tmp_path)).collect()
    assert len(masked) == len(rows) and all(not base_spans(r["text"]) for r in masked)
    plain = Counter(r for r in rows if not base_spans(r[1]))
    assert sum((plain & Counter((r["doc_id"], r["text"]) for r in masked)).values()) >= sum(plain.values()) - 3  # the method's own spans
    for r in masked:
        assert r["n_chars"] is None or r["text"] is None or r["n_chars"] == len(r["text"]) or (r["doc_id"], r["text"]) in Counter(rows)

    spoken = texts_of(stage["language"](spark, docs, str(tmp_path)))
    assert spoken <= Counter(rows) and all(re.search(r"[^\W\d_]", t or "") for _, t in spoken)
    assert sum(spoken.values()) > 0.7 * len(rows)


def test_entry_lists_all_eleven():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
    assert importlib.util.find_spec("sieveworks.llm")
