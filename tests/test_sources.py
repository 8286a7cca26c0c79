import csv
import io
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveworks.errors import DataContractError
from sieveworks.sources import csv_ranges as C
from sieveworks.sources import readers as R
from sieveworks.sources import sinks as K
from sieveworks.streaming import resume as S


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("libraries")
    for folder in ("L1", "L1/url", "L2"):
        (root / folder).mkdir()
    (root / "L1" / "drugs.csv").write_bytes('name,text,empty\n甲,"line one\nline two",\n 乙 ,"say ""hi""",x\n'.encode("utf-8-sig"))
    (root / "L1" / "url" / "skip.csv").write_text("name\nno\n")
    (root / "L2" / "疾病.csv").write_bytes("title,other\n糖尿病,值\n".encode("gb18030"))
    (root / "L2" / "bad.csv").write_bytes(b"a,b\n\xff\xfe\xff\xff\n")
    return str(root)


def test_libraries(spark, library):
    raw = R.read_libraries(spark, library)
    rows = {r["record_id"]: r for r in R.index_records(raw, {}, ["name", "title"]).collect()}
    assert set(rows) == {"L1_drugs#row0", "L1_drugs#row1", "L2_疾病#row0"}
    assert rows["L1_drugs#row0"]["fields"]["text"] == "line one\nline two" and rows["L1_drugs#row1"]["fields"]["text"] == 'say "hi"'
    assert rows["L1_drugs#row1"]["name"] == "乙" and rows["L1_drugs#row0"]["filled_fields"] == ["name", "text"] and rows["L2_疾病#row0"]["name"] == "糖尿病"
    files, skipped = R.index_files(raw, {})
    assert {(r["source_file"], r["n_rows"], r["charset"]) for r in files.collect()} == {("L1/drugs.csv", 2, "utf-8-sig"), ("L2/疾病.csv", 1, "gb18030")}
    assert [r["source_file"] for r in skipped.collect()] == ["L2/bad.csv"]
    assert R.load_table(raw, "L1", "drugs", {}).count() == 2
    assert [tuple(r) for r in R.index_stats(R.index_records(raw, {}, ["name"])).collect()] == [("L1", 2, 2), ("L2", 1, 0)]


def test_logical_names(spark):
    of = lambda s, m=None: spark.createDataFrame([(s,)], "s string").select(R.logical_name(F.col("s"), m or {})).first()[0]
    assert of("drugs-1") == "drugs-1" and of("疾病") == "疾病" and of("Ã¤é", {"Ã¤é": "known"}) == "known"
    with pytest.raises(Exception, match="no logical name"):
        of("Ã¤")


def test_sniff():
    assert R.sniff(b"") == "utf-8-sig" and R.sniff(b"", reject_empty=True) is None
    assert R.sniff("é".encode()) == "utf-8-sig" and R.sniff("中文".encode("gb18030")) == "gb18030" and R.sniff(b"\xff\xff") is None


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "a"}\n\n{"id": 2, "v": "b"}\n{"id": 1, "v": "c"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 2, "v": "d"}\n')
    (tmp_path / "x.json").write_text('[{"id": 7, "v": "z"},\n {"id": 8, "v": "y"}]')
    (tmp_path / "o.json").write_text('{"id": 7}')
    p, ddl = str(tmp_path), "id int, v string"
    assert R.jsonl(spark, p + "/a.jsonl", ddl).count() == 3
    assert sorted(map(tuple, R.merged_jsonl(spark, [p + "/a.jsonl", p + "/b.jsonl"], ddl, "id").collect())) == [(1, "c"), (2, "d")]
    with pytest.raises(DataContractError):
        R.unique_jsonl(spark, p + "/a.jsonl", ddl, "id")
    assert R.json_rows(spark, p + "/x.json", ddl).count() == R.json_array(spark, p + "/x.json", ddl).count() == 2
    with pytest.raises(DataContractError):
        R.json_array(spark, p + "/o.json", ddl)


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# c\n 阿司匹林 \n\n钙\n钙\n")
    p = str(tmp_path)
    assert {r[0] for r in R.word_list(spark, p + "/w.txt").collect()} == {"阿司匹林", "钙"} and R.word_list(spark, p + "/w.txt", least=3).count() == 1
    assert R.word_list(spark, p + "/none.txt", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.word_list(spark, p + "/none.txt").count()
    assert K.word_list_text("t", R.word_list(spark, p + "/w.txt"), ["h"]).endswith("# 2\n钙\n阿司匹林\n")


def test_logs_and_settings(spark):
    rows = R.query_log(spark.createDataFrame([("[频次:12] 高血压",), ("无",)], "value string")).collect()
    assert [tuple(r) for r in rows] == [(12, "高血压"), (0, "无")]
    assert R.setting_seed("5") == 5 and R.setting_seed("") == 20260810 and R.env_pairs("# x\nA = '1'\nB=2") == {"A": "1", "B": "2"}
    with pytest.raises(DataContractError):
        R.setting_seed("x")


def test_positive_predicate(spark):
    of = lambda *o: spark.createDataFrame([(json.dumps(x),) for x in o], "output string")
    a, b = of({"violated": True}, {"violated": False}), of({"verdict": "fail"}, {"verdict": "pass"})
    assert a.where(R.infer_positive(a)).count() == b.where(R.infer_positive(b)).count() == 1
    with pytest.raises(DataContractError):
        R.infer_positive(of({"x": 1}))
    with pytest.raises(DataContractError):
        R.infer_positive(a.limit(0))


def test_shards_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(i, "" if i % 10 == 9 else f"o{i}") for i in range(40)], "id int, output string")
    K.write_shards(rows, str(tmp_path / "s"), [F.col("id")], 14)
    back = spark.read.json(str(tmp_path / "s")).collect()
    kept = [i for i in range(40) if i % 10 != 9]
    assert {r["id"]: r["shard"] for r in back} == {k: i // 14 for i, k in enumerate(kept)}


def test_kpi_on_disk(spark, tmp_path):
    of = lambda rows: spark.createDataFrame(rows, "metric_id string, field string, value double")
    p = str(tmp_path / "kpi")
    K.write_kpi(of([("a", "x", 1.0)]), of([]), p)
    assert not (tmp_path / "kpi").exists()
    K.write_kpi(of([("a", "x", 1.0)]), of([("a", "x", 2.0)]), p)
    assert [tuple(r) for r in K.read_kpi(spark, p).collect()] == [("a", "x", 2.0)]
    K.write_kpi(K.read_kpi(spark, p), of([("a", "y", 3.0)]), p)  # from and to the same path
    assert sorted(tuple(r) for r in K.read_kpi(spark, p).collect()) == [("a", "x", 2.0), ("a", "y", 3.0)]


def test_stream_resumes(spark, tmp_path):
    src, log, mark = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "mark")
    src.mkdir()
    work = lambda df: df.withColumn("output", F.concat(F.lit("out "), F.col("text")))
    go = lambda: S.resume(spark, str(src), "id int, text string", work, log, mark).awaitTermination()
    (src / "1.json").write_text('{"id": 1, "text": "a"}\n{"id": 1, "text": "a"}\n{"id": 2, "text": ""}\n')
    go()
    (src / "2.json").write_text('{"id": 3, "text": "c"}\n{"id": 1, "text": "again"}\n')
    go()
    done = spark.read.parquet(log)
    assert done.count() == 3  # id 1 is in the log already
    order = spark.createDataFrame([(3, 0), (2, 1), (1, 2)], "id int, position int")
    assert [(r["id"], r["output"]) for r in S.compact(done, order).collect()] == [(3, "out c"), (2, "out "), (1, "out a")]


def test_pending(spark):
    c = spark.createDataFrame([(i,) for i in range(5)], "id int")
    done = spark.createDataFrame([(0, "x", None, None), (1, "", None, None), (2, "x", True, None), (3, "x", False, "failed")], "id int, output string, truncated boolean, error string")
    assert sorted(r["id"] for r in S.pending(c, done).collect()) == [1, 2, 3, 4]


def test_streamed_budget(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"k": k, "event": f"{i}", "c": 3.0}) + "\n" for i in range(4) for k in "ab"))
    stream = spark.readStream.schema("k string, event string, c double").json(str(src))
    q = S.sticky_budget(stream, "k", F.col("c"), 5.0).writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"], r["event"]): r["submitted"] for r in spark.table("budget").collect()}
    assert got == {(k, str(i)): i < 2 for k in "ab" for i in range(4)}


def test_elements_are_those_of_the_document_whatever_the_chunks():
    import io

    for value in ([], [1], [12, -3.5e2, "a]\"[,é", None, True], [{"a": [1, {"b": "}"}]}, [], {}], {"a": "]"}):
        for indent in (None, 2):
            raw = json.dumps(value, ensure_ascii=False, indent=indent).encode()
            for chunk in (1, 2, 3, 7, 1 << 20):
                got = [json.loads(x) for x in R.array_elements(io.BytesIO(raw), chunk)]
                assert got == (value if isinstance(value, list) else [value]), (value, chunk)
    for bad in ("[1", "[1,]", "[1 2]", "[1] 2", "[tru]", '{"a": 1} x'):
        with pytest.raises(ValueError):
            list(R.array_elements(io.BytesIO(bad.encode()), 2))
    assert list(R.array_elements(io.BytesIO(b"7"))) == list(R.array_elements(io.BytesIO(b""))) == []


def test_array_documents_are_written_and_read_by_key(spark, tmp_path):
    from sieveworks.sources.sinks import write_json_arrays

    rows = spark.createDataFrame([(i % 5 if i % 11 else None, i, "x" if i % 2 else None) for i in range(100)], "k int, v long, t string")
    write_json_arrays(rows.repartitionByRange(3, "v").sortWithinPartitions("v"), str(tmp_path / "docs"))
    (tmp_path / "docs" / "zz-bad.txt").write_text('[{"k": 1, "v": 999, "t": "x"}, {"k"')
    got = {tuple(r) for r in R.json_array_by_key(spark, str(tmp_path / "docs"), rows.schema, "k").collect()}
    last = {r["k"]: tuple(r) for r in sorted(rows.collect(), key=lambda r: r["v"])}
    assert got == set(last.values())
    docs = [json.loads(f.read_text()) for f in (tmp_path / "docs").glob("part-*")]
    assert len(docs) == 3 and sum(map(len, docs)) == 100


def test_a_key_cut_by_arrow_batches_is_spent_in_order(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [{"k": k, "event": f"{i:03d}", "c": None if i % 7 == 3 else 1.0 + i % 3} for i in range(120) for k in "abc"]
    random.Random(3).shuffle(rows)
    (src / "1.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        stream = spark.readStream.schema("k string, event string, c double").json(str(src))
        S.sticky_budget(stream, "k", F.col("c"), 99.0).writeStream.format("memory").queryName("cut_budget").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {(r["key"], r["event"]): (r["spent"], r["submitted"]) for r in spark.table("cut_budget").collect()}
    finally:
        spark.conf.set(key, before)
    want, spent = {}, dict.fromkeys("abc", 0.0)
    for r in sorted(rows, key=lambda r: r["event"]):
        s = spent[r["k"]]
        want[r["k"], r["event"]] = (s, s <= 99.0)
        spent[r["k"]] += (r["c"] or 0.0) * (s <= 99.0)
    assert got == want


def test_windows_on_a_table(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((str(r["window_start"]), r["n"], r["total"]) for r in S.windowed_counts(e, "ts", "k", "v").collect()) == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 01:00:00", 1, 4.0)]


def test_workbook_column(spark, tmp_path):
    import zipfile

    cell = lambda ref, body, kind="": f'<c r="{ref}"{kind}>{body}</c>'
    rows = [cell("A1", "<v>0</v>", ' t="s"') + cell("B1", "<v>1</v>"), cell("A2", "<v>1</v>", ' t="s"') + cell("B2", "<v>9</v>"), cell("A3", "<is><t>plain</t></is>", ' t="inlineStr"'), cell("A12", "<v>7.5</v>")]
    with zipfile.ZipFile(tmp_path / "faq.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="http://x"><si><t>header</t></si><si><r><t>[频次:12] </t></r><r><t>吃药</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://x"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")
    lines = R.xlsx_lines(spark, str(tmp_path))
    assert sorted((r["freq"], r["text"]) for r in R.query_log(lines).collect()) == [(0, "7.5"), (0, "plain"), (12, "吃药")]


AWKWARD = {
    "plain.csv": "name,note\na,1\nb,2\n",
    "quoted.csv": 'name,note\r\n"a\r\nb","x ""y"" z"\r\n"c,\n\n,d",e"f\r\n\r\n"g"h,"i"\r\nlast,"open to\nthe end',
    "stray.csv": 'na"me,note\n5" pipe,"a\n\n"b" c"\n"x"y"z,"\n"\n,\n"",""""\n',
    "carriage.csv": 'name,note\ra,1\rb,"2\r3"\r\rc,3',
    "blank-first.csv": "\n\na,b\nc\n",
    "long.csv": "name,name,é\n" + "".join(f'{i},"line {i}\n{"x" * (i % 90)}","ü{i}"\n' if i % 3 else f"{i},short\n" for i in range(400)),
    "wide.csv": "name,note\na,b,c,d\n" + '"' + "q" * 3000 + '\n",z\n',
    "empty.csv": "",
}


@pytest.mark.parametrize("size", [64, 65, 97, 1000, 1 << 20])
def test_ranges_of_files_give_the_records_of_whole_files(spark, tmp_path, size):
    (tmp_path / "lib").mkdir()
    want = Counter()
    for i, (name, text) in enumerate(AWKWARD.items()):
        for charset in ("utf-8", "utf-8-sig", "gb18030"):
            inner = f"lib/{charset} {name}"
            (tmp_path / inner).write_bytes(text.encode(charset))
            raw = (tmp_path / inner).read_bytes()
            for k, r in enumerate(csv.DictReader(io.StringIO(raw.decode(R.sniff(raw)), newline=""))):
                r.pop(None, None)
                want[inner, k, tuple(r), tuple(r.items())] += 1
    got = Counter((r["source_file"], r["row_idx"], tuple(r["header"]), tuple(r["fields"].items())) for r in R.read_libraries(spark, str(tmp_path), range_bytes=size).collect())
    key = lambda c: Counter({(f, k, h, tuple(sorted(x, key=str))): n for (f, k, h, x), n in c.items()})  # noqa: E731  maps have no order
    assert key(got) == key(want)


def test_ranges_end_in_the_states_that_a_reader_is_in(tmp_path):
    rng = random.Random(4)
    for n in range(60):
        text = "".join(rng.choice(['"', '"', ",", "\n", "\r\n", "\r", "a", "b c", '""']) for _ in range(rng.randint(1, 60)))
        (tmp_path / "f.csv").write_bytes(text.encode())
        rows = list(csv.reader(io.StringIO(text, newline="")))
        for size in (3, 7, 1000):
            state, got = False, []
            for start in range(0, len(text), size):
                got += C.rows_of_range(str(tmp_path / "f.csv"), "utf-8", start, start + size, state)
                state = C.summary(str(tmp_path / "f.csv"), start, start + size)[state]
            assert got == [r for i, r in enumerate(rows) if r or i == 0], (text, size)
