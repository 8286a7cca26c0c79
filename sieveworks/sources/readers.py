"""Readers: CSV libraries of mixed encodings, JSON lines and arrays, word lists, lexicons, settings."""

from __future__ import annotations

import codecs
import io
import itertools
import json
import os
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataContractError
from .csv_ranges import HEAD, open_file, parse_ranges, plan_ranges
from .tables import saved

#: Charsets in the order in which they are tried, and how many characters decide.
CHARSETS = ("utf-8-sig", "utf-8", "gb18030")
SNIFFED = 8192


def sniff(raw: bytes, reject_empty: bool = False, characters: int = SNIFFED) -> str | None:
    """The first charset that decodes the head of a file; None if none does. utf-8-sig also stands for UTF-8 without a mark."""
    if reject_empty and not raw:
        return None
    for charset in CHARSETS:
        try:
            io.TextIOWrapper(io.BytesIO(raw), encoding=charset, newline="").read(characters)
            return charset
        except UnicodeDecodeError:
            continue
    return None


RECORDS = "lib string, logical string, stem string, source_file string, charset string, row_idx int, header array<string>, fields map<string,string>"
FILE = "skipped boolean"


def read_libraries(spark: SparkSession, root: str, skip_dir: str = "url", range_bytes: int = 64 << 20) -> DataFrame:
    """All logical records of the CSV files below a folder, with a row index that starts anew in each file.

    Files are listed without their contents and read by ranges of `range_bytes`, so one file may be many tasks; quoted line ends stay inside fields. A file's head tells
    its charset. Files that no charset fits give one row with a null charset and no record.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "length")
    bare = lambda path: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path)  # noqa: E731  Spark and callers may write one scheme in two ways
    base = bare(root).rstrip("/")
    names = ["path", "length", "lib", "stem", "source_file", "charset"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                real = unquote(bare(path)) if base not in path else bare(path)
                inner = real[real.rindex(base) + len(base) :].strip("/") if base in real else real.rsplit("/", 1)[-1]
                parts = inner.split("/")
                if skip_dir in parts[:-1]:
                    continue
                where = path if not path.startswith("file:") else bare(path) if os.path.exists(bare(path)) else unquote(bare(path))
                with open_file(where) as file:
                    rows.append((where, length, parts[0], parts[-1].removesuffix(".csv"), inner, sniff(file.read(HEAD))))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    judged = saved(files.mapInArrow(judge, "path string, length long, lib string, stem string, source_file string, charset string"), "csv-files")
    bad = judged.where("charset IS NULL")
    rows = parse_ranges(plan_ranges(judged.where("charset IS NOT NULL"), range_bytes), ["lib", "stem", "source_file"])
    lacking = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in RECORDS.split(", "))]
    shaped = rows.withColumn("logical", F.lit(None).cast("string")).select(*[x.split(" ")[0] for x in RECORDS.split(", ")])
    return shaped.unionByName(bad.select("lib", lacking[1], "stem", "source_file", *lacking[4:]))


def logical_name(stem: Column, mapped: dict[str, str]) -> Column:
    """Readable stems (ASCII or CJK) stay, known ones are mapped by their NFC form; any other is an error when it is read."""
    from ..functions.lexical import nfc

    form = nfc(stem)
    known = {unicodedata.normalize("NFC", k): v for k, v in mapped.items()}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    readable = form.rlike(r"^[\x{20}-\x{7E}\x{3000}-\x{303F}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]+$")
    return F.coalesce(F.try_element_at(pairs, form), F.when(readable, form), F.raise_error(F.concat(F.lit("no logical name for "), stem)).cast("string"))


def index_records(raw: DataFrame, mapped: dict[str, str], name_columns: Sequence[str]) -> DataFrame:
    """(record_id, lib, logical, row_idx, name, filled_fields, fields): stable ids; a repeated id keeps its last file's row."""
    rows = raw.where(F.col("charset").isNotNull()).withColumn("logical", logical_name(F.col("stem"), mapped))
    value = lambda c: F.trim(F.coalesce(F.try_element_at("fields", F.lit(c)), F.lit("")))
    name = F.lit("")
    for c in reversed(name_columns):  # the first column that exists, even if it is empty
        name = F.when(F.array_contains("header", c), value(c)).otherwise(name)
    filled = F.filter("header", lambda c: F.trim(F.coalesce(F.try_element_at("fields", c), F.lit(""))) != "")
    out = rows.select(F.format_string("%s_%s#row%d", "lib", "logical", "row_idx").alias("record_id"), "lib", "logical", "source_file", "row_idx", name.alias("name"), filled.alias("filled_fields"), "fields")
    last = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("source_file")))
    return out.withColumn("__r", last).where("__r = 1").drop("__r", "source_file")


def index_files(raw: DataFrame, mapped: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): one row a file; columns in header order."""
    read = raw.where(F.col("charset").isNotNull()).withColumn("logical", logical_name(F.col("stem"), mapped))
    files = read.groupBy("lib", "logical", "source_file", "charset").agg(F.count("*").alias("n_rows"), F.first("header").alias("columns"))
    return files, raw.where(F.col("charset").isNull()).select("lib", "source_file")


def load_table(raw: DataFrame, lib: str, logical: str, mapped: dict[str, str]) -> DataFrame:
    """Rows behind a logical name; of several files only the first by path."""
    rows = raw.where(F.col("charset").isNotNull()).withColumn("logical", logical_name(F.col("stem"), mapped)).where((F.col("lib") == lib) & (F.col("logical") == logical))
    first = rows.agg(F.min("source_file").alias("__f"))
    return rows.join(F.broadcast(first), F.col("source_file") == F.col("__f"), "left_semi")  # one row


def index_stats(records: DataFrame) -> DataFrame:
    """(lib, n, named) by size."""
    return records.groupBy("lib").agg(F.count("*").alias("n"), F.count_if(F.col("name") != "").alias("named")).orderBy(F.desc("n"), "lib")


def word_list(spark: SparkSession, path: str, missing_ok: bool = False, least: int = 1, column: str = "term") -> DataFrame:
    """Distinct trimmed lines that are neither blank nor comments; a missing file is an error unless it may be."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{column} string")
        raise
    term = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(term.alias(column)).where((F.col(column) != "") & ~F.col(column).startswith("#") & (F.length(column) >= least)).distinct()


def jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines count as none."""
    return spark.read.schema(schema).json(path)


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An array document (.json) or lines (.jsonl), by the suffix."""
    return spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """An array document and nothing else."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
    if head is None or head[0] != "[":
        raise DataContractError(f"{path} is not a JSON array")
    return json_rows(spark, path if path.endswith(".json") else path + "/*.json", schema)


def json_array_by_key(spark: SparkSession, path: str, schema: str | T.StructType, key: str) -> DataFrame:
    """The rows of array documents, one for each key: the last one of the last document by name. Documents that are no JSON give no rows; an object alone counts as an array of it.

    A document is read as a stream by one task, which holds a chunk and an element of it at most.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").load(path).select("path")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bare = re.sub(r"^file:/+", "/", name)
                where = name if not name.startswith("file:") else bare if os.path.exists(bare) else unquote(bare)
                try:
                    with open_file(where) as file:
                        for _ in array_elements(file):
                            pass
                except ValueError:
                    continue
                with open_file(where) as file:
                    found, at = array_elements(file), 0
                    while part := list(itertools.islice(found, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], ["__f", "__i", "value"])
                        at += len(part)

    n = min(max(1, len(spark.read.format("binaryFile").load(path).inputFiles())), 4 * spark.sparkContext.defaultParallelism)
    rows = files.repartition(n).mapInArrow(parse, "__f string, __i long, value string").select("__f", "__i", F.from_json("value", kind).alias("r"))
    last = rows.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", F.struct("__f", "__i")).alias("r"))
    return last.select("r.*")


def array_elements(file, chunk: int = 1 << 20) -> Iterator[str]:
    """The texts of the elements of an array document, read by chunks; an object alone is one element, other values none. Raises ValueError where it is no JSON."""
    read, decode = codecs.getreader("utf-8")(file).read, json.JSONDecoder().raw_decode
    buffer, at, ended, begun = "", 0, False, False
    blank = re.compile(r"[ \t\r\n]*")

    def more() -> None:
        nonlocal buffer, at, ended
        got = read(max(chunk, len(buffer) - at))  # a long element is read by growing chunks
        buffer, at, ended = buffer[at:] + got, 0, not got

    def skip() -> str:
        nonlocal at
        while True:
            at = blank.match(buffer, at).end()
            if at < len(buffer) or ended:
                return buffer[at : at + 1]
            more()

    first = skip().lstrip("\ufeff")
    if not first and buffer[at:]:
        at += 1
        first = skip()
    alone = first == "{"
    if first not in ("[", "{"):
        return
    at += not alone
    while (c := skip()) != "]" or begun:
        if not c:
            raise ValueError("the document ends early")
        while True:
            try:
                end = decode(buffer, at)[1]
                if ended or buffer[end : end + 1] in (" ", "\t", "\r", "\n", ",", "]"):  # else a number may go on
                    break
            except ValueError:
                if ended:
                    raise
            more()
        yield buffer[at:end]
        at, begun = end, True
        if alone or (c := skip()) == "]":
            break
        if c != ",":
            raise ValueError("no comma between elements")
        at += 1
    at += not alone
    if skip():
        raise ValueError("more than one document")


def merged_jsonl(spark: SparkSession, path: str | list[str], schema: str, key: str) -> DataFrame:
    """Lines of several files; the last row of a key wins, by sorted file and then by line."""
    lines = spark.read.text(path).withColumns({"__f": F.col("_metadata.file_path"), "__b": F.col("_metadata.file_block_start"), "__i": F.monotonically_increasing_id()})
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "__f", "__b", "__i").select("r.*", "__f", "__b", "__i")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__f"), F.desc("__b"), F.desc("__i")))
    return rows.withColumn("__r", last).where("__r = 1").drop("__f", "__b", "__i", "__r")


def unique_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Lines; a repeated key is an error."""
    from ..operators.evaluate import reject_duplicates

    return reject_duplicates(jsonl(spark, path, schema), [key])


def query_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(freq, text) of lines `[频次:N] text`; without the mark the frequency is 0."""
    mark = r"^\s*\[频次[:：]\s*(\d+)\]\s*"
    freq = F.coalesce(F.regexp_extract(value, mark, 1).try_cast("int"), F.lit(0))
    return lines.select(freq.alias("freq"), F.regexp_replace(value, mark, "").alias("text"))


def _sheet_column(raw: bytes) -> list[str]:
    """The first column of a workbook's first sheet, its header row left out; shared and inline strings, numbers as they are written."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = book.namelist()
        of = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t")
        shared = [of(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out = []
        for cell in (c for c in ElementTree.fromstring(book.read(sheet)).iter() if c.tag.rpartition("}")[2] == "c"):
            if re.fullmatch(r"A(?!1$)\d+", cell.get("r", "")):
                value = next((v.text or "" for v in cell if v.tag.rpartition("}")[2] == "v"), None)
                out.append(of(cell) if value is None else shared[int(value)] if cell.get("t") == "s" else value)
    return out


def xlsx_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, row, value): the first column of the first sheet of each workbook; a workbook is read as a whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in batch.itertuples(index=False):
                values = _sheet_column(bytes(raw))
                yield pd.DataFrame({"source_file": [name.rsplit("/", 1)[-1]] * len(values), "row": range(len(values)), "value": values})

    return files.mapInPandas(parse, "source_file string, row int, value string")


def infer_positive(rows: DataFrame, output: str = "output") -> Column:
    """The predicate that marks positives, from the first row's JSON: `violated`, or `verdict` being fail."""
    first = rows.select(output).limit(1).collect()
    if not first:
        raise DataContractError("no rows")
    found = json.loads(first[0][0])
    if "violated" in found:
        return F.coalesce(F.get_json_object(output, "$.violated") == "true", F.lit(False))
    if "verdict" in found:
        return F.get_json_object(output, "$.verdict") == "fail"
    raise DataContractError("neither violated nor verdict in the rows")


def setting_seed(value: str | None = None, default: int = 20260810) -> int:
    """A whole number, or an error."""
    value = os.environ.get("SPLIT_SEED") if value is None else value
    if value in (None, ""):
        return default
    try:
        return int(value)
    except ValueError:
        raise DataContractError(f"the seed {value!r} is no whole number") from None


def env_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, value) of KEY=value lines of any number of files; comments and lines without = are skipped, quotes around values go."""
    kept = lines.where(F.col(value).contains("=") & ~F.ltrim(value).startswith("#"))
    key, rest = F.trim(F.substring_index(value, "=", 1)), F.trim(F.expr(f"substring({value}, instr({value}, '=') + 1)"))
    return kept.select(key.alias("key"), F.regexp_replace(rest, "^[\"']+|[\"']+$", "").alias("value"))


def env_pairs(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blanks are skipped, quotes around values go."""
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}
