"""Records of CSV files of any size, read by ranges of bytes.

A range owns the physical lines that begin in it, and the records whose first line it owns. Whether a line begins inside a quoted field depends on all lines before,
so two passes are made. The first gives, for each range, the state that it ends in and the records that begin in it, for both states that it may begin in. Composed over a
file's ranges in order, one small row each, these give every range the state that it really begins in and the number of records before it. The second pass parses each range from its
first true record on, past the range's end where its last record goes on, and numbers the rows.

Quotes are read as Python's csv does: a quote opens a field only at the field's start, a doubled quote inside is one, and what follows a closing quote up to the comma is
plain. Lines end with LF, CR or CR LF. In UTF-8 and GB18030 none of these bytes is part of a longer character.

A task holds a line and a record at a time, whatever the file's length. Paths are opened by Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

#: Bytes read at once, and of a file's head that tell its charset.
CHUNK, HEAD = 1 << 20, 1 << 16
#: Fixed value: the mark that UTF-8 files may begin with. Characters of a field, at most.
MARK, FIELD_MOST = b"\xef\xbb\xbf", 1 << 30
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rb'(?:"' + _QUOTED + rb'|[^",][^,]*+|)'
#: Lines, without their ends, behind which no quoted field is open: of those that begin outside of one, and inside.
CLOSED = {False: re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+", re.S), True: re.compile(_QUOTED + rb"(?:," + _FIELD + rb")*+", re.S)}
LINE_END = re.compile(rb"\r\n|\n|\r(?!\n)")


def open_file(path: str) -> pa.NativeFile:
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def lines_from(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line with its end) of the lines that begin at `start` or later."""
    begin, size, tail = max(0, start - 1), file.size(), start > 0  # tail: the line that began before `start` has not ended
    file.seek(begin)
    held, seen = bytearray(), 0
    while begin + len(held) < size:
        held += file.read(CHUNK)
        used = 0
        for m in LINE_END.finditer(held, seen):
            if m.end() == len(held) and m[0] == b"\r" and begin + len(held) < size:
                break  # a LF may follow
            if not tail:
                yield begin + used, bytes(held[used : m.end()])
            tail, used = False, m.end()
        m = None  # it holds the buffer
        del held[:used]
        begin, seen = begin + used, max(0, len(held) - 1)
    if held and not tail:
        yield begin, bytes(held)


def is_open(line: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open behind the line, which begins in one or not."""
    if b'"' not in line:
        return quoted
    return CLOSED[quoted].fullmatch(line.rstrip(b"\r\n")) is None


def summary(path: str, start: int, stop: int) -> tuple[bool, bool, int, int]:
    """Whether a range that begins outside of quotes, or inside, ends in them; and the records that begin in it in both cases. Blank lines are no records, but for a file's first."""
    state, begun = [False, True], [0, 0]
    with open_file(path) as file:
        for at, line in lines_from(file, start):
            if at >= stop:
                break
            for s in (0, 1):
                begun[s] += not state[s] and (at == 0 or line.strip(b"\r\n") != b"")
                state[s] = is_open(line.removeprefix(MARK) if at == 0 else line, state[s])
    return state[0], state[1], begun[0], begun[1]


def rows_of_range(path: str, charset: str, start: int, stop: int, quoted: bool) -> Iterator[list[str]]:
    """The records that begin in a range; blank ones are left out, but for a file's first."""
    with open_file(path) as file:
        lines, fresh, began = lines_from(file, start), True, 0

        def fed() -> Iterator[str]:
            nonlocal fresh, quoted, began
            for at, line in lines:
                if quoted:  # the record began before the range
                    quoted = is_open(line, True)
                    continue
                if fresh and at >= stop:
                    return
                began = at if fresh else began
                fresh = False
                yield line.decode(charset if at == 0 else charset.removesuffix("-sig"), errors="replace")

        csv.field_size_limit(FIELD_MOST)
        for row in csv.reader(fed()):
            if row or began == 0:
                yield row
            fresh = True


def header_of(path: str, charset: str) -> list[str]:
    return next(rows_of_range(path, charset, 0, 1, False), [])


def plan_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """files (path, length, ...) as a row for each range: k, start, stop, quoted (the state it begins in), before (records before it), saved."""
    cut = files.where("length > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))))
    cut = cut.withColumn("start", F.col("k") * range_bytes).withColumn("stop", F.least(F.col("start") + range_bytes, "length"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [*batch.schema.names, "from_plain", "from_quoted", "n_plain", "n_quoted"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    seen = cut.repartition(tasks, "path", "k").mapInArrow(scan, f"{kept}, from_plain boolean, from_quoted boolean, n_plain long, n_quoted long")
    # a range ends in one state whatever it began in, or keeps the state, or turns it: the last sure state and the turns since then give the state
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("from_plain") & ~F.col("from_quoted"), 1).otherwise(0)).over(before), F.lit(0))
    sure = F.when(F.col("from_plain") == F.col("from_quoted"), F.struct(F.col("from_plain").alias("state"), F.col("turns").alias("at")))
    known = seen.withColumn("turns", turns).withColumn("last", F.last(sure, ignorenulls=True).over(before))
    odd = (F.col("turns") - F.coalesce("last.at", F.lit(0))) % 2 == 1
    known = known.withColumn("quoted", F.coalesce("last.state", F.lit(False)) != odd)
    count = F.sum(F.when(F.col("quoted"), F.col("n_quoted")).otherwise(F.col("n_plain"))).over(before)
    return saved(known.withColumn("before", F.coalesce(count, F.lit(0))).select(*cut.columns, "quoted", "before"), "csv-ranges")


def parse_ranges(ranges: DataFrame, carried: list[str]) -> DataFrame:
    """(carried columns, charset, row_idx, header, fields) of every record of planned ranges but the files' headers. ranges must have a charset."""
    types = {f.name: f.dataType.simpleString() for f in ranges.schema.fields}
    names = [*carried, "charset", "row_idx", "header", "fields"]
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: dict[str, list[str]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                path, charset, start, stop, quoted, before = (batch.column(c)[i].as_py() for c in ("path", "charset", "start", "stop", "quoted", "before"))
                if path not in headers:
                    headers = {path: header_of(path, charset)}  # a task's ranges are of few files
                columns = headers[path]
                out: list[tuple[int, list[str], list[tuple[str, str | None]]]] = []

                def made(out=out, row=i, charset=charset) -> pa.RecordBatch:
                    own = [pa.array([batch.column(c)[row].as_py()] * len(out), batch.column(c).type) for c in carried]
                    at, heads, fields = zip(*out, strict=True)
                    return pa.RecordBatch.from_arrays([*own, pa.array([charset] * len(out)), pa.array(at, pa.int32()), pa.array(heads, pa.list_(pa.string())), pa.array(fields, pa.map_(pa.string(), pa.string()))], names)

                for place, row in enumerate(rows_of_range(path, charset, start, stop, quoted), before - 1):
                    if place < 0:
                        continue  # the header
                    record = dict(zip(columns, row)) | dict.fromkeys(columns[len(row) :])
                    out.append((place, list(record), list(record.items())))
                    if len(out) >= 5000:
                        yield made()
                        out.clear()
                if out:
                    yield made()

    kept = ", ".join(f"`{c}` {types[c]}" for c in carried)
    return ranges.repartition(tasks, "path", "k").mapInArrow(run, f"{kept}, charset string, row_idx int, header array<string>, fields map<string,string>")
