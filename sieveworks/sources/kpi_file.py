"""A text file of marked blocks as a data source: scalars go into the fields of their blocks, and all else stays byte for byte.

A block begins with a line `- id: name` and ends before the next one of the same indentation, or before a line that is indented less. Its fields are its lines `field: value`, deeper by two.
A trailer, behind a line of its own, holds loose values and is replaced as a whole.

Tasks hand their rows over with their commit messages; the driver's commit parses the file, patches a copy and moves it into the file's place. Without rows, or where a task failed,
the file stays as it is. Writing the same rows again gives the same file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Scalars of one write, at most; they meet on the driver.
MOST_ROWS = 10_000
MARKER = "# --- filled in ---"
SCHEMA = "block string, field string, value string"
_HEAD = re.compile(r"^(?P<indent>\s*)- id:\s*(?P<name>\S.*?)\s*$")
_FIELD = re.compile(r"^(?P<indent>\s*)(?P<field>[^\s#:][^:]*):(?P<value>.*)$")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Line:
    """A line with its end; block and field where it is a block's field, or (None, field) behind the marker."""

    text: str
    block: str | None = None
    field: str | None = None
    behind: bool = False


def parse(text: str, marker: str = MARKER) -> list[Line]:
    out, block, depth, behind = [], None, 0, False
    for raw in text.splitlines(keepends=True):
        line = raw.rstrip("\r\n")
        if line == marker:
            behind, block = True, None
            out.append(Line(raw, behind=True))
            continue
        if behind:
            m = _FIELD.match(line)
            out.append(Line(raw, None, m["field"] if m else None, True))
            continue
        m = _HEAD.match(line)
        indent = len(line) - len(line.lstrip())
        if m:
            block, depth = m["name"], len(m["indent"])
            out.append(Line(raw, block))
        elif line.strip() and indent <= depth and block is not None and not line.lstrip().startswith("#"):
            block = None
            out.append(Line(raw))
        else:
            f = _FIELD.match(line)
            own = block is not None and f and len(f["indent"]) == depth + 2
            out.append(Line(raw, block, f["field"] if own else None))
    return out


def patch(text: str, values: dict[tuple[str | None, str], str | None], marker: str = MARKER) -> str:
    """The text with values in place; a field or block that is not there stays away. Values without a block make the trailer anew, in their order."""
    loose = {f: v for (b, f), v in values.items() if b is None}
    shown = lambda v: "null" if v is None else v
    out, done = [], set()
    for line in parse(text, marker):
        if line.behind and loose:
            continue
        key = (line.block, line.field)
        if line.block is not None and line.field is not None and key in values and key not in done:
            done.add(key)
            ending = line.text[len(line.text.rstrip("\r\n")) :]
            head = _FIELD.match(line.text.rstrip("\r\n"))
            out.append(f"{head['indent']}{line.field}: {shown(values[key])}{ending}")
        else:
            out.append(line.text)
    made = "".join(out)
    if loose:
        made = made.rstrip("\n") + "\n\n" + marker + "\n" + "".join(f"{f}: {shown(v)}\n" for f, v in loose.items())
    return made


@dataclass
class Scalars(WriterCommitMessage):
    rows: list[tuple[str | None, str, str | None]]


class KpiWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.marker = options["path"], options.get("marker", MARKER)

    def write(self, iterator: Iterator) -> Scalars:
        rows = []
        for r in iterator:
            rows.append((r["block"], r["field"], r["value"]))
            if len(rows) > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} scalars")
        return Scalars(rows)

    def commit(self, messages: list) -> None:
        rows = sorted((r for m in messages if m for r in m.rows), key=lambda r: (r[0] or "", r[1], r[2] or ""))
        if not rows:
            return
        values = {(b, f): v for b, f, v in rows}
        if len(rows) > MOST_ROWS or any(values[b, f] != v for b, f, v in rows):
            raise ValueError("a field has two values, or there are too many scalars")
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as f:
            old = f.read().decode()
        new = patch(old, values, self.marker)
        if new == old:
            return
        beside = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(new.encode())
        fs.move(beside, path)

    def abort(self, messages: list) -> None:
        """Nothing was written before commit."""


class KpiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.marker = options["path"], options.get("marker", MARKER)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = file_system(self.path)
        with fs.open_input_file(path) as f:
            text = f.read().decode()
        for line in parse(text, self.marker):
            if line.field is not None:
                value = _FIELD.match(line.text.rstrip("\r\n"))["value"].strip()
                yield (line.block, line.field, None if value == "null" else value)


class KpiFile(DataSource):
    """Format `kpi_file`; option path. Rows are (block, field, value); a null block is the trailer."""

    @classmethod
    def name(cls) -> str:
        return "kpi_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KpiReader:
        return KpiReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> KpiWriter:
        return KpiWriter(dict(self.options))
