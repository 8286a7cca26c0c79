"""Media columns: archives of images, read by a Spark data source of our own.

write_archives stores payloads losslessly as 8-bit grey PNG images, 64 samples wide, as members of ZIP archives, one
archive for each task and 8,192 members, in a folder that all executors share. Every attempt of a task writes archives of names of its own, and a manifest,
written by Spark's own committer, names those of the attempts that counted; what a lost or second attempt has left is never read.
The folder may be a plain path or a URI that pyarrow opens (file, hdfs, s3, gs, abfs, abfss; s3a is taken as s3); others raise before any work.

The source `media_archive` plans byte ranges over the manifest's archives from their sizes alone. A reader takes the members whose
local header starts in its range, from the archive's central directory, seeks to each one by its offset, checks it, and
retries it alone if that fails, before the task fails. Members stream out in Arrow batches of bounded size.

Defined results: null and empty payloads are one row of zeros; equal payloads give equal members; repeated rows are
members of their own; a null id stays null; an empty table gives a manifest without archives and an empty result; very long payloads are
one member and one batch each; ids may be integers or strings of some 60,000 bytes at most, as they stand in a member's comment; other columns are not stored, so their names do not matter.
"""

from __future__ import annotations

import binascii
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import text_buffers

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    samples = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()  # filter 0 in front of each row
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(samples, level)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], (0, 0)
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if binascii.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the image, from its samples."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = [b.reshape(len(b), 8, 8).mean(axis=(0, 2)) if len(b) else np.zeros(8) for b in np.array_split(x, 8)]
    grid = np.concatenate(bands)
    bits = int("".join("1" if v > grid.mean() else "0" for v in grid), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{bits:016x}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if ":/" in path else (pafs.LocalFileSystem(), path)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", members: int = 8192) -> int:
    """Writes all payloads and the manifest; gives their number. Runs at once."""
    file_system(folder)
    names = ["archive", "size", "members"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part, n, archive, out, name, done = TaskContext.get().partitionId(), 0, None, None, "", []

        def finish() -> None:
            nonlocal archive, n
            if archive is not None:
                archive.close()
                size = out.tell()
                out.close()
                done.append((name, size, n))
                archive, n = None, 0

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for row, doc in enumerate(batch.column(0).to_pylist()):
                if archive is None:
                    name = f"part-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                raw = data[offsets[row] : offsets[row + 1]].tobytes()
                info = zipfile.ZipInfo(f"{n:010d}.png")
                info.comment = json.dumps([doc, len(raw)]).encode()
                archive.writestr(info, encode_png(pad(raw)))
                n += 1
                if n == members:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names)

    docs.select(id_col, text_col).mapInArrow(write, "archive string, size long, members long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest").agg(F.sum("members").alias("n")).first()["n"] or 0


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 32 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.retries = int(options.get("retries", 3))
        self.id_type = options.get("idType", "long")

    def partitions(self) -> list[ByteRange]:
        fs, root = file_system(self.folder)
        parts = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(f"{root}/manifest", allow_not_found=True)) if i.base_name.endswith(".parquet"))
        listed = sorted((name, size) for path in parts for name, size in zip(*(c.to_pylist() for c in pq.read_table(path, filesystem=fs, columns=["archive", "size"]).columns), strict=True))
        found = [ByteRange(f"{root}/{name}", at, min(at + self.range_bytes, size)) for name, size in listed for at in range(0, size, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def member(self, open_file, info: zipfile.ZipInfo) -> tuple[bytes, bytes]:
        """(stored bytes, payload) of one member, by its offset."""
        for attempt in range(self.retries + 1):
            try:
                with open_file() as f:
                    f.seek(info.header_offset)
                    header = f.read(30)
                    if header[:4] != b"PK\x03\x04":
                        raise ValueError("no member starts at its offset")
                    name, extra = struct.unpack("<HH", header[26:30])
                    f.seek(info.header_offset + 30 + name + extra)
                    stored = f.read(info.compress_size)
                if len(stored) != info.compress_size or binascii.crc32(stored) != info.CRC:
                    raise ValueError("a member is damaged")
                return stored, decode_png(stored)
            except (OSError, ValueError, zlib.error):
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "member_offset", "n_bytes", "media", "payload", "feature"]
        kinds = [pa.string() if self.id_type == "string" else pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

        if not partition.path:
            return
        fs, _ = file_system(self.folder)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = sorted((i for i in archive.infolist() if partition.start <= i.header_offset < partition.stop), key=lambda i: i.header_offset)
        rows, size = [], 0
        for info in members:
            stored, payload = self.member(lambda: fs.open_input_file(partition.path), info)
            doc, n = json.loads(info.comment)
            rows.append((doc, info.header_offset, n, stored, payload, feature_of(payload)))
            size += len(payload) + len(stored)
            if size >= self.batch_bytes:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder); options rangeBytes, batchBytes, retries, and idType (long or string)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return f"doc_id {self.options.get('idType', 'long')}, member_offset long, n_bytes long, media binary, payload binary, feature string"

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: int | str) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def tail_crc32(payload_column: str) -> str:
    """SQL of the unsigned crc32 of the last 64 bytes."""
    return f"crc32(substring({payload_column}, -64, 64))"

