"""WARC files: a writer and a reader whose records the fixity audit takes, for plain and gzip files.

Files lie in a folder of any file system that pyarrow can reach. A gzip file has a member per record, so that a record
can be read by itself; offsets and lengths are those in the file, digests those of the record's own bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ship
from millrace.llm.warc_fixity import audit

RECORDS = "file string, offset long, length long, digest string, record_id string, uri string, kind string"
BLOCK = 1 << 20
_MEMBER = b"\x1f\x8b\x08"
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)
UNREADABLE = "unreadable"


def record_bytes(record_id: str | None, uri: str | None, payload: bytes | None) -> bytes:
    body = payload or b""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{record_id or ''}>\r\nWARC-Target-URI: {uri or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _row(file: str, offset: int, length: int, raw: bytes | None) -> tuple:
    if raw is None:
        return file, offset, length, UNREADABLE, None, None, None
    head = raw.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
    return file, offset, length, hashlib.sha256(raw).hexdigest(), fields.get("warc-record-id", "").strip("<>") or None, fields.get("warc-target-uri"), fields.get("warc-type")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])


def _writer(folder: str, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name = out = temporary = None
        at, rows = 0, []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(temporary, f"{root}/{name}")

        for batch in batches:
            for file, record_id, uri, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = f"{file}.warc.gz" if compress else f"{file}.warc"
                if file != name:
                    close()
                    name, at, temporary = file, 0, f"{root}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                raw = record_bytes(record_id, uri, payload)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                written = packer.compress(raw) + packer.flush() if compress else raw
                out.write(written)
                rows.append(_row(name, at, len(written), raw))
                at += len(written)
                if len(rows) >= 1_000:
                    yield _batch(rows)
                    rows = []
        close()
        if rows:
            yield _batch(rows)

    return run


def write_warc(records: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Writes ``records`` (file, record_id, uri, payload binary) and returns what lies where (RECORDS), which writes when it runs.

    A file is written by one task, in order of record_id, uri and payload, under a name of its own until it is whole. Nulls
    are written as empty; rows without file go into the file ``none``; an empty table writes nothing.
    """
    ship(records.sparkSession)
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = records.select(F.coalesce(F.col("file").cast("string"), F.lit("none")).alias("file"), F.col("record_id").cast("string").alias("record_id"), F.col("uri").alias("uri"), F.col("payload").cast("binary").alias("payload"))
    return own.repartition("file").sortWithinPartitions("file", "record_id", "uri", "payload").mapInArrow(_writer(folder, compress), RECORDS)


class _Source:
    """A file read in blocks, with look-ahead."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.at = stream, b"", 0

    def fill(self, n: int) -> bool:
        """Holds n bytes, or all there are."""
        while len(self.held) < n:
            more = self.stream.read(max(BLOCK, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def until(self, mark: bytes, start: int) -> int:
        """Where the mark comes next, from ``start`` on; all that is left where it doesn't."""
        while (k := self.held.find(mark, start)) < 0:
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.fill(len(self.held) + 1):
                return len(self.held)
        return k


def _members(source: _Source) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, bytes) of a gzip file's members; a broken one ends where the next begins, and has no bytes."""
    while source.fill(1):
        begin, unpacker, parts, used = source.at, zlib.decompressobj(31), [], 0
        try:
            while not unpacker.eof:
                if len(source.held) <= used and not source.fill(used + 1):
                    raise zlib.error("the member isn't whole")
                fresh = source.held[used:]
                parts.append(unpacker.decompress(fresh))
                used += len(fresh) - len(unpacker.unused_data)
            source.take(used)
            yield begin, used, b"".join(parts)
        except zlib.error:
            k = source.until(_MEMBER, 1)
            source.take(k)
            yield begin, k, None


def _plain(source: _Source) -> Iterator[tuple[int, int, bytes | None]]:
    """The same of a file without compression; what is no record ends where the next one begins."""
    while source.fill(1):
        begin = source.at
        head = source.until(b"\r\n\r\n", 0) + 4
        size = _LENGTH.search(source.held[:head])
        whole = head + int(size[1]) + 4 if size and source.held.startswith(b"WARC/") else None
        if whole is not None and source.fill(whole) and source.held[whole - 4 : whole] == b"\r\n\r\n":
            yield begin, whole, source.take(whole)
        else:
            k = source.until(b"WARC/1.", 1)
            source.take(k)
            yield begin, k, None


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    source = _Source(stream)
                    for offset, length, raw in _members(source) if name.endswith(".gz") else _plain(source):
                        rows.append(_row(name, offset, length, raw))
                        if len(rows) >= 1_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """RECORDS of the .warc and .warc.gz files of a folder, a task per file or more files; unreadable stretches are records with that digest."""
    ship(spark)
    system, root = fs.FileSystem.from_uri(folder)
    names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(root)) if x.is_file and re.search(r"^[^.].*\.warc(\.gz)?$", x.base_name))
    listed = spark.createDataFrame([(x,) for x in names], "file string")
    return listed.repartition(max(1, min(len(names), 10_000)), "file").mapInArrow(_reader(folder), RECORDS)


def audit_folders(spark: SparkSession, primary: str, replica: str) -> DataFrame:
    """The audit of two folders of WARC files with the same names."""
    return audit(read_warc(spark, primary), read_warc(spark, replica))
