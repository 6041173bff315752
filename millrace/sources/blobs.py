"""Single files of any Hadoop file system: read, stream, download, sample, write and delete; and stored lists of names."""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from millrace.sources.files import pack_names, unpack_names


@dataclass(frozen=True)
class Blob:
    name: str
    bytes: int
    created: int  # epoch seconds


class BlobStore:
    """Small files and file names, on the driver. Data that grows is read through the sources instead."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._jvm = spark, spark._jvm

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def metadata(self, path: str) -> Blob:
        fs, where = self._at(path)
        s = fs.getFileStatus(where)
        return Blob(s.getPath().toString(), s.getLen(), s.getModificationTime() // 1000)

    def text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def stream(self, path: str, block: int = 1 << 20) -> Iterator[bytes]:
        """The file in blocks, without holding it whole."""
        fs, where = self._at(path)
        stream, left = fs.open(where), fs.getFileStatus(where).getLen()
        try:
            while left:
                n = min(block, left)
                yield bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
                left -= n
        finally:
            stream.close()

    def lines(self, path: str) -> Iterator[str]:
        held = b""
        for part in self.stream(path):
            *whole, held = (held + part).split(b"\n")
            yield from (x.decode() for x in whole)
        if held:
            yield held.decode()

    def download(self, path: str, folder: str) -> str:
        """A local copy under the file's own name; its path."""
        out = os.path.join(folder, os.path.basename(path))
        with open(out, "wb") as f:
            for part in self.stream(path):
                f.write(part)
        return out

    def names(self, folder: str, pattern: str = "*") -> Iterator[Blob]:
        """Files below a folder, one at a time; the listing isn't held."""
        fs, where = self._at(folder)
        wanted = re.compile(re.escape(pattern).replace(r"\*", ".*").replace(r"\?", "."))
        found = fs.listFiles(where, True) if fs.exists(where) else None
        while found is not None and found.hasNext():
            s = found.next()
            if wanted.fullmatch(s.getPath().getName()):
                yield Blob(s.getPath().toString(), s.getLen(), s.getModificationTime() // 1000)

    def download_random(self, folder: str, local: str, pattern: str = "*", seed: int = 0) -> str | None:
        """A local copy of one file, each with the same chance; None without files."""
        rng, chosen = random.Random(seed), None
        for n, blob in enumerate(self.names(folder, pattern), 1):
            if rng.randrange(n) == 0:
                chosen = blob
        return self.download(chosen.name, local) if chosen else None

    def write_text(self, path: str, text: str) -> None:
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, True)


def shard_path(folder: str, stream_id: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{stream_id}__files_{number:06d}.txt"


def store_shards(store: BlobStore, folder: str, stream_id: str, groups: Sequence[Sequence[str]]) -> list[str]:
    """Writes each group of file names as a packed text; the paths, which are the shards' names."""
    paths = [shard_path(folder, stream_id, k) for k in range(len(groups))]
    for path, names in zip(paths, groups, strict=True):
        store.write_text(path, pack_names(names))
    return paths


def stored_shard(store: BlobStore, path: str) -> list[str]:
    return unpack_names(store.text(path))
