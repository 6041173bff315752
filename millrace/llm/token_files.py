"""Flat token files: unsigned integers, 64-bit document offsets, memory-mapped readers.

Documents are put into ranges of ascending ids, a task each, which writes one or more files (shards): ``.bin`` has the ids
of its documents end to end (16 bits where the vocabulary allows, else 32), ``.off`` one 64-bit offset more than documents,
``.doc`` their doc_ids. The manifest has a row per shard; its base, the number of ids in all shards before it, is a prefix
sum of the shards' sizes. A file is written under a name of its own and renamed when whole, so a task that runs again
leaves the same files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh_path, in_order, posix_path, read, ship, text_bytes
from millrace.llm.wordcache import tokenizer

NO_ID = -(2**63)
#: A task's shards are numbered from its own number times this on.
FILES_PER_TASK = 100_000
#: Parts that a worker's tokenizer keeps here, twice the usual number (just below 2/3 of 2**20): nothing else needs the memory.
KEPT_PARTS = 699_000
MANIFEST = "shard long, n_docs long, n_tokens long, item_bytes long"


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _writer(folder: str, vocabulary: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary, KEPT_PARTS)
        end = np.array([end_id], tok.dtype).tobytes()
        width, part, mark = tok.dtype.itemsize, TaskContext.get().partitionId(), uuid.uuid4().hex
        shard, names, files, docs, total = part * FILES_PER_TASK, [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal shard, docs, total
            for f, (temporary, final) in zip(files, names, strict=True):
                f.close()
                os.replace(temporary, final)
            row = [pa.array([x], pa.int64()) for x in (shard, docs, total, width)]
            files.clear()
            shard, docs, total = shard + 1, 0, 0
            return pa.RecordBatch.from_arrays(row, names=["shard", "n_docs", "n_tokens", "item_bytes"])

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                if not files:
                    names = [(f"{folder}/{mark}.{x}", f"{folder}/shard-{shard:09d}.{x}") for x in ("bin", "off", "doc")]
                    files.extend(open(x, "wb", buffering=1 << 20) for x, _ in names)  # noqa: SIM115
                    files[1].write(np.int64(0).tobytes())
                ids = rows.column(0).fill_null(NO_ID)
                encoded = [x + end for x in tok.encode([t or "" for t in rows.column(1).to_pylist()])]
                ends = total + np.cumsum([len(x) // width for x in encoded])
                files[0].write(b"".join(encoded))
                files[1].write(ends.astype("<i8").tobytes())
                files[2].write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, total = docs + len(encoded), int(ends[-1])
                if total * width >= shard_bytes:
                    yield close()
        if files:
            yield close()

    return run


def write_token_files(documents: DataFrame, vocabulary: str, end_id: int = 0, shard_bytes: int = 256 << 20, destination: str | None = None, task_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Writes the files and returns their folder and the manifest (shard, n_docs, n_tokens, item_bytes, base).

    ``documents`` has doc_id and text; a null or empty text has just the end id. Rows come in ascending doc_id, those
    without id first, equal ids by their texts' checksums. A task takes a range of about ``task_bytes`` of text (more where
    that would be over MOST_RANGES ranges) and begins another file when one has ``shard_bytes`` of ids; shards are numbered
    in order, with gaps. Files and manifest (``manifest`` below the folder) stay in ``destination``, a new folder that all
    nodes have mounted; without one they lie in the session's shared folder and go with the session. An empty table has an
    empty manifest; other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = posix_path(destination.rstrip("/") if destination else fresh_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=not destination)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("crc", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)))
    whole = text_bytes(texts)
    target = max(4 << 20, min(task_bytes, whole // (4 * spark.sparkContext.defaultParallelism)))
    ordered = in_order(texts, ["doc_id", "crc"], -(-whole // target)).select("doc_id", "text")
    ordered.mapInArrow(_writer(folder, vocabulary, end_id, shard_bytes), MANIFEST).write.parquet(f"file://{folder}/manifest")
    return folder, read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder, with base, the ids in all shards before."""
    manifest = spark.read.schema(MANIFEST).parquet(f"file://{folder}/manifest")
    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def open_shard(folder: str, shard: int, item_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids) of a shard, mapped into memory rather than read."""
    kinds = {"bin": f"<u{item_bytes}", "off": "<i8", "doc": "<i8"}
    out = []
    for kind, dtype in kinds.items():
        path = f"{folder}/shard-{shard:09d}.{kind}"
        out.append(np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype))
    return tuple(out)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, width, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, offsets, docs = open_shard(folder, shard, width)
                for a in range(0, len(docs), 5_000):
                    cut = np.array(offsets[a : a + 5_001])
                    own = np.array(docs[a : a + 5_000])
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(base + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return run


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the mapped files; a task per shard or more shards."""
    shards = manifest.select("shard", "item_bytes", "base")
    return shards.repartitionByRange(max(1, min(manifest.count(), 10_000)), "shard").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir):
    return read_token_files(*write_token_files(read(spark, sf_dir, "documents"), byte_vocabulary()))
