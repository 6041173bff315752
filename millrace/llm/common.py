"""Shared helpers: the cluster's shared folder, written tables that cut lineage, and doc-id cells."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, gets an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it is removed when the process ends, or by discard()."""
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}-{name}"
    _OWNED.append((spark, path))
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = _filesystem(spark, path)
        fs.delete(where, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _OWNED:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def posix_path(uri: str) -> str:
    """The local path of a shared folder that is mounted on every node; memory mapping needs one."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if uri.startswith("/"):
        return uri
    raise ValueError(f"{uri}: memory-mapped files need a mounted shared folder, not an object store")


class Written:
    """A table that has been written to the shared folder, so that later work doesn't depend on lost executors."""

    def __init__(self, df: DataFrame, name: str, compression: str = "zstd") -> None:
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Partitions of a table that is put in order; the driver samples 100 keys of each.
MOST_RANGES = 10_000


def in_order(df: DataFrame, order: Sequence[str], partitions: int) -> DataFrame:
    """The rows in ascending order of ``order`` (nulls first), over range partitions of about equal numbers of rows.

    Bounds are quantiles of a sample, so outliers and uneven keys don't crowd a partition; rows that are equal in all of
    ``order`` are told apart by their place in the input, so a much repeated row is spread as well.
    """
    keys = [*order, "__place"]
    return df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(max(1, min(MOST_RANGES, partitions)), *keys).sortWithinPartitions(*keys).drop("__place")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(documents: DataFrame) -> int:
    """UTF-8 bytes of all texts, and one a row."""
    return documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a written table; the written tables that it made on the way are dropped."""
    before = len(_OWNED)
    out = Written(make(), name)
    made, _OWNED[before:] = _OWNED[before:], [x for x in _OWNED[before:] if x[1] == out.path]
    for spark, path in made:
        if path != out.path:
            discard(spark, path)
    return out.df


_SHIPPED: set[str] = set()
#: What goes to a Python worker at a time: Arrow buffers on both sides are as large as a batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once, so that they need no installation of their own.

    It also keeps the session's Arrow batches small, by rows and by bytes, so that many or long texts don't fill a worker.
    """
    import zipfile
    from pathlib import Path

    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < held <= most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="millrace-code-")) / f"millrace-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
