"""Versioned tables of Parquet files: append, overwrite by swap, properties, statistics and maintenance.

A table is a folder with data folders and numbered metadata files. A commit writes its data first and then one metadata
file (schema, data files with the bounds of their merge keys, properties such as the watermark, last batch), created under
the next number by an operation that fails where the number is taken: data, watermark and batch number change together, and
of several writers one succeeds. Readers take the highest number. A merge rewrites only files that may hold a key of the
source; the others are carried over by name. Paths go through Hadoop's file systems.
"""

from __future__ import annotations

import bisect
import json
import os
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import MERGE_KEY
from millrace.functions.sizing import row_bytes
from millrace.operators.merge import MergeSpec, merge, merge_small_source
from millrace.operators.reduce import sorted_for_write
from millrace.operators.schema import aligned, evolved, missing_fields


@dataclass
class State:
    version: int
    schema: T.StructType
    files: list[dict]  # path, rows, bytes, how many files its folder was written with (of), and low and high of the key where they're known
    properties: dict[str, str] = field(default_factory=dict)
    gone: dict[str, list[str]] = field(default_factory=dict)  # names of files that the version no longer has, by folders of which it has others


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


#: Keys of a source that are looked up among the files' bounds on the driver.
MOST_KEYS = 100_000
#: Up to so many files are listed by path; of more, whole folders are, with up to as many names left out as MOST_GONE.
FEW_FILES, MOST_GONE = 32, 1_000
#: File systems whose create-without-overwriting is one atomic step; others are refused.
ATOMIC_CREATE = ("hdfs", "viewfs", "abfs", "abfss", "gs")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, rows_per_file: int | None = None, sorted_by: Sequence[str] = (), bloom: Sequence[str] = (), file_format: str = "parquet", file_bytes: int = 128 << 20, key: str = MERGE_KEY, clustered: bool = False) -> None:
        """Files have about ``file_bytes``, by an estimate of the rows' size, or ``rows_per_file`` rows where that is given.

        A clustered table is written in ranges of its key, so that a merge of few keys touches few files.
        """
        self.spark, self.path, self.rows_per_file, self.sorted_by, self.bloom, self.file_format = spark, path.rstrip("/"), rows_per_file, tuple(sorted_by), tuple(bloom), file_format
        self.file_bytes, self.key, self.clustered = file_bytes, key, clustered
        jvm = spark._jvm.org.apache.hadoop
        self._path = jvm.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # metadata

    def _versions(self) -> list[int]:
        where = self._path(f"{self.path}/_meta")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self._versions())

    def _text(self, path: str) -> str:
        """A metadata file's text, read on the driver without a job."""
        if self._fs.getUri().getScheme() == "file":
            with open(self._path(path).toUri().getPath(), encoding="utf-8") as f:
                return f.read()
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def state(self, version: int | None = None) -> State:
        version = version if version is not None else self._versions()[-1]
        found = json.loads(self._text(f"{self.path}/_meta/{version:09d}.json"))
        return State(version, T.StructType.fromJson(found["schema"]), found["files"], found["properties"], found.get("gone", {}))

    def _create(self, path: str, text: str) -> bool:
        """Makes a whole file under a name that is free; False where it is taken. Two callers never both succeed."""
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            local, temporary = (f"{self._local()}{x}" for x in (path, f"/_meta/.{uuid.uuid4().hex}"))
            os.makedirs(os.path.dirname(local), exist_ok=True)
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(temporary, local)  # fails if the name exists, and shows the file whole
            except FileExistsError:
                return False
            finally:
                os.unlink(temporary)
            return True
        if scheme not in ATOMIC_CREATE:
            raise NotImplementedError(f"{scheme}: commits need a file system that creates files atomically; use one of {ATOMIC_CREATE}")
        temporary = self._path(f"{self.path}/_meta/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(temporary, self._path(f"{self.path}{path}"), options)
        except Exception as e:  # noqa: BLE001
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _local(self) -> str:
        return self._path(self.path).toUri().getPath()

    def _commit(self, state: State) -> State:
        text = json.dumps({"schema": state.schema.jsonValue(), "files": state.files, "properties": state.properties, "gone": state.gone})
        if not self._create(f"/_meta/{state.version:09d}.json", text):
            raise CommitConflict(f"{self.path} has a version {state.version} already")
        return state

    # reading

    def schema(self) -> T.StructType:
        return self.state().schema

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        return self._files(state, state.files)

    def _files(self, state: State, files: Sequence[Mapping]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], state.schema).limit(0)  # which the optimiser knows to be empty
        paths, gone = self._scanned(state, files)
        found = self.spark.read.schema(state.schema).format(self.file_format).load([f"{self.path}/{p}" for p in paths])
        return found.where(~F.col("_metadata.file_name").isin(gone)) if gone else found

    def _scanned(self, state: State, files: Sequence[Mapping]) -> tuple[list[str], list[str]]:
        """What a scan of many files lists: folders instead of each file, and the names that don't count there.

        A folder is taken if the files and those known to be gone are all that it was written with.
        """
        if len(files) <= FEW_FILES:
            return [f["path"] for f in files], []
        by: dict[str, list[Mapping]] = {}
        for f in files:
            by.setdefault(_folder(f), []).append(f)
        paths, left_out = [], []
        for folder, own in by.items():
            gone = state.gone.get(folder, [])
            if len(own) + len(gone) == own[0].get("of") and len(gone) < len(own) and len(left_out) + len(gone) <= MOST_GONE:
                paths.append(folder)
                left_out += gone
            else:
                paths += [f["path"] for f in own]
        return paths, left_out

    def properties(self) -> dict[str, str]:
        return self.state().properties

    def require_property(self, name: str) -> str:
        return self.properties()[name]

    def set_properties(self, **values: str) -> None:
        s = self.state()
        self._commit(State(s.version + 1, s.schema, s.files, s.properties | values, s.gone))

    # writing

    def _write(self, df: DataFrame, whole: bool = False) -> list[dict]:
        """Writes rows and returns their files. The bounds of the key are read from what was written, by file.

        A ``whole`` table of small files is counted and cut into as many tasks as there are partitions: their files take the
        time, not their bytes, by which Spark would join partitions to about one a core, or one more.
        """
        folder = f"data/{uuid.uuid4().hex}"
        if self.clustered and self.key in df.columns:
            many = whole and self.rows_per_file and self.rows_per_file <= self.file_bytes // max(1, row_bytes(df.schema) // 4) // 10
            n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // self.rows_per_file)) if many else 0
            df = df.repartitionByRange(n, self.key) if n else df.repartitionByRange(self.key)
            if not self.sorted_by:
                df = df.sortWithinPartitions(self.key)  # else the files of a task overlap
        if self.sorted_by:
            df = sorted_for_write(df, self.sorted_by)
        rows = self.file_rows(df.schema)
        self._writer(df, rows).option("maxRecordsPerFile", rows).save(f"{self.path}/{folder}")
        return self._described(folder, df.schema)

    def file_rows(self, schema: T.StructType) -> int:
        return self.rows_per_file or max(10_000, self.file_bytes // max(1, row_bytes(schema) // 4))

    def ranges(self, most: int) -> list[tuple[DataFrame, int, list[tuple]]] | None:
        """The rows in parts of whole files of about ``most`` rows, each with its number of rows and the bounds of its files' keys.

        Parts have keys that lie side by side, and no key but null is in two. None where files' bounds aren't known or overlap.
        """
        s = self.state()
        if any("low" not in f for f in s.files):
            return None
        bounded = sorted((f for f in s.files if f["low"] is not None), key=lambda f: (f["low"], f["high"]))
        if any(a["high"] >= b["low"] for a, b in zip(bounded, bounded[1:])):
            return None
        parts: list[list[dict]] = []
        for f in [*(f for f in s.files if f["low"] is None), *bounded]:
            if parts and sum(x["rows"] for x in parts[-1]) + f["rows"] <= most:
                parts[-1].append(f)
            else:
                parts.append([f])
        return [(self._files(s, p), sum(f["rows"] for f in p), [(f["low"], f["high"]) for f in p if f["low"] is not None]) for p in parts]

    def _writer(self, df: DataFrame, rows: int) -> DataFrameWriter:
        """Writes with the table's Bloom filters, made for ``rows`` rows a file: without a number, each takes 1 MB in the smallest file."""
        writer = df.write.format(self.file_format)
        for c in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", rows)
        return writer

    def _described(self, folder: str, schema: T.StructType) -> list[dict]:
        """The folder's files that have rows, with their sizes and bounds, by one job."""
        bounded = self.key in schema.names and isinstance(schema[self.key].dataType, (T.StringType, T.LongType, T.IntegerType))
        extremes = [F.min(self.key).alias("low"), F.max(self.key).alias("high")] if bounded else []
        data = self.spark.read.schema(schema).format(self.file_format).load(f"{self.path}/{folder}").select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_size").alias("__bytes"))
        # a row per file: as many as the commit's list of files has anyway
        found = data.groupBy("__file", "__bytes").agg(F.count("*").alias("rows"), *extremes).collect()
        return [{"path": f"{folder}/{r['__file']}", "bytes": r["__bytes"], "rows": r["rows"], "of": len(found)} | ({"low": r["low"], "high": r["high"]} if bounded else {}) for r in sorted(found, key=lambda r: r["__file"])]

    def create(self, schema: T.StructType, replace: bool = False, properties: Mapping[str, str] | None = None) -> VersionedTable:
        versions = self._versions()
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        if versions and not replace:
            return self
        self._commit(State((versions or [-1])[-1] + 1, nullable, [], dict(properties or {})))
        return self

    def append(self, df: DataFrame, **properties: str) -> State:
        """Adds rows by column name; columns that the table doesn't have are an error."""
        s = self.state()
        if extra := missing_fields(s.schema, df.schema):
            raise ValueError(f"the table lacks {[f.name for f in extra]}; migrate it first")
        return self._commit(State(s.version + 1, s.schema, [*s.files, *self._write(aligned(df, s.schema))], s.properties | properties, s.gone))

    def overwrite(self, df: DataFrame, **properties: str) -> State:
        """Replaces rows and schema in one commit; readers of older versions aren't disturbed."""
        versions = self._versions()
        old = self.state(versions[-1]).properties if versions else {}
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        return self._commit(State((versions or [-1])[-1] + 1, schema, self._write(df, whole=True), old | properties))

    def migrate(self, source: T.StructType) -> list[T.StructField]:
        """Adds the source's missing fields; returns them."""
        s = self.state()
        missing = missing_fields(s.schema, source)
        if missing:
            self._commit(State(s.version + 1, evolved(s.schema, source), s.files, s.properties, s.gone))
        return missing

    def merge(self, source: DataFrame, spec: MergeSpec, small: bool = False, within: Sequence[tuple] | None = None, **properties: str) -> State:
        """Merges a source of one row per key. Files whose keys lie outside of all the source's are kept as they are.

        Up to MOST_KEYS keys of the source are held against the files' bounds; a clustered table, whose files are ranges of
        keys, then rewrites no more files than there are keys. Rows of the source that meet no file become new ones. Of a larger
        source, ``within`` (bounds, all of whose keys that aren't null lie in one of them) tells which files it may meet.
        """
        s = self.state()
        source = aligned(source, s.schema)
        touched, kept = self._touched(s, source, spec, within)
        merged = (merge_small_source if small else merge)(self._files(s, touched), source, spec)
        left = {_folder(f) for f in kept}
        gone = {folder: list(names) for folder, names in s.gone.items() if folder in left}
        for f in touched:
            if _folder(f) in left:
                gone.setdefault(_folder(f), []).append(f["path"].rsplit("/", 1)[1])
        return self._commit(State(s.version + 1, s.schema, [*kept, *self._write(merged)], s.properties | properties, gone))

    def _touched(self, s: State, source: DataFrame, spec: MergeSpec, within: Sequence[tuple] | None = None) -> tuple[list[dict], list[dict]]:
        """Files that may hold a key of the source, and the others."""
        if spec.key != self.key or any("low" not in f for f in s.files):
            return s.files, []
        if within is not None:
            near = lambda f: f["low"] is not None and any(low <= f["high"] and f["low"] <= high for low, high in within)
            return [f for f in s.files if near(f)], [f for f in s.files if not near(f)]
        # bounded: a larger source meets nearly every file anyway
        keys = sorted(r[0] for r in source.select(self.key).where(F.col(self.key).isNotNull()).limit(MOST_KEYS + 1).collect())
        if len(keys) > MOST_KEYS:
            return s.files, []
        meets = lambda f: f["low"] is not None and bisect.bisect_left(keys, f["low"]) < bisect.bisect_right(keys, f["high"])
        return [f for f in s.files if meets(f)], [f for f in s.files if not meets(f)]

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    # statistics and maintenance

    def stats(self) -> dict[str, int]:
        """Rows, bytes, files and folders of the current version, from its metadata."""
        files = self.state().files
        return {"rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files), "files": len(files), "partitions": len({f["path"].rsplit("/", 1)[0] for f in files})}

    def column_bytes(self) -> DataFrame:
        """(name, bytes): each column's bytes as text of its values, for estimates of row sizes. One pass."""
        df = self.read()
        sums = df.agg(*(F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for c in df.columns))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("bytes")) for c in df.columns))).alias("x")).select("x.*")

    def optimize(self, target_bytes: int = 128 << 20) -> None:
        """Rewrites the rows into files of about the target size."""
        s = self.state()
        n = max(1, round(sum(f["bytes"] for f in s.files) / target_bytes))
        self._commit(State(s.version + 1, s.schema, self._write_compact(self.read(), n, sum(f["rows"] for f in s.files)), s.properties))

    def _write_compact(self, df: DataFrame, files: int, rows: int) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        df = df.repartitionByRange(files, self.key) if self.clustered and self.key in df.columns else df.repartition(files)
        self._writer(sorted_for_write(df, self.sorted_by) if self.sorted_by else df, max(1, -(-rows // files))).save(f"{self.path}/{folder}")
        return self._described(folder, df.schema)

    def expire_versions(self, older_than_seconds: float, keep: int = 1) -> list[int]:
        """Forgets old versions but for the last ``keep``; their data goes with remove_orphans()."""
        gone = []
        for v in self._versions()[: -max(1, keep)]:
            where = self._path(f"{self.path}/_meta/{v:09d}.json")
            if self._fs.getFileStatus(where).getModificationTime() / 1000 <= time.time() - older_than_seconds:
                self._fs.delete(where, False)
                gone.append(v)
        return gone

    def remove_orphans(self, older_than_seconds: float = 86_400) -> list[str]:
        """Deletes data folders of which no version has a file; young ones may be a writer's that has not committed yet."""
        used = {f["path"].rsplit("/", 1)[0] for v in self._versions() for f in self.state(v).files}
        where, gone = self._path(f"{self.path}/data"), []
        for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
            name = f"data/{s.getPath().getName()}"
            if name not in used and s.getModificationTime() / 1000 <= time.time() - older_than_seconds:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone

    def analyze(self, columns: Sequence[str] | None = None) -> dict[str, dict]:
        """Values that aren't null, distinct values (estimated), least and greatest value of columns; kept as a property."""
        df = self.read()
        names = list(columns or df.columns)
        wide = (T.StructType, T.ArrayType, T.MapType, T.VariantType, T.BinaryType)
        bound = lambda f, c: f(c).cast("string") if not isinstance(df.schema[c].dataType, wide) else F.lit(None).cast("string")
        row = df.agg(*(x for c in names for x in (F.count(c).alias(f"n_{c}"), F.approx_count_distinct(F.col(c).cast("string")).alias(f"d_{c}"), bound(F.min, c).alias(f"a_{c}"), bound(F.max, c).alias(f"z_{c}")))).first()
        found = {c: {"values": row[f"n_{c}"], "distinct": row[f"d_{c}"], "least": row[f"a_{c}"], "greatest": row[f"z_{c}"]} for c in names}
        self.set_properties(statistics=json.dumps(found))
        return found


def _folder(file: Mapping) -> str:
    return file["path"].rsplit("/", 1)[0]


def drop_by_prefix(spark: SparkSession, folder: str, prefix: str, parallel: int = 8) -> list[str]:
    """Drops the tables below a folder whose names begin with the prefix, several at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith(prefix)]
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(lambda p: fs.delete(p, True), found))
    return sorted(p.getName() for p in found)
