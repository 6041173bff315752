"""File drops: listing by creation time, Parquet and JSON lines, shards of files."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json_rows import exploded_rows, root_rows
from millrace.functions.keys import MERGE_KEY, blob_key
from millrace.functions.sizing import files_per_shard
from millrace.operators.reduce import average_size
from millrace.operators.select import FieldRule, select_fields


def split_path(path: str) -> tuple[str, str, str]:
    """(scheme, container, key) of s3a://bucket/key, abfss://container@account/path or file:/path."""
    scheme, found, rest = path.partition("://")
    if not found:
        return "file", "", path
    container, _, key = rest.partition("/")
    return scheme, container, key


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, created (epoch seconds) and bytes of files; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("name"), F.unix_seconds("modificationTime").alias("created"), F.col("length").alias("bytes"))


def in_time_range(files: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Files created in [start, end] (no end: all later ones); an unknown time is the epoch."""
    created = F.coalesce(F.col("created"), F.lit(0))
    out = files.where(created >= start)
    return out if end is None else out.where(created <= end)


def latest_created(files: DataFrame, most: int | None = None) -> DataFrame:
    """One row: the highest creation time, of the ``most`` earliest files if given; 0 without files."""
    if most is not None:
        files = files.orderBy("created", "name").limit(most)
    return files.agg(F.coalesce(F.max("created"), F.lit(0)).alias("created"))


def file_shards(files: DataFrame, sample: int = 1000) -> tuple[int, int]:
    """(files per shard, shards); sizes are averaged over the ``sample`` latest files."""
    n = files.count()
    average = average_size(files, sample).first()[0]
    per = files_per_shard(average)
    return per, -(-n // per)


def pack_names(names: Sequence[str]) -> str:
    return base64.urlsafe_b64encode(gzip.compress("\n".join(names).encode(), mtime=0)).decode()


def unpack_names(packed: str) -> list[str]:
    text = gzip.decompress(base64.urlsafe_b64decode(packed)).decode()
    return text.split("\n") if text else []


def _versioned(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(MERGE_KEY, blob_key(df, list(keys)))


def _ruled(df: DataFrame, keys: Sequence[str], rule: FieldRule | None) -> DataFrame:
    """The columns that a rule at the source takes; it may not leave out keys."""
    return select_fields(df, rule.checked_keys(keys), keep_essential=True) if rule else df


def _created():
    return F.coalesce(F.unix_seconds(F.col("_metadata.file_modification_time")), F.lit(0)).alias("createdon")


def parquet_rows(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str], start: int = 0, end: int | None = None, schema: T.StructType | None = None, mapping: Mapping[str, str] | None = None, rule: FieldRule | None = None) -> DataFrame:
    """Rows of files created in [start, end], with createdon and the merge key; columns go by name.

    ``mapping`` gives columns of the files the names they have in the table; ``rule`` is the source's selection of fields.

    The time bounds are on file metadata, so files outside them aren't opened.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema else reader.option("mergeSchema", "true")).parquet(*([path] if isinstance(path, str) else path))
    df = df.where(F.unix_seconds(F.col("_metadata.file_modification_time")) >= start)
    if end is not None:
        df = df.where(F.unix_seconds(F.col("_metadata.file_modification_time")) <= end)
    created = df.select("*", _created())
    return _versioned(_ruled(created.withColumnsRenamed(dict(mapping or {})), keys, _with_version(rule)), keys)


def _with_version(rule: FieldRule | None) -> FieldRule | None:
    """A rule that takes the row version whatever it names."""
    if rule is None or rule.kind != "include":
        return rule
    return FieldRule("include", (*rule.fields, "createdon"), rule.essential, rule.server_side)


def json_rows(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str], schema: T.StructType, pointer: str = "", arrays: Sequence[tuple[str, Mapping[str, str]]] = (), start: int = 0, end: int | None = None, rule: FieldRule | None = None) -> DataFrame:
    """Rows of JSON-lines files (compressed ones by their extension): root by pointer, arrays exploded, fields typed."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path)).select("value", _created())
    lines = lines.where(F.col("createdon") >= start)
    if end is not None:
        lines = lines.where(F.col("createdon") <= end)
    rooted = root_rows(lines.where(F.trim("value") != ""), "value", pointer)
    rows = exploded_rows(rooted.drop("value"), "root", schema, arrays)
    return _versioned(_ruled(rows.select(*[f.name for f in schema], "createdon"), keys, _with_version(rule)), keys)


def csv_rows(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str], schema: T.StructType, rule: FieldRule | None = None) -> DataFrame:
    """Rows of CSV files with a header line."""
    return _versioned(_ruled(spark.read.schema(schema).option("header", "true").option("multiLine", "true").csv(path if isinstance(path, str) else list(path)).select("*", _created()), keys, _with_version(rule)), keys)
