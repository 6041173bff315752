"""Folder-per-batch CSV with a schema manifest: listing, validity, typing and order of files."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import MERGE_KEY, id_key
from millrace.operators.schema import manifest_schema, union_by_name

_FOLDER = re.compile(r"^(\d{4}-\d\d-\d\dT\d\d\.\d\d\.\d\d)(Z|[+-]\d\d(?::?\d\d)?)$")


def folder_time(name: str) -> datetime | None:
    """The time in a folder's name, or None where the name is none."""
    m = _FOLDER.match(name.strip("/"))
    if not m:
        return None
    zone = "+0000" if m[2] == "Z" else (m[2].replace(":", "") + "00")[:5]
    return datetime.strptime(m[1] + zone, "%Y-%m-%dT%H.%M.%S%z").astimezone(timezone.utc)


def folder_time_column(name: Column) -> Column:
    return F.try_to_timestamp(name, F.lit("yyyy-MM-dd'T'HH.mm.ssX"))


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _text(spark: SparkSession, file: str) -> str:
    """A small file, read on the driver without a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Up to so many hours are listed by their prefixes; beyond, the whole folder is.
MOST_PREFIXES = 240


def _timed_names(spark: SparkSession, root: str, start: datetime | None, end: datetime | None) -> list[str]:
    """Names in the root that may be of the time range, by hour prefixes where the range is short."""
    if start is None:
        return _names(spark, root)
    last = (end or datetime.now(timezone.utc)) + timedelta(hours=1)
    # a folder's own zone may differ by up to 14 hours from UTC
    first = start.astimezone(timezone.utc) - timedelta(hours=14)
    hours = int((last.astimezone(timezone.utc) + timedelta(hours=14) - first).total_seconds() // 3600) + 1
    if hours > MOST_PREFIXES:
        return _names(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for k in range(hours):
        prefix = (first + timedelta(hours=k)).strftime("%Y-%m-%dT%H")
        found += [s.getPath().getName() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{prefix}*"))]
    return sorted(set(found))


def batch_folders(spark: SparkSession, root: str, start: datetime | None = None, end: datetime | None = None) -> list[str]:
    """Folders named by a time in [start, end), with a manifest, in order of time; the folder in progress doesn't count.

    The folder in progress is named in Changelog/changelog.info.
    """
    if end is None and "changelog.info" in _names(spark, f"{root}/Changelog"):
        end = folder_time(_text(spark, f"{root}/Changelog/changelog.info").strip())
    timed = [(t, n) for n in _timed_names(spark, root, start, end) if (t := folder_time(n)) and (start is None or t >= start) and (end is None or t < end)]
    return [n for _, n in sorted(timed) if "model.json" in _names(spark, f"{root}/{n}")]


def closest_folder(folders: list[str], moment: datetime) -> str:
    for f in folders:
        if folder_time(f) >= moment:
            return f
    raise ValueError(f"no batch at {moment} or later")


def typed_value(raw: Column, name: str, kind: T.DataType) -> Column:
    """A CSV field as its manifest's type; the empty field is null. Times have formats of their own by column."""
    raw = F.when(raw != "", raw)
    if isinstance(kind, T.TimestampNTZType):
        if name in ("SinkCreatedOn", "SinkModifiedOn"):
            return F.try_to_timestamp(raw, F.lit("M/d/yyyy h:mm:ss a")).cast("timestamp_ntz")
        if name == "CreatedOn":
            return raw.cast("timestamp").cast("timestamp_ntz")
        return F.regexp_replace(raw, "Z$", "").cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        plain = F.regexp_replace(F.trim(raw), r"(\.\d{6})\d+", "$1")
        return F.when(plain.rlike(r"(Z|[+-]\d\d:?\d\d)$"), plain.cast("timestamp")).otherwise(F.to_utc_timestamp(plain.cast("timestamp"), F.current_timezone()).cast("timestamp"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.VariantType)):
        raise ValueError(f"column {name}: nested types can't be read from CSV")
    return raw.cast(kind)


def csv_frame(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Headerless CSV with quotes and line feeds within them, which are removed; a line with too many or few fields is an error."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("header", "false").option("multiLine", "true").option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(files)
    ordered = raw.select(*(typed_value(F.regexp_replace(F.col(f"`{f.name}`"), "\n", ""), f.name, f.dataType).alias(f.name) for f in schema), F.col("_metadata.file_path").alias("__file"))
    folder = F.url_decode(F.element_at(F.split("__file", "/"), -3))
    return ordered.withColumn("batch_folder", folder).withColumn("file_order", F.regexp_extract("__file", r"(\d+)\.csv$", 1).cast("int")).drop("__file")


def _numbered(spark: SparkSession, root: str, folder: str, entity: str) -> list[str]:
    """A batch's files of an entity; names that are no numbers are an error, as their order would be lost."""
    files = [n for n in _names(spark, f"{root}/{folder}/{entity}") if n.endswith(".csv")]
    for n in files:
        if not n[:-4].isdigit():
            raise ValueError(f"{folder}/{entity}/{n}: not a numbered file")
    return [f"{root}/{folder}/{entity}/{n}" for n in files]


def entity_schema(spark: SparkSession, root: str, folder: str, entity: str) -> T.StructType:
    return manifest_schema(_text(spark, f"{root}/{folder}/model.json"), entity)


def of_folders(spark: SparkSession, root: str, names: list[str], entity: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The rows of batches with the merge key, each with its folder; one read per distinct manifest, not per folder.

    file_order puts tombstones (the lowest file) last. Columns that a batch lacks are null. Without files: no rows of the
    given schema, or None.
    """
    by_schema: dict[str, tuple[T.StructType, list[str]]] = {}
    for f in names:
        if files := _numbered(spark, root, f, entity):
            own = entity_schema(spark, root, f, entity)
            by_schema.setdefault(own.json(), (own, []))[1].extend(files)
    frames = [csv_frame(spark, files, own) for own, files in by_schema.values()]
    if not frames:
        if schema is None:
            return None
        frames = [spark.createDataFrame([], T.StructType([*schema, T.StructField("batch_folder", T.StringType()), T.StructField("file_order", T.IntegerType())]))]
    df = union_by_name(frames)
    return df.withColumn(MERGE_KEY, id_key(df))


def batch_rows(spark: SparkSession, root: str, folder: str, entity: str) -> DataFrame | None:
    """One batch's rows; None without files."""
    return of_folders(spark, root, [folder], entity)


def changes(spark: SparkSession, root: str, entity: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame | None:
    """All batches' rows in one frame, by name, each with its folder; None without rows."""
    return of_folders(spark, root, batch_folders(spark, root, start, end), entity)


def parse_line(line: str, fields: int) -> list[str | None]:
    """One CSV line: an empty field is None; quotes that don't close or another number of fields are errors."""
    out: list[str | None] = []
    value, quoted, was_quoted, k = [], False, False, 0
    while k <= len(line):
        c = line[k] if k < len(line) else None
        if quoted:
            if c is None:
                raise ValueError("quotes don't close")
            if c == '"':
                quoted = False
            else:
                value.append(c)
        elif c == '"' and not value and not was_quoted:
            quoted = was_quoted = True
        elif c == '"':
            raise ValueError("a quote within a field")
        elif c in (",", None):
            out.append("".join(value) or None)
            value, was_quoted = [], False
        else:
            value.append(c)
        k += 1
    if len(out) != fields:
        raise ValueError(f"{len(out)} fields instead of {fields}")
    return out
