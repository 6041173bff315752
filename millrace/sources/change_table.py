"""Change-tracking tables: changes joined to the current rows, full scans in the same shape, and shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import MERGE_KEY, hashed_key, normalize_names

VERSION, OPERATION, TRACKED = "SYS_CHANGE_VERSION", "SYS_CHANGE_OPERATION", "ChangeTrackingVersion"


def jdbc_options(url: str, query: str, fetch_size: int = 1000, split: tuple[str, object, object, int] | None = None, **more: str) -> dict[str, str]:
    """Options of a read. ``split`` (column, lowest, highest, parts) reads parts side by side; outer parts are open, so no row is lost."""
    out = {"url": url, "fetchsize": str(fetch_size), **more}
    if split is None:
        return out | {"query": query}
    column, low, high, parts = split
    return out | {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def jdbc_reader(spark: SparkSession, url: str, query: str, fetch_size: int = 1000, split: tuple[str, object, object, int] | None = None, **more: str) -> DataFrame:
    """A query against the source database; needs its driver on the class path. Column names lose what isn't fit for one."""
    return normalize_names(spark.read.format("jdbc").options(**jdbc_options(url, query, fetch_size, split, **more)).load())


def jdbc_split(spark: SparkSession, url: str, query: str, column: str, parts: int, **more: str) -> tuple[str, object, object, int] | None:
    """The split of a query by the least and greatest value of a column; None for a query without rows."""
    low, high = jdbc_reader(spark, url, f"SELECT min({column}) AS low, max({column}) AS high FROM ({query}) b", **more).first()
    return None if low is None else (column, low, high, parts)


def _columns(base: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in base.columns if c not in keys and c not in (VERSION, OPERATION)]


def changes_since(base: DataFrame, changes: DataFrame, keys: Sequence[str], after: int, until: int | None = None) -> DataFrame:
    """Changes with versions in (after, until], joined to the current rows; deleted rows have only their keys.

    ``changes`` has the keys, VERSION and OPERATION. The version bounds reach the changes' scan.
    """
    ct = changes.where(F.col(VERSION) > after)
    if until is not None:
        ct = ct.where(F.col(VERSION) <= until)
    ct, tq = ct.alias("ct"), base.alias("tq")
    on = [F.col(f"tq.`{k}`") == F.col(f"ct.`{k}`") for k in keys]
    own = [F.col(f"ct.`{k}`") for k in keys]
    return tq.join(ct, on, "right").select(*own, F.col(f"ct.{VERSION}").cast("long").alias(VERSION), F.col(f"ct.{OPERATION}"), *(F.col(f"tq.`{c}`") for c in _columns(base, keys)), F.lit(after).cast("long").alias(TRACKED), hashed_key(*own).alias(MERGE_KEY))


def as_changes(base: DataFrame, keys: Sequence[str], version: int = 0) -> DataFrame:
    """All rows as inserts of version 0, in the shape of changes_since()."""
    return base.select(*(F.col(k) for k in keys), F.lit(0).cast("long").alias(VERSION), F.lit("I").alias(OPERATION), *(F.col(c) for c in _columns(base, keys)), F.lit(version).cast("long").alias(TRACKED), hashed_key(*keys).alias(MERGE_KEY))


def shard_of(keys: Sequence[str], shards: int) -> Column:
    """The shard of a row: shards are disjoint and cover the table."""
    return F.pmod(F.xxhash64(*keys), F.lit(shards))


def column_summaries(columns: DataFrame, constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """(name, is_primary_key) in the order of the table's columns, of tables that have a primary key."""
    c, t, k = columns.alias("c"), constraints.where("constraint_type = 'PRIMARY KEY'").alias("t"), key_columns.alias("k")
    joined = c.join(t, "table_name", "left").join(k, (F.col("t.constraint_name") == F.col("k.constraint_name")) & (F.col("c.column_name") == F.col("k.key_column")), "left")
    return joined.where("t.constraint_name IS NOT NULL").orderBy("c.ordinal").select(F.col("c.column_name").alias("name"), F.col("k.key_column").isNotNull().alias("is_primary_key"))


def like_prefix(column: str, prefix: str) -> Column:
    """Names that begin with a prefix, whose ``_`` and ``%`` stand for themselves."""
    escaped = prefix.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")
    return F.like(F.col(column), F.lit(escaped + "%"), F.lit("\\"))


def in_partitions(values: Mapping[str, Sequence]) -> Column:
    out = F.lit(True)
    for c, v in values.items():
        out = out & F.col(c).isin(*v)
    return out
