"""One row per key, and lookups of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: str | Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the highest version of each key; nulls are the lowest version, null keys are a key of their own.

    ``ties`` order rows of equal version, so that the choice doesn't depend on the order of rows. The rank limit runs
    before the shuffle as well, so a hot key sends one row per partition.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [F.col(version).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in ties)]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest_live(df: DataFrame, keys, version: str, deleted: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Tombstones dropped first: a key whose newest row is a tombstone comes back with its newest live row."""
    return latest_per_key(df.where(~F.coalesce(deleted, F.lit(False))), keys, version, ties)


def latest_then_live(df: DataFrame, keys, version: str, deleted: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Tombstones dropped last: such a key is gone."""
    return latest_per_key(df.withColumn("__dead", F.coalesce(deleted, F.lit(False))), keys, version, ties).where("NOT __dead").drop("__dead")


def distinct_lowest(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def nth_version(df: DataFrame, version: str, after, until, n: int | None) -> DataFrame:
    """One row: the n-th distinct version in (after, until], the last if there are fewer, ``until`` if there is none."""
    within = df.where((F.col(version) > F.lit(after)) & (F.col(version) <= F.lit(until)))
    if n is not None:
        within = distinct_lowest(within, version, n)
    return within.agg(F.coalesce(F.max(version), F.lit(until)).alias(version))


def version_at(df: DataFrame, version: str, time: str, moment) -> DataFrame:
    """One row: the lowest version that was committed at the moment or later."""
    return df.where(F.col(time) >= F.lit(moment)).agg(F.min(version).alias(version))


def commit_time(df: DataFrame, version: str, time: str, value, default: Column | None = None) -> DataFrame:
    """One row: when a version was committed first; the default (now) if it is unknown."""
    return df.where(F.col(version) == F.lit(value)).agg(F.coalesce(F.min(time), default if default is not None else F.current_timestamp()).alias(time))


def first_at_or_after(df: DataFrame, column: str, moment, ties: Sequence[str] = ()) -> DataFrame:
    """The first row at the moment or later; ``ties`` decide between rows of one moment, else all other columns do."""
    return df.where(F.col(column) >= F.lit(moment)).orderBy(column, *(ties or [c for c in df.columns if c != column])).limit(1)


def has_rows(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def grouped_lists(df: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    """Values by key as sorted lists; with ``most``, in lists (column chunk, from 0) of at most so many, so that a hot key makes no long row."""
    if most is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
        return df.withColumn("chunk", F.floor(place / most).cast("long")).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(value)).alias(value))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value))


def sorted_for_write(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sortWithinPartitions(*(F.col(c).desc_nulls_last() for c in columns))


def highest(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in the order of a write: descending, nulls last, then by ``ties``."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)


def schema_tables(tables: DataFrame, schemas: DataFrame, key: str, table: str, schema: str) -> DataFrame:
    """Tables with the names of their schemas; tables of unknown schemas are left out."""
    return tables.join(schemas, key).select(table, schema)


def read_cost(df: DataFrame, io: str, cpu: str) -> DataFrame:
    """One row: the estimated cost of reading, the sum of both parts over all steps."""
    return df.agg(F.sum(F.col(io) + F.col(cpu)).alias("cost"))


def file_stats(files: DataFrame, by: str, records: str, size: str, partition: str) -> DataFrame:
    """Records, bytes and partitions of files, summed by a column."""
    return files.groupBy(by).agg(F.sum(records).alias("records"), F.sum(size).alias("size"), F.countDistinct(partition).alias("partitions"))


def average_size(files: DataFrame, sample: int = 1000, unknown: int = 100 << 20) -> DataFrame:
    """One row: the average bytes of the ``sample`` latest files, an unknown size counting as 100 MiB, and how many there were."""
    latest = files.orderBy(F.desc("created"), "name").limit(sample)
    return latest.agg(F.avg(F.coalesce("bytes", F.lit(unknown))).alias("average"), F.count("*").alias("files"))


def scalar(df: DataFrame):
    """The only value of a result of one row and one column, or None without rows; more are an error."""
    if len(df.columns) != 1:
        raise ValueError(f"{len(df.columns)} columns instead of one")
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0][0] if rows else None
