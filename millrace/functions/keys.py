"""Merge keys, names and time conversions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE_KEY = "merge_key"


def hashed_key(*keys: str | Column, most_chars: int | None = 128) -> Column:
    """SHA-256, in lower-case hex, of the keys' text joined by ``#`` in UTF-16LE; null if a key is null.

    For compatibility with keys made elsewhere, a key counts up to 128 characters: rows that differ only beyond those are
    one row to a merge. ``most_chars=None`` takes keys whole.
    """
    text = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    cut = [F.substring(t, 1, most_chars) for t in text] if most_chars is not None else text
    joined = [cut[0]] + [x for c in cut[1:] for x in (F.lit("#"), c)]
    return F.sha2(F.encode(F.concat(*joined), "UTF-16LE"), 256)


def blob_key(df: DataFrame, keys: list[str], separator: str = "") -> Column:
    """Base64 of the SHA-256 of the keys' lower-cased text; a key that isn't there is an error.

    For compatibility with keys made elsewhere, they're joined without a separator, so ("1", "23") and ("12", "3") have
    one key; a ``separator`` that no key has tells them apart.
    """
    known = {c.lower() for c in df.columns}
    missing = [k for k in keys if k.lower() not in known]
    if missing or not keys:
        raise ValueError(f"primary keys not found: {missing or 'none given'}")
    return F.base64(F.unhex(F.sha2(F.lower(F.concat_ws(separator, *(F.col(k).cast("string") for k in keys)) if separator else F.concat(*(F.col(k).cast("string") for k in keys))), 256)))


def id_key(df: DataFrame, name: str = "Id") -> Column:
    """A column, found by its name in any case, as text."""
    for c in df.columns:
        if c.lower() == name.lower():
            return F.col(c).cast("string")
    raise ValueError(f"no column {name}")


def with_version(df: DataFrame, epoch_seconds: Column | None, name: str = "createdon") -> DataFrame:
    """Adds the row version of file sources: the file's creation time in epoch seconds, 0 where unknown."""
    return df.withColumn(name, F.coalesce(epoch_seconds.cast("long") if epoch_seconds is not None else F.lit(None).cast("long"), F.lit(0).cast("long")))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\W+", "")


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names without characters other than letters, digits and ``_``."""
    return df.toDF(*(re.sub(r"\W+", "", c) for c in df.columns))


def shard_name(entity: Column) -> Column:
    """A name fit for a table: trailing slashes go, ``-.:/`` become ``_``, in lower case."""
    return F.lower(F.translate(F.regexp_replace(entity, "/+$", ""), "-.:/", "____"))


def epoch_seconds(micros: Column) -> Column:
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def epoch_micros(seconds: Column) -> Column:
    return F.unix_micros(F.timestamp_seconds(seconds))


def quoted_newlines_removed(line: Column) -> Column:
    """Line feeds within double-quoted stretches removed."""
    return F.regexp_replace(line, '\\n(?=[^"]*"(?:[^"]*"[^"]*")*[^"]*$)', "")


def hours_between(start: Column, end: Column) -> Column:
    """Hour prefixes from start to an hour after end, for pruning a listing of folders that are named by time."""
    hours = F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end) + F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return F.transform(hours, lambda h: F.date_format(h, "yyyy-MM-dd'T'HH"))
