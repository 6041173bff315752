"""Shard and chunk sizes: plain functions for the driver and column forms of those that run over tables."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 10 << 30
MOST_FILES_PER_SHARD = 10_000
DEFAULT_FILE_BYTES = 100 << 20


def cost_shard_size(cost: float) -> float:
    """Megabytes of a shard by the cost of reading: 1 + ln(cost)^3, 1 if that is negative, 1000 at most."""
    x = 1 + math.log(cost) ** 3
    return 1.0 if x < 0 else min(x, 1000.0)


def cost_shard_size_column(cost: Column) -> Column:
    x = 1 + F.pow(F.log(cost), 3)
    return F.when(x < 0, 1.0).when(x > 1000, 1000.0).otherwise(x)


def shard_count(pages: int, shard_megabytes: float) -> int:
    """Shards of a table of 8 kB pages; at least one."""
    return max(1, math.ceil(pages * 8 / 1024 / shard_megabytes))


def rows_per_shard(rows: int, shards: int) -> int:
    return math.ceil(rows / max(1, shards))


def files_per_shard(average_bytes: float | None) -> int:
    """Files for about 10 GiB; an unknown or empty listing counts as files of 100 MiB."""
    return int(min(SHARD_BYTES / (average_bytes or DEFAULT_FILE_BYTES) + 1, MOST_FILES_PER_SHARD))


def scaled_sigmoid(value: float, highest: float, steepness: float = 1.0) -> float:
    return highest * (2 / (1 + math.exp(-steepness * value)) - 1)


def scaled_sigmoid_column(value: Column, highest: float, steepness: float = 1.0) -> Column:
    return highest * (2 / (1 + F.exp(-steepness * value)) - 1)


def jittered_seconds(base: float, variance: float, rng: random.Random) -> float:
    return base + base * variance * (2 * rng.random() - 1)


_ROW, _CELL = 28, 64
_FIXED = {T.LongType: 8, T.IntegerType: 4, T.ShortType: 4, T.BooleanType: 1, T.DateType: 8, T.TimestampType: 16, T.TimestampNTZType: 12, T.DoubleType: 8, T.FloatType: 4, T.DecimalType: 16}


def row_bytes(schema: T.StructType, string_chars: int = 10) -> int:
    """An estimate of a row's bytes in memory: 28, and 64 and the value's size per cell; strings and binaries by a typical length."""

    def value(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return sum(_CELL + value(f.dataType) for f in kind)
        if isinstance(kind, T.ArrayType):
            return 16 + value(kind.elementType)
        return _FIXED.get(type(kind), 40 + 2 * string_chars)

    return _ROW + sum(_CELL + value(f.dataType) for f in schema)


@dataclass(frozen=True)
class Shape:
    """What a stream takes at a time."""

    chunk: int
    rate: int
    burst: int


def static_shape(chunk: int, rate: int, burst: int) -> Shape:
    return Shape(chunk, rate, burst)


def memory_bound_shape(free_bytes: int, bytes_per_row: float, advised: Shape, cutoff: float = 0.5, gc_share: float = 0.0, partition_rows: int | None = None) -> Shape:
    """A chunk of half the rows that fit in the free part, capped by the advice and by half a partition; the rate falls with GC."""
    chunk = int(free_bytes * cutoff / (bytes_per_row + 1) / 2)
    chunk = max(1, min(chunk, advised.chunk, *([max(1, partition_rows // 2)] if partition_rows else [])))
    rate = max(1, int(advised.rate * (1 - min(max(gc_share, 0.0), 0.99))))
    return Shape(chunk, min(rate, advised.rate), max(chunk // 10, min(advised.burst, chunk), 1))


def is_outdated(age_seconds: float, most_seconds: float) -> bool:
    return age_seconds > most_seconds
