"""What a stream takes at a time: fixed shapes, shapes by free memory, chunks of a changeset and a throttle."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sizing import Shape, is_outdated, memory_bound_shape, row_bytes, static_shape

ESTIMATES = "shape-estimates"


@dataclass
class Throttle:
    """Keeps the average at ``rate`` rows in ``period``, with bursts of up to ``burst`` rows."""

    rate: int
    period: timedelta
    burst: int
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.monotonic
    _held: float = field(default=0.0, init=False)
    _at: float | None = field(default=None, init=False)

    def take(self, rows: int) -> float:
        """Waits until so many rows may go, and returns for how long."""
        speed, now = self.rate / max(1e-9, self.period.total_seconds()), self.now()
        self._held = self.burst if self._at is None else min(self.burst, self._held + (now - self._at) * speed)
        self._at, self._held = now, self._held - rows
        wait = max(0.0, -self._held / speed)
        if wait:
            self.sleep(wait)
        return wait


def chunks(df: DataFrame, key: str, rows: int, most: int) -> Iterator[DataFrame]:
    """The rows in parts of about ``most``, all of a key in one part."""
    n = max(1, -(-rows // max(1, most)))
    if n == 1:
        yield df
        return
    for k in range(n):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def free_bytes(spark: SparkSession) -> int:
    """Memory for storage and execution that is free on all executors."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    found, values = 0, status.valuesIterator()
    while values.hasNext():
        found += values.next()._2()
    return int(found)


def gc_share(spark: SparkSession) -> float:
    """The part of its time that the driver's JVM has spent on collecting garbage."""
    management = spark._jvm.java.lang.management.ManagementFactory
    spent = sum(max(0, b.getCollectionTime()) for b in management.getGarbageCollectorMXBeans())
    return spent / max(1, management.getRuntimeMXBean().getUptime())


@dataclass
class Shaper:
    """``kind`` static: the advice as it is. memoryBound: by the target's size and schema, estimates kept in its properties."""

    kind: str
    advised: Shape
    most_age_seconds: float = 3600
    cutoff: float = 0.5
    now: Callable[[], float] = time.time

    def shape(self, table) -> Shape:
        if self.kind == "static":
            return static_shape(self.advised.chunk, self.advised.rate, self.advised.burst)
        e = self.estimates(table)
        per_partition = e["rows"] // e["partitions"] if e["partitions"] > 1 else None
        return memory_bound_shape(free_bytes(table.spark), e["row_bytes"], self.advised, self.cutoff, gc_share(table.spark), per_partition)

    def estimates(self, table) -> dict:
        kept = table.properties().get(ESTIMATES)
        found = json.loads(kept) if kept else None
        if found is None or is_outdated(self.now() - found["at"], self.most_age_seconds):
            stats, schema = table.stats(), table.schema()
            text = {r.name: r.bytes for r in table.column_bytes().collect()} if stats["rows"] else {}
            strings = [text.get(f.name, 0) for f in schema if f.dataType.typeName() == "string"]
            chars = max(1, round(sum(strings) / len(strings) / stats["rows"])) if strings and stats["rows"] else 10
            found = {"rows": stats["rows"], "bytes": stats["bytes"], "partitions": stats["partitions"], "row_bytes": row_bytes(schema, chars), "at": self.now()}
            table.set_properties(**{ESTIMATES: json.dumps(found)})
        return found
