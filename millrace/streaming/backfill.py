"""Sharded, resumable overwrite backfills.

The plan (end position and shards) is committed before any data moves. Each shard is staged in a table of its own, in
parallel; staged shards are combined one by one; at last the combined rows replace the target, together with the
watermark. A shard's state is a property of its table, so a run that was cut off goes on where it stopped: staged shards
aren't read again, a shard that was being combined is merged (its rows may be there already), combined ones are skipped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.sizing import shard_count
from millrace.operators.merge import MergeSpec, upsert
from millrace.operators.reduce import latest_per_key
from millrace.operators.table import VersionedTable, drop_by_prefix
from millrace.streaming.watermark import PROPERTY, Watermark

PLAN, PROCESSING = "backfill", "processing-state"
STAGED, COMBINING, COMBINED = "STAGED", "COMBINING", "COMBINED"


class OverwriteBackfill:
    """``read`` gives a shard's rows, ``finish`` what is committed of all (rows as they are, or the latest of each key)."""

    def __init__(
        self, spark: SparkSession, folder: str, target: VersionedTable, read: Callable[[str], DataFrame], finish: Callable[[DataFrame], DataFrame] = lambda df: df, spec: MergeSpec | None = None, parallel: int = 4, observe: Callable[[str, str], None] = lambda shard, state: None, version: str | None = None
    ) -> None:
        self.spark, self.folder, self.target, self.read, self.finish, self.spec, self.parallel, self.observe = spark, folder.rstrip("/"), target, read, finish, spec or upsert(), parallel, observe
        self.version = version

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{name}")

    def plan(self, shards: Sequence[str], end: Watermark) -> tuple[list[str], Watermark]:
        """The committed plan; an earlier run's plan is kept, with its shards and its end."""
        combine = self._table("combine")
        if combine.exists() and PLAN in combine.properties():
            found = json.loads(combine.properties()[PLAN])
            return found["shards"], Watermark.from_json(found["end"])
        return list(shards), end

    def run(self, shards: Sequence[str], end: Watermark) -> None:
        shards, end = self.plan(shards, end)
        combine = self._table("combine")
        if not combine.exists():
            schema = self.read(shards[0]).schema if shards else self.target.schema()
            combine.create(schema, properties={PLAN: json.dumps({"shards": shards, "end": end.to_json()})})
        with ThreadPoolExecutor(self.parallel) as pool:
            list(pool.map(self._stage, shards))
        for s in shards:
            self._combine(s, combine)
        self.target.overwrite(self.finish(combine.read()), **{PROPERTY: end.to_json()})

    def _stage(self, shard: str) -> None:
        table = self._table(shard_table(shard))
        if table.exists() and table.properties().get(PROCESSING):
            return
        rows = self.read(shard)
        table.create(rows.schema, replace=True)
        table.append(rows, **{PROCESSING: STAGED})
        self.observe(shard, STAGED)

    def _combine(self, shard: str, combine: VersionedTable) -> None:
        table = self._table(shard_table(shard))
        state = table.properties()[PROCESSING]
        if state == COMBINED:
            return
        rows = table.read()
        combine.migrate(rows.schema)
        if state == COMBINING:
            # its rows may be there already, all of them or none
            combine.merge(latest_per_key(rows, self.spec.key, self.version) if self.version else rows, self.spec)
        else:
            table.set_properties(**{PROCESSING: COMBINING})
            self.observe(shard, COMBINING)
            combine.append(rows)
        table.set_properties(**{PROCESSING: COMBINED})
        self.observe(shard, COMBINED)

    def clean_up(self) -> list[str]:
        return drop_by_prefix(self.spark, self.folder, "shard_") + drop_by_prefix(self.spark, self.folder, "combine")


def shard_table(shard: str) -> str:
    """A table's name for a shard, which may be a folder or the path of a list."""
    plain = re.sub(r"\W+", "_", shard)
    return f"shard_{plain}" if plain == shard else f"shard_{plain[-60:]}_{zlib.crc32(shard.encode()):08x}"


def sql_shards(pages: int, megabytes_per_shard: float) -> list[str]:
    return [str(k) for k in range(shard_count(pages, megabytes_per_shard))]


def grouped(names: Sequence[str], size: int) -> list[list[str]]:
    """Names in groups of at most ``size``, in order."""
    return [list(names[k : k + size]) for k in range(0, len(names), max(1, size))]
