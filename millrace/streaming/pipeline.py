"""Continuous and bounded ingestion: select, reduce, migrate, merge, watermark, maintain."""

from __future__ import annotations

import random
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.sizing import jittered_seconds
from millrace.operators.merge import MergeSpec
from millrace.operators.reduce import has_rows, latest_per_key
from millrace.operators.select import FieldRule, select_fields
from millrace.operators.table import MOST_KEYS, VersionedTable
from millrace.streaming.maintenance import Maintenance
from millrace.streaming.metrics import Metrics
from millrace.streaming.throughput import Shaper, Throttle, chunks
from millrace.streaming.watermark import PROPERTY, Watermark, current

BATCH = "last-batch"


@dataclass
class Pipeline:
    """How changesets become the target: the merge, the version column and its ties, the fields, the upkeep.

    With ``staging`` (a path that names of tables are added to) the reduced changeset is written there first, so that it is
    computed once, and its table is disposed of after the merge. ``shaper`` cuts it into chunks, ``throttle`` spaces them. Chunks
    of a staged changeset are ranges of its keys, so that each reads its own files and, of a clustered target, rewrites those of its range.
    """

    target: VersionedTable
    spec: MergeSpec
    version: str
    ties: tuple[str, ...] = ()
    rule: FieldRule = field(default_factory=FieldRule)
    migrates: bool = True
    maintenance: Maintenance | None = None
    small_source: bool = False
    staging: str | None = None
    shaper: Shaper | None = None
    throttle: Throttle | None = None
    metrics: Metrics = field(default_factory=Metrics)

    def apply(self, changes: DataFrame, watermark: Watermark | None = None, batch: int | None = None) -> bool:
        """Merges one changeset and commits its watermark and batch number with it. False if there was nothing to do.

        A batch that was committed before is left out, so a restarted query may offer it again. An empty changeset only
        moves the watermark. Of several chunks, the last one's commit has the watermark: a run that is cut off before it
        merges the others again, which changes nothing.
        """
        done = self.target.properties()
        if batch is not None and int(done.get(BATCH, -1)) >= batch:
            return False
        properties = ({PROPERTY: watermark.to_json()} if watermark else {}) | ({BATCH: str(batch)} if batch is not None else {})
        reduced = latest_per_key(select_fields(changes, self.rule, keep_essential=True), self.spec.key, self.version, self.ties)
        staged = VersionedTable(reduced.sparkSession, f"{self.staging}{uuid.uuid4().hex}", key=self.spec.key, clustered=True) if self.staging else None
        if staged and self.shaper:
            staged.rows_per_file = min(staged.file_rows(reduced.schema), self.shaper.advised.chunk)
        try:
            if staged:
                with self.metrics.timed("batch.stage_duration"):
                    staged.overwrite(reduced)
                n, reduced = staged.stats()["rows"], staged.read()
                self.metrics.count("rows.staged", n)
            else:
                n = None if has_rows(reduced) else 0
            if n == 0:
                if properties:
                    self.target.set_properties(**properties)
                return False
            if self.migrates:
                self.target.migrate(reduced.schema)
            shape = self.shaper.shape(self.target) if self.shaper and n else None
            parts = self._parts(staged, reduced, n, shape.chunk) if shape else [(reduced, n, None)]
            for k, (part, rows, within) in enumerate(parts):
                if self.throttle and n:
                    self.metrics.gauge("batch.throttled_duration", 1000 * self.throttle.take(rows))
                with self.metrics.timed("batch.merge_duration"):
                    self.target.merge(part, self.spec, self.small_source, within, **(properties if k == len(parts) - 1 else {}))
            if shape:
                self.metrics.gauge("rows.chunk_size", shape.chunk)
        finally:
            if staged:
                with self.metrics.timed("batch.dispose_duration"):
                    staged.drop()
        if watermark:
            self.metrics.count("watermark.updates", 1)
            self.metrics.gauge("watermark.age", watermark.age())
        if self.maintenance:
            self.maintenance.after_batch(self.target)
        return True


    def _parts(self, staged: VersionedTable | None, reduced: DataFrame, n: int, most: int) -> list[tuple[DataFrame, int, list[tuple] | None]]:
        """Chunks with their rows and, of more keys than merge() looks up, their bounds: by ranges of the staged keys, else by hashes."""
        found = staged.ranges(most) if staged else None
        parts = []
        for df, rows, bounds in found if found is not None else [(reduced, n, None)]:
            cut = list(chunks(df, self.spec.key, rows, most))
            parts += [(c, rows // len(cut), bounds if bounds is not None and rows // len(cut) > MOST_KEYS else None) for c in cut]
        return parts


def run_files(pipeline: Pipeline, stream: DataFrame, checkpoint: str, once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """A streaming source into the target; ``once`` takes what is there, in micro-batches of the source's rate limit, and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, number: pipeline.apply(df, batch=number) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


@dataclass
class ChangeSource:
    """A source that is asked for its position and for changes up to one."""

    latest: Callable[[Watermark | None], Watermark]
    limited: Callable[[Watermark | None, Watermark], Watermark]
    read: Callable[[Watermark | None, Watermark], DataFrame]
    has_changes: Callable[[Watermark | None], bool] = lambda _: True


def poll_once(pipeline: Pipeline, source: ChangeSource) -> Watermark | None:
    """One step of change capture: the changes after the target's watermark, up to the range limit; None if there are none.

    Where the source is ahead but reports no changes, the watermark is moved on.
    """
    before = current(pipeline.target)
    latest = source.latest(before)
    if before is not None and latest <= before:
        return None
    upto = source.limited(before, latest)
    if before is not None and upto <= before:
        return None
    if source.has_changes(before):
        pipeline.apply(source.read(before, upto), upto)
    else:
        pipeline.target.set_properties(**{PROPERTY: upto.to_json()})
    return upto


def run_polling(pipeline: Pipeline, source: ChangeSource, stop: threading.Event, seconds: float = 10, variance: float = 0.1, seed: int = 0, until_caught_up: bool = False) -> int:
    """Change capture until ``stop`` is set, or until there is nothing new; catches up without waiting. Returns the number of changesets."""
    rng, n = random.Random(seed), 0
    while not stop.is_set():
        if poll_once(pipeline, source) is None:
            if until_caught_up:
                break
            stop.wait(jittered_seconds(seconds, variance, rng))
        else:
            n += 1
    return n


def run_backfill_merge(pipeline: Pipeline, source: ChangeSource, start: Watermark | None) -> Watermark:
    """Everything from a start to the current position as one changeset, without upkeep."""
    upto = source.latest(start)
    replace(pipeline, maintenance=None, shaper=None, throttle=None).apply(source.read(start, upto), upto)
    return upto


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None, **options: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)
