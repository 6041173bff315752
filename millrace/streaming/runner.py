"""From settings to a merged table: bootstrap, choice of the run, the run, clean-up and exit code."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json_rows import avro_schema
from millrace.functions.keys import MERGE_KEY
from millrace.functions.sizing import Shape, cost_shard_size
from millrace.operators import merge as m
from millrace.operators.merge import MergeSpec
from millrace.operators.reduce import latest_per_key, latest_then_live, nth_version, scalar
from millrace.operators.select import FieldRule, select_fields
from millrace.operators.table import VersionedTable
from millrace.sources import change_table as ct
from millrace.sources import files, folders
from millrace.sources.blobs import BlobStore, store_shards, stored_shard
from millrace.streaming.app import FatalError, Settings, bootstrap, choose_run, exit_code, finalise, retried
from millrace.streaming.backfill import OverwriteBackfill, grouped, sql_shards
from millrace.streaming.metrics import Metrics
from millrace.streaming.pipeline import ChangeSource, Pipeline, run_backfill_merge, run_polling
from millrace.streaming.throughput import Shaper, Throttle
from millrace.streaming.watermark import Watermark, current, file_watermark, folder_watermark, version_watermark

log = logging.getLogger(__name__)


@dataclass
class Source:
    """A kind of source: its columns, how it merges, its changes, and its shards for an overwrite."""

    schema: T.StructType
    spec: MergeSpec
    version: str
    changes: ChangeSource
    shards: Callable[[], Sequence[str]]
    read_shard: Callable[[str], DataFrame]
    finish: Callable[[DataFrame], DataFrame]
    ties: tuple[str, ...] = ()


def _now() -> datetime:
    return datetime.now(timezone.utc)


def change_source(spark: SparkSession, settings: Settings, staging: str) -> Source:
    """Change tracking over stored tables: ``table``, ``changes`` (keys, version, operation) and ``keys``; ``pages`` and ``readCost`` size the shards."""
    conf = settings.source
    base, keys = spark.read.parquet(conf["table"]), list(conf["keys"])
    settings.rule.checked_keys(keys)
    base = select_fields(base, FieldRule(settings.rule.kind, settings.rule.fields, tuple(keys)), keep_essential=True)
    tracked = lambda: spark.read.parquet(conf["changes"])
    shard_count = len(sql_shards(int(conf.get("pages", 1)), cost_shard_size(float(conf.get("readCost", 1.0)))))

    def latest(_: Watermark | None) -> Watermark:
        return version_watermark(scalar(tracked().agg(F.coalesce(F.max(ct.VERSION), F.lit(0)))), _now())

    def limited(before: Watermark | None, top: Watermark) -> Watermark:
        after = int(before.version) if before else -1
        return version_watermark(int(scalar(nth_version(tracked(), ct.VERSION, after, int(top.version), settings.range_limit))), _now())

    read = lambda before, upto: ct.changes_since(base, tracked(), keys, int(before.version) if before else -1, int(upto.version))
    changed = lambda before: not tracked().where(F.col(ct.VERSION) > (int(before.version) if before else -1)).limit(1).isEmpty()
    whole = ct.as_changes(base, keys)
    return Source(
        whole.schema, m.change_tracking(), ct.VERSION, ChangeSource(latest, limited, lambda before, upto: whole if before is None else read(before, upto), changed),
        lambda: [str(k) for k in range(shard_count)], lambda s: whole.where(ct.shard_of(keys, shard_count) == int(s)), lambda df: df,
    )


def file_source(spark: SparkSession, settings: Settings, staging: str) -> Source:
    """Parquet or JSON files dropped at ``path``: ``keys``, and for JSON ``schema`` (Avro), ``pointer`` and ``arrays``."""
    conf, kind = settings.source, settings.source["format"]
    keys, path = list(conf["keys"]), conf["path"]

    def rows(where, start: int = 0, end: int | None = None) -> DataFrame:
        if kind == "parquet":
            return files.parquet_rows(spark, where, keys, start, end, mapping=conf.get("nameMapping"), rule=settings.rule)
        if kind == "json":
            return files.json_rows(spark, where, keys, avro_schema(conf["schema"]), conf.get("pointer", ""), [(a["pointer"], a.get("fields", {})) for a in conf.get("arrays", ())], start, end, rule=settings.rule)
        raise FatalError(f"no such format: {kind}")

    listed = lambda: files.listing(spark, path)
    upto = lambda n: file_watermark(int(scalar(files.latest_created(n))))
    after = lambda before: int(before.version) + 1 if before else 0
    store = BlobStore(spark)

    def shards() -> list[str]:
        per, _ = files.file_shards(listed())
        names = [r.name for r in listed().orderBy("created", "name").select("name").toLocalIterator()]
        return store_shards(store, f"{staging}/lists", settings.stream_id, grouped(names, per))

    return Source(
        rows(path).schema, m.upsert(), "createdon",
        ChangeSource(lambda _: upto(listed()), lambda before, top: file_watermark(int(scalar(files.latest_created(files.in_time_range(listed(), after(before)), settings.range_limit))) or int(top.version)), lambda before, top: rows(path, after(before), int(top.version))),
        shards, lambda s: rows(stored_shard(store, s)), lambda df: latest_per_key(df, MERGE_KEY, "createdon"),
    )


def folder_source(spark: SparkSession, settings: Settings, staging: str) -> Source:
    """Folder-per-batch CSV with manifests below ``path``: ``entity``."""
    root, entity = settings.source["path"], settings.source["entity"]
    listed = lambda: folders.batch_folders(spark, root)

    def reduced(df: DataFrame) -> DataFrame:
        return select_fields(df, settings.rule, keep_essential=True)

    def read(before: Watermark | None, upto: Watermark) -> DataFrame:
        found = [f for f in listed() if (before is None or folders.folder_time(f) > before.timestamp) and folders.folder_time(f) <= upto.timestamp]
        return reduced(folders.of_folders(spark, root, found, entity, empty))

    names = listed()
    if not names:
        raise FatalError(f"{root} has no batch")
    empty = folders.entity_schema(spark, root, names[-1], entity)
    later = lambda before: [f for f in listed() if before is None or folders.folder_time(f) > before.timestamp]
    whole = reduced(folders.of_folders(spark, root, [], entity, empty))
    return Source(
        whole.schema, m.tombstone(), "versionnumber",
        ChangeSource(lambda _: folder_watermark(listed()[-1]), lambda before, top: folder_watermark((later(before) or [top.version])[: settings.range_limit][-1]), read),
        listed, lambda f: reduced(folders.of_folders(spark, root, [f], entity, empty)), lambda df: latest_then_live(df, MERGE_KEY, "versionnumber", F.col("IsDelete"), ("IsDelete",)), ("IsDelete",),  # of equal versions, a tombstone is the later one
    )


SOURCES: dict[str, Callable[[SparkSession, Settings, str], Source]] = {"changes": change_source, "files": file_source, "folders": folder_source}


def run(spark: SparkSession, settings: Settings, warehouse: str, stop: threading.Event | None = None, sink: Callable[[str, float, Mapping], None] | None = None, until_caught_up: bool = False) -> int:
    """Runs a stream or a backfill into the target below ``warehouse`` until it is done or ``stop`` is set; its exit code.

    ``until_caught_up`` ends a stream at the position that its source has now.
    """
    metrics = Metrics(sink, settings.tags)
    listener = metrics.listener()
    spark.streams.addListener(listener)
    try:
        _run(spark, settings, warehouse, stop or threading.Event(), metrics, until_caught_up)
        return exit_code(None)
    except BaseException as e:  # noqa: BLE001  the exit code tells what it was
        log.exception("%s failed", settings.stream_id)
        return exit_code(e)
    finally:
        spark.streams.removeListener(listener)


def _run(spark: SparkSession, settings: Settings, warehouse: str, stop: threading.Event, metrics: Metrics, until_caught_up: bool) -> None:
    if settings.kind not in SOURCES:
        raise FatalError(f"no such kind of stream: {settings.kind}")
    chosen = choose_run(settings.backfilling, settings.behaviour)
    staging = f"{warehouse}/staging"
    target = VersionedTable(spark, f"{warehouse}/{'/'.join(settings.target)}", settings.rows_per_file, settings.sorted_by, settings.bloom, clustered=True)
    again = lambda f: retried(f, settings.retry_mode, settings.backfilling)
    source = again(SOURCES[settings.kind])(spark, settings, staging)
    bootstrap(spark, staging, target, source.schema, settings.stream_id, chosen, settings.unified_schema)
    advised = Shape(settings.chunk, settings.rate[0], settings.burst)
    throttle = Throttle(settings.rate[0], settings.rate[1], settings.burst)
    pipeline = Pipeline(
        target, source.spec, source.version, source.ties, settings.rule, maintenance=settings.maintenance, staging=f"{staging}/{settings.stream_id}__", shaper=Shaper(settings.shaper, advised), throttle=throttle, metrics=metrics
    )
    changes = ChangeSource(again(source.changes.latest), again(source.changes.limited), source.changes.read, source.changes.has_changes)
    if chosen == "stream":
        run_polling(pipeline, changes, stop, settings.interval.total_seconds(), settings.jitter, settings.seed, until_caught_up)
    elif chosen == "backfill-merge":
        run_backfill_merge(pipeline, changes, None)
    else:
        observe = lambda shard, state: metrics.count({"STAGED": "backfill.shards_staged", "COMBINED": "backfill.shards_combined"}.get(state, "backfill.shards_combining"), 1)
        OverwriteBackfill(spark, staging, target, source.read_shard, source.finish, source.spec, observe=observe, version=source.version).run(source.shards(), changes.latest(None))
        current(target)
    finalise(spark, staging, chosen)


def run_from_settings(spark: SparkSession, document: Mapping, warehouse: str, stream_id: str, kind: str, backfilling: bool = False, **more) -> int:
    """run() of a JSON document."""
    try:
        settings = Settings.of(document, stream_id, kind, backfilling)
    except (FatalError, ValueError, KeyError, TypeError) as e:
        log.error("the settings can't be used: %s", e)
        return exit_code(FatalError(str(e)))
    return run(spark, settings, warehouse, **more)


def main() -> int:
    """The stream that the environment describes, until a signal ends it."""
    import os

    from millrace.streaming.app import stop_on_signal
    from millrace.streaming.metrics import statsd

    spark = SparkSession.builder.getOrCreate()
    address = os.environ.get("MILLRACE__STATSD")
    try:
        settings = Settings.from_environment()
    except (FatalError, ValueError, KeyError) as e:
        log.error("%s", e)
        return exit_code(FatalError(str(e)))
    return run(spark, settings, os.environ["MILLRACE__WAREHOUSE"], stop_on_signal(), statsd(address) if address else None)


if __name__ == "__main__":
    raise SystemExit(main())
