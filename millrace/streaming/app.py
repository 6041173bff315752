"""Settings, choice of the run, bootstrap, clean-up, retries and exit codes."""

from __future__ import annotations

import functools
import json
import os
import random
import re
import signal
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.operators.schema import with_merge_key
from millrace.operators.select import FieldRule
from millrace.operators.table import VersionedTable, drop_by_prefix
from millrace.streaming.maintenance import Maintenance


class FatalError(RuntimeError):
    """Needs a change of settings or data: exit code 1."""


class TransientError(RuntimeError):
    """May pass by itself: exit code 2."""


_UNITS = {"ms": 0.001, "millisecond": 0.001, "s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def parse_duration(text: str) -> timedelta:
    """``10 seconds``, ``5 minutes`` or ISO ``PT1H30M``."""
    if m := re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?", text.strip()):
        return timedelta(hours=int(m[1] or 0), minutes=int(m[2] or 0), seconds=float(m[3] or 0))
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([a-z]+?)s?", text.strip().lower()):
        if m[2] in _UNITS or m[2] + "s" in _UNITS:
            return timedelta(seconds=float(m[1]) * _UNITS.get(m[2], _UNITS.get(m[2] + "s", 0)))
    raise ValueError(f"not a duration: {text}")


def parse_rate(text: str) -> tuple[int, timedelta]:
    """``1000 per 1 second`` as (elements, period)."""
    n, found, period = text.partition(" per ")
    if not found:
        raise ValueError(f"not a rate: {text}")
    return int(n), parse_duration(period)


def format_duration(period: timedelta) -> str:
    """Text that parse_duration() reads back."""
    seconds = period.total_seconds()
    for unit, size in (("hour", 3600), ("minute", 60), ("second", 1)):
        if seconds and seconds % size == 0:
            return f"{int(seconds // size)} {unit}{'s' if seconds != size else ''}"
    return f"{seconds:g} seconds"


def format_rate(rate: int, period: timedelta) -> str:
    return f"{rate} per {format_duration(period)}"


def one_of(settings: Mapping, *names: str) -> tuple[str, object]:
    """The first alternative that the settings have."""
    for n in names:
        if settings.get(n) is not None:
            return n, settings[n]
    raise FatalError(f"one of {', '.join(names)} is needed")


@dataclass(frozen=True)
class Buffering:
    kind: str = "off"
    size: int | None = None

    @staticmethod
    def of(settings: Mapping) -> Buffering:
        if settings.get("unbounded") is not None:
            return Buffering("unbounded")
        if settings.get("bounded") is not None:
            return Buffering("bounded", int(settings["bounded"].get("maxBufferSize", settings["bounded"].get("size", 0))))
        return Buffering()


@dataclass(frozen=True)
class Settings:
    """A stream's settings from JSON; the groups are kept as they are where a source needs keys of its own."""

    stream_id: str
    kind: str
    backfilling: bool
    behaviour: str
    backfill_start: str | None
    interval: timedelta
    jitter: float
    seed: int
    range_limit: int | None
    rows_per_file: int
    chunk: int
    rate: tuple[int, timedelta]
    burst: int
    shaper: str
    retry_mode: str
    target: tuple[str, str, str]
    sorted_by: tuple[str, ...]
    bloom: tuple[str, ...]
    unified_schema: bool
    rule: FieldRule
    buffering: Buffering
    maintenance: Maintenance
    source: Mapping = field(default_factory=dict)
    tags: Mapping = field(default_factory=dict)

    @staticmethod
    def of(document: Mapping, stream_id: str = "stream", kind: str = "", backfilling: bool = False) -> Settings:
        mode, sink, staging, source = document.get("streamMode", {}), document.get("sink", {}), document.get("staging", {}), document.get("source", {})
        capture, backfill = mode.get("changeCapture", {}), mode.get("backfill", {})
        table, shape = staging.get("table", {}), document.get("throughput", {})
        shaper, _ = one_of(shape.get("shaperImpl") or {"static": {}}, "memoryBound", "static")
        upkeep = sink.get("maintenanceSettings", sink.get("maintenance", {}))
        threshold = lambda name: (upkeep.get(name) or {}).get("batchThreshold")
        properties = sink.get("targetTableProperties", sink.get("properties", {}))
        return Settings(
            stream_id.replace("-", "_"), kind, backfilling, backfill.get("backfillBehavior", backfill.get("behaviour", "Merge")), backfill.get("backfillStartDate"),
            parse_duration(capture.get("changeCaptureInterval", "10 seconds")), float(capture.get("changeCaptureJitterVariance", 0)), int(capture.get("changeCaptureJitterSeed", 0)), capture.get("rangeLimit"),
            int(table.get("maxRowsPerFile", 10_000)), int(shape.get("advisedChunkSize", 10_000)), parse_rate(shape.get("advisedRate", "10000 per 1 second")), int(shape.get("advisedRateBurst", shape.get("advisedBurst", 10_000))), shaper, document.get("retryMode", "always"),
            table_name(sink.get("targetTableFullName", sink.get("target", "lake.main.target"))), tuple(properties.get("sortedBy", ())), tuple(properties.get("parquetBloomFilterColumns", ())), bool(table.get("isUnifiedSchema", False)),
            FieldRule.of(source.get("fieldSelectionRule", {})), Buffering.of(source.get("buffering", {})),
            Maintenance(threshold("optimizeSettings"), threshold("snapshotExpirationSettings"), threshold("orphanFilesExpirationSettings"), threshold("analyzeSettings"), backfilling=backfilling),
            source.get("configuration", {}), document.get("observability", {}).get("metricTags", {}) | {"kind": kind, "stream_id": stream_id, "mode": "backfill" if backfilling else "stream"},
        )

    @staticmethod
    def from_environment(environment: Mapping[str, str] = os.environ, prefix: str = "MILLRACE__") -> Settings:
        spec = environment.get(f"{prefix}SPEC")
        if not spec:
            raise FatalError(f"{prefix}SPEC isn't set")
        return Settings.of(json.loads(spec), environment.get(f"{prefix}STREAM_ID", "stream"), environment.get(f"{prefix}STREAM_KIND", ""), environment.get(f"{prefix}BACKFILL", "false").lower() == "true")


def table_name(text: str) -> tuple[str, str, str]:
    parts = tuple(text.split("."))
    if len(parts) != 3 or not all(parts):
        raise FatalError(f"not catalog.schema.table: {text}")
    return parts


def choose_run(backfilling: bool, behaviour: str) -> str:
    """stream, backfill-merge or backfill-overwrite."""
    if not backfilling:
        return "stream"
    if behaviour.lower() not in ("merge", "overwrite"):
        raise FatalError(f"no such backfill: {behaviour}")
    return f"backfill-{behaviour.lower()}"


def bootstrap(spark: SparkSession, staging: str, target: VersionedTable, schema: T.StructType, stream_id: str, run: str, unified: bool = False) -> None:
    """Drops stale staging tables (an overwrite's shards stay for its resumption) and creates or migrates the target."""
    drop_by_prefix(spark, staging, f"{stream_id}__")
    if run != "backfill-overwrite":
        drop_by_prefix(spark, staging, "shard_")
        drop_by_prefix(spark, staging, "combine")
    if not target.exists():
        target.create(with_merge_key(schema))
    elif unified:
        target.migrate(schema)


def finalise(spark: SparkSession, staging: str, run: str) -> None:
    if run.startswith("backfill"):
        drop_by_prefix(spark, staging, "shard_")
        drop_by_prefix(spark, staging, "combine")


def stop_on_signal() -> threading.Event:
    stop = threading.Event()
    signal.signal(signal.SIGTERM, lambda *_: stop.set())
    return stop


def exit_code(error: BaseException | None) -> int:
    """0: done or interrupted, 1: fatal, 2: transient or unknown."""
    if error is None or isinstance(error, KeyboardInterrupt):
        return 0
    return 1 if isinstance(error, (FatalError, AssertionError)) else 2


def retried(call: Callable, mode: str = "always", backfilling: bool = False, attempts: int = 5, base: float = 0.1, retry_messages: tuple[str, ...] = (), sleep: Callable[[float], None] = time.sleep, seed: int = 0):
    """Calls again after OSErrors, and after errors with one of the messages, with growing, jittered waits.

    mode: never, backfillOnly or always. Unsupported features and timeouts aren't tried again.
    """
    rng = random.Random(seed)
    allowed = mode == "always" or (mode == "backfillOnly" and backfilling)

    @functools.wraps(call)
    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                passing = (isinstance(e, OSError) and not isinstance(e, TimeoutError)) or any(m in str(e) for m in retry_messages) and not isinstance(e, (NotImplementedError, TimeoutError))
                if not allowed or not passing or k == attempts - 1:
                    raise
                sleep(base * 2**k * (1 + rng.random() / 2))

    return run
