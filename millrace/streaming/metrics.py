"""Counters and gauges: a stream's own ones, those of streaming queries by a listener, and a statsd sink."""

from __future__ import annotations

import socket
import time
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

#: name: kind. Durations are in milliseconds.
NAMES = {
    "rows.staged": "counter", "rows.incoming": "counter", "rows.chunk_size": "gauge", "rows.chunk_size_bytes": "gauge", "rows.chunk_cost": "gauge", "memory.gc_share": "gauge", "memory.free_bytes": "gauge",
    "batch.grouping_duration": "gauge", "batch.stage_duration": "gauge", "batch.merge_duration": "gauge", "batch.dispose_duration": "gauge", "batch.throttled_duration": "gauge", "backfill.shard_commit_duration": "gauge",
    "target.optimize_duration": "gauge", "target.expire_duration": "gauge", "target.orphans_duration": "gauge", "target.analyze_duration": "gauge", "watermark.age": "gauge", "watermark.updates": "counter",
    "backfill.shards_staged": "counter", "backfill.shards_combining": "counter", "backfill.shards_combined": "counter",
}


class Metrics:
    """Keeps what was counted and measured last, and sends (name, value, tags) of each to ``sink``."""

    def __init__(self, sink: Callable[[str, float, Mapping], None] | None = None, tags: Mapping[str, str] | None = None) -> None:
        self.sink, self.tags, self.values = sink, dict(tags or {}), defaultdict(float)

    def count(self, name: str, n: float) -> None:
        self.values[name] += n
        if self.sink:
            self.sink(name, n, self.tags)

    def gauge(self, name: str, value: float) -> None:
        self.values[name] = value
        if self.sink:
            self.sink(name, value, self.tags)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.gauge(name, 1000 * (time.perf_counter() - began))

    def listener(self) -> MetricsListener:
        return MetricsListener(self.sink, self.tags)


def statsd(address: str, prefix: str = "millrace.stream") -> Callable[[str, float, Mapping], None]:
    """A sink that sends datagrams to host:port, or to a Unix socket given by its path. What can't be sent is dropped."""
    host, found, port = address.rpartition(":")
    unix = not found or "/" in address
    channel = socket.socket(socket.AF_UNIX if unix else socket.AF_INET, socket.SOCK_DGRAM)
    channel.setblocking(False)

    def send(name: str, value: float, tags: Mapping) -> None:
        kind = "c" if NAMES.get(name, "counter") == "counter" else "g"
        text = f"{prefix}.{name}:{value:g}|{kind}" + ("|#" + ",".join(f"{k}:{v}" for k, v in tags.items()) if tags else "")
        try:
            channel.sendto(text.encode(), address if unix else (host, int(port)))
        except OSError:
            return

    return send


class MetricsListener(StreamingQueryListener):
    """Sends (name, value, tags) of each progress to ``sink`` and sums up rows."""

    def __init__(self, sink: Callable[[str, float, Mapping], None] | None = None, tags: Mapping[str, str] | None = None) -> None:
        self.sink, self.tags, self.totals = sink, dict(tags or {}), defaultdict(float)

    def _send(self, name: str, value: float) -> None:
        self.totals[name] += value
        if self.sink:
            self.sink(name, value, self.tags)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._send("queries_started", 1)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._send("rows_incoming", p.numInputRows)
        self._send("batches", 1)
        self._send("batch_ms", p.batchDuration)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._send("idle", 1)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._send("queries_failed" if event.exception else "queries_ended", 1)
