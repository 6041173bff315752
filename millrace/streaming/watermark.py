"""Positions in a source, as JSON text: numbered versions, folder times, file times and plain times."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass
from datetime import datetime, timezone

from millrace.sources.folders import folder_time

PROPERTY, LEGACY_PROPERTY = "source-watermark", "comment"


def _moment(text: str) -> datetime:
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


@functools.total_ordering
@dataclass(frozen=True, eq=False)
class Watermark:
    """``kind``: version (numbered changes), folder (named by a time), file (epoch seconds) or time."""

    kind: str
    version: str
    timestamp: datetime
    prefix: str | None = None

    @property
    def position(self) -> float:
        if self.kind in ("version", "file"):
            return int(self.version)
        if self.kind == "folder":
            return folder_time(self.version).timestamp()
        return self.timestamp.timestamp()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Watermark) and self.kind == other.kind and self.position == other.position

    def __hash__(self) -> int:
        return hash((self.kind, self.position))

    def __lt__(self, other: Watermark) -> bool:
        if self.kind != other.kind:
            raise TypeError(f"a {self.kind} watermark can't be compared with a {other.kind} one")
        return self.position < other.position

    def minus(self, n: int) -> int:
        return int(self.version) - n

    def age(self, now: datetime | None = None) -> int:
        """Seconds since its time."""
        return int(((now or datetime.now(timezone.utc)) - self.timestamp).total_seconds())

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "version": self.version, "timestamp": self.timestamp.isoformat()} | ({"prefix": self.prefix} if self.prefix is not None else {}))

    @staticmethod
    def from_json(text: str) -> Watermark:
        """An unreadable watermark is an error: starting over silently would lose the position."""
        try:
            x = json.loads(text)
            return Watermark(x["kind"], str(x["version"]), _moment(x["timestamp"]), x.get("prefix"))
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"not a watermark: {text[:200]}") from e


def version_watermark(version: int, timestamp: datetime) -> Watermark:
    return Watermark("version", str(version), timestamp)


def file_watermark(epoch_seconds: int) -> Watermark:
    return Watermark("file", str(epoch_seconds), datetime.fromtimestamp(epoch_seconds, timezone.utc))


def folder_watermark(folder: str, prefix: str | None = None) -> Watermark:
    return Watermark("folder", folder, folder_time(folder), prefix)


def time_watermark(timestamp: datetime) -> Watermark:
    return Watermark("time", str(int(timestamp.timestamp())), timestamp)


def current(table) -> Watermark | None:
    """The table's watermark; an older one kept under the legacy property is moved to its place."""
    properties = table.properties()
    if PROPERTY in properties:
        return Watermark.from_json(properties[PROPERTY])
    if LEGACY_PROPERTY in properties:
        found = Watermark.from_json(properties[LEGACY_PROPERTY])
        table.set_properties(**{PROPERTY: found.to_json()})
        return found
    return None
