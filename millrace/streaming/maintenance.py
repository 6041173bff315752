"""Upkeep of a target after every so many batches."""

from __future__ import annotations

import logging
from dataclasses import dataclass

log = logging.getLogger(__name__)


@dataclass
class Maintenance:
    """Batch thresholds (None: never) of each task; a task that fails is logged and doesn't stop the stream."""

    optimize: int | None = None
    expire: int | None = None
    orphans: int | None = None
    analyze: int | None = None
    target_bytes: int = 128 << 20
    keep_seconds: float = 7 * 86_400
    keep_versions: int = 1
    analyze_columns: tuple[str, ...] = ()
    backfilling: bool = False
    batches: int = 0

    def due(self) -> list[str]:
        names = ("optimize", "expire", "orphans", "analyze")
        return [n for n in names if getattr(self, n) and self.batches % getattr(self, n) == 0 and not (n == "analyze" and self.backfilling)]

    def after_batch(self, table) -> list[str]:
        """Counts a batch with rows and runs what is due."""
        self.batches += 1
        tasks = {
            "optimize": lambda: table.optimize(self.target_bytes), "expire": lambda: table.expire_versions(self.keep_seconds, self.keep_versions),
            "orphans": lambda: table.remove_orphans(self.keep_seconds), "analyze": lambda: table.analyze(self.analyze_columns or None),
        }
        ran = []
        for name in self.due():
            try:
                tasks[name]()
                ran.append(name)
            except Exception:  # noqa: BLE001
                log.exception("%s failed", name)
        return ran
