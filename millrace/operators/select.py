"""Field selection and row modifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import MERGE_KEY


@dataclass(frozen=True)
class FieldRule:
    """Which columns a stream takes. ``kind``: all, include or exclude; names count in any case."""

    kind: str = "all"
    fields: tuple[str, ...] = ()
    essential: tuple[str, ...] = (MERGE_KEY,)
    server_side: bool = False

    @staticmethod
    def of(settings: Mapping) -> FieldRule:
        """The first of all, include and exclude that the settings have; none of them means all."""
        rule = settings.get("rule") or {}
        extra = dict(essential=tuple(settings.get("essentialFields", ())), server_side=bool(settings.get("isServerSide", False)))
        for kind in ("all", "include", "exclude"):
            if rule.get(kind) is not None:
                return FieldRule(kind, tuple(rule[kind].get("fields", ())), **extra)
        return FieldRule(**extra)

    def check(self) -> FieldRule:
        """Essential fields must be included and may not be excluded."""
        named, needed = {f.lower() for f in self.fields}, {f.lower() for f in self.essential}
        if self.kind == "include" and needed - named:
            raise ValueError(f"essential fields aren't included: {sorted(needed - named)}")
        if self.kind == "exclude" and needed & named:
            raise ValueError(f"essential fields are excluded: {sorted(needed & named)}")
        return self

    def columns(self, names: Sequence[str], keep_essential: bool = False) -> list[str]:
        """Of ``names`` those that the rule takes, in order; an include may keep the essential ones as well."""
        named, needed = {f.lower() for f in self.fields}, {f.lower() for f in self.essential}
        if self.kind == "include":
            return [n for n in names if n.lower() in named or (keep_essential and n.lower() in needed)]
        if self.kind == "exclude":
            return [n for n in names if n.lower() not in named]
        return list(names)

    def checked_keys(self, keys: Sequence[str]) -> FieldRule:
        """A rule at the source may not leave out primary keys."""
        lost = [k for k in keys if k not in self.columns(keys)]
        if lost:
            raise ValueError(f"primary keys are left out: {lost}")
        return self


def select_fields(df: DataFrame, rule: FieldRule, keep_essential: bool = False) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in rule.columns(df.columns, keep_essential)))


@dataclass(frozen=True)
class RowModifications:
    """Ordered changes of rows: each has just one of key, version, load time and field rule."""

    steps: tuple[Mapping, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for s in self.steps:
            if len([k for k in ("surrogateMergeKey", "surrogateVersion", "loadTimestamp", "fieldSelector") if s.get(k) is not None]) != 1:
                raise ValueError("a row modification has exactly one kind")

    def apply(self, df: DataFrame, key: Column | None = None, version: Column | None = None, loaded: Column | None = None) -> DataFrame:
        for s in self.steps:
            if s.get("surrogateMergeKey") is not None:
                from millrace.functions.keys import hashed_key

                df = df.withColumn(s["surrogateMergeKey"].get("name", MERGE_KEY), key if key is not None else hashed_key(*s["surrogateMergeKey"]["fields"]))
            elif s.get("surrogateVersion") is not None:
                df = df.withColumn(s["surrogateVersion"].get("name", "row_version"), version if version is not None else F.unix_seconds(F.current_timestamp()))
            elif s.get("loadTimestamp") is not None:
                df = df.withColumn(s["loadTimestamp"].get("name", "loaded_at"), loaded if loaded is not None else F.current_timestamp())
            else:
                df = select_fields(df, FieldRule.of({"rule": s["fieldSelector"]}), keep_essential=True)
        return df
