"""Version-guarded upsert and delete: MERGE over plain Parquet, as joins.

Branches are tried in order (delete, update, insert) in three-valued logic: a condition that is unknown doesn't hold. A
source is one row per key; rows whose key is null never match, so they are always inserted.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import MERGE_KEY


@dataclass(frozen=True)
class MergeSpec:
    """SQL conditions over ``s`` (source) and ``t`` (target); None for a branch that doesn't exist."""

    key: str = MERGE_KEY
    insert: str = "true"
    update: str | None = None
    delete: str | None = None
    partition_keys: tuple[str, ...] = ()
    partition_values: Mapping[str, Sequence] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("a merge needs a key")
        if not self.insert:
            raise ValueError("a merge needs an insert branch")


def change_tracking(key: str = MERGE_KEY, operation: str = "SYS_CHANGE_OPERATION", version: str = "SYS_CHANGE_VERSION", **more) -> MergeSpec:
    """Deletes go by the operation D without looking at versions; updates must be newer."""
    op = f"s.`{operation}`"
    return MergeSpec(key, f"{op} <> 'D'", f"{op} <> 'D' AND s.`{version}` > t.`{version}`", f"{op} = 'D'", **more)


def tombstone(key: str = MERGE_KEY, deleted: str = "IsDelete", version: str = "versionnumber", **more) -> MergeSpec:
    gone = f"coalesce(s.`{deleted}`, false)"
    return MergeSpec(key, f"NOT {gone}", f"NOT {gone} AND s.`{version}` > t.`{version}`", gone, **more)


def upsert(key: str = MERGE_KEY, version: str = "createdon", **more) -> MergeSpec:
    return MergeSpec(key, "true", f"s.`{version}` > t.`{version}`", None, **more)


def _holds(condition: str | None) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(False)


def _on(spec: MergeSpec) -> Column:
    on = F.col(f"t.`{spec.key}`") == F.col(f"s.`{spec.key}`")
    for c in spec.partition_keys:
        on = on & (F.col(f"t.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) & F.col(f"s.`{c}`").isNotNull() | F.col(f"s.`{c}`").isNull())
    for c, values in spec.partition_values.items():
        on = on & F.col(f"t.`{c}`").isin(*values)
    return on


def merge(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """The target after the merge, with its own columns; both sides need them all, by name. One join on the key."""
    columns = target.columns
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    joined = t.join(s, _on(spec), "full_outer")
    in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
    matched = in_t & in_s
    state = (
        F.when(matched & _holds(spec.delete), "drop").when(matched & _holds(spec.update), "update").when(matched, "keep")
        .when(in_s & _holds(spec.insert), "insert").when(in_s, "drop").otherwise("keep")
    )
    from_source = F.col("__state").isin("update", "insert")
    taken = [
        (F.when(F.col("__state") == "insert", F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")) if c == spec.key else F.when(from_source, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`"))).alias(c) for c in columns
    ]
    return joined.withColumn("__state", state).where("__state <> 'drop'").select(*taken)


def _reads_cheaply(df: DataFrame) -> bool:
    """Whether a plan is a scan with projections and filters, which may run twice."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not re.search(r"^[\s:+|-]*(?:Join|Aggregate|Window|WindowGroupLimit|Distinct|Sort|Repartition\w*|Generate|Deduplicate)\b", plan, re.M)


def merge_small_source(target: DataFrame, source: DataFrame, spec: MergeSpec, most_rows: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """merge() that leaves a stored target unshuffled while the source has at most ``most_rows`` rows and ``most_bytes`` bytes.

    The target is joined to the broadcast source in one pass; a second pass over its keys alone finds the source's new
    rows. It is the full outer join where the source is larger (its rows are counted and their size is taken from the
    schema and the strings' lengths) and where the target is the result of shuffles, which would run twice.
    """
    if not _reads_cheaply(target):
        return merge(target, source, spec)
    texts = [F.octet_length(F.col(f"`{f.name}`")) for f in source.schema if f.dataType.typeName() in ("string", "binary")]
    width = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(16 * len(source.columns)))
    rows, bytes_ = source.limit(most_rows + 1).agg(F.count("*"), F.sum(width)).first()
    if rows > most_rows or (bytes_ or 0) > most_bytes:
        return merge(target, source, spec)
    columns = target.columns
    t, s = target.alias("t"), F.broadcast(source.withColumn("__s", F.lit(True))).alias("s")
    matched = F.col("s.__s").isNotNull()
    state = F.when(matched & _holds(spec.delete), "drop").when(matched & _holds(spec.update), "update").otherwise("keep")
    old = t.join(s, _on(spec), "left").withColumn("__state", state).where("__state <> 'drop'")
    kept = old.select(*((F.col(f"t.`{c}`") if c == spec.key else F.when(F.col("__state") == "update", F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`"))).alias(c) for c in columns))
    keys = target.select(*dict.fromkeys([spec.key, *spec.partition_keys, *spec.partition_values])).join(F.broadcast(source.select(F.col(spec.key).alias("__k")).distinct()), F.col(spec.key) == F.col("__k"), "left_semi").alias("t")
    new = source.alias("s").join(keys, _on(spec), "left_anti").where(_holds(spec.insert)).select(*columns)
    return kept.unionByName(new)
