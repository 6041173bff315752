"""Queries that run pipelines: streams into versioned tables, backfills, resumption."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from millrace.operators import merge as m
from millrace.operators.reduce import latest_per_key
from millrace.operators.table import VersionedTable
from millrace.plans import merges
from millrace.plans.registry import query, table
from millrace.sources.change_table import shard_of
from millrace.streaming.backfill import COMBINING, STAGED, OverwriteBackfill
from millrace.streaming.maintenance import Maintenance
from millrace.streaming.pipeline import ChangeSource, Pipeline, file_stream, poll_once, run_backfill_merge, run_files
from millrace.streaming.watermark import version_watermark


def work_folder(spark) -> str:
    """A folder for tables: in the shared folder that the cluster names. Only a local master gets a temporary one where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/')}/millrace-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="millrace-")


def _streamed(spark, sf_dir, files_per_trigger):
    folder = work_folder(spark)
    base, changes = merges.event_sides(spark, sf_dir)
    changes.repartition(4).write.parquet(f"{folder}/incoming")
    target = VersionedTable(spark, f"{folder}/target")
    target.overwrite(base)
    pipeline = Pipeline(target, m.tombstone(), "versionnumber", maintenance=Maintenance(optimize=2))
    run_files(pipeline, file_stream(spark, f"{folder}/incoming", changes.schema, files_per_trigger=files_per_trigger), f"{folder}/checkpoint").awaitTermination()
    return target.read()


_TOMB = merges._SIDES + merges._TOMB


@query(_TOMB)
def stream_merge_available_now(spark, sf_dir):
    return _streamed(spark, sf_dir, None)


@query(_TOMB)
def stream_rate_limited(spark, sf_dir):
    return _streamed(spark, sf_dir, 1)


_NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _source(spark, sf_dir, step):
    _, changes = merges.event_sides(spark, sf_dir)
    folder = work_folder(spark)  # the changes are reduced once, not at every step
    changes.write.parquet(f"{folder}/changes")
    changes = spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    top = changes.agg(F.max("versionnumber")).first()[0]
    mark = lambda v: version_watermark(v, _NOW)
    return ChangeSource(
        lambda before: mark(top), lambda before, latest: mark(min(latest.position, (before.position if before else 0) + step)),
        lambda before, upto: changes.where((F.col("versionnumber") > (before.position if before else 0)) & (F.col("versionnumber") <= upto.position)),
    )


@query(_TOMB)
def change_capture_polling(spark, sf_dir):
    """Change capture in four ranges of versions, with the watermark committed beside the data."""
    base, _ = merges.event_sides(spark, sf_dir)
    target = VersionedTable(spark, work_folder(spark))
    target.overwrite(base)
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    source, pipeline = _source(spark, sf_dir, -(-top // 4)), Pipeline(target, m.tombstone(), "versionnumber")
    while poll_once(pipeline, source) is not None:
        pass
    return target.read()


@query(_TOMB)
def backfill_merge(spark, sf_dir):
    base, _ = merges.event_sides(spark, sf_dir)
    target = VersionedTable(spark, work_folder(spark))
    target.overwrite(base)
    run_backfill_merge(Pipeline(target, m.tombstone(), "versionnumber"), _source(spark, sf_dir, 0), None)
    return target.read()


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.lit(1).cast("long").alias("createdon"), F.col("o_orderkey").cast("string").alias("merge_key"))


def _backfill(spark, sf_dir, finish=lambda df: df, observe=lambda s, t: None, folder=None, rows=None):
    folder = folder or work_folder(spark)
    rows = rows if rows is not None else _orders(spark, sf_dir)
    target = VersionedTable(spark, f"{folder}/target")
    run = OverwriteBackfill(spark, f"{folder}/staging", target, lambda s: rows.where(shard_of(["o_orderkey"], 4) == int(s)), finish, m.upsert(), observe=observe)
    return run, target


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, 1::BIGINT AS createdon, o_orderkey::VARCHAR AS merge_key FROM orders"


@query(_ORDERS)
def overwrite_commit_ct(spark, sf_dir):
    run, target = _backfill(spark, sf_dir)
    run.run(["0", "1", "2", "3"], version_watermark(9, _NOW))
    return target.read()


@query("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, 2::BIGINT AS createdon, o_orderkey::VARCHAR AS merge_key FROM orders")
def overwrite_commit_blob(spark, sf_dir):
    """Two versions of every row; the commit keeps the latest of each key."""
    both = _orders(spark, sf_dir)
    both = both.unionByName(both.withColumn("createdon", F.lit(2).cast("long")).withColumn("o_totalprice", F.col("o_totalprice") * 2))
    run, target = _backfill(spark, sf_dir, lambda df: latest_per_key(df, "merge_key", "createdon"), rows=both)
    run.run(["0", "1", "2", "3"], version_watermark(9, _NOW))
    return target.read()


@query(_ORDERS)
def shard_combine(spark, sf_dir):
    run, _ = _backfill(spark, sf_dir)
    run.run(["0", "1", "2", "3"], version_watermark(9, _NOW))
    return run._table("combine").read()


class _Cut(Exception):
    pass


def _resumed(spark, sf_dir, at):
    folder, seen = work_folder(spark), []

    def cut(shard, state):
        seen.append(state)
        if state == at and seen.count(at) == 2:
            raise _Cut

    run, target = _backfill(spark, sf_dir, observe=cut, folder=folder)
    run.parallel = 1
    try:
        run.run(["0", "1", "2", "3"], version_watermark(9, _NOW))
    except _Cut:
        pass
    again, target = _backfill(spark, sf_dir, folder=folder)
    again.run(["other"], version_watermark(99, _NOW))
    return target.read()


@query(_ORDERS)
def shard_resume_merge(spark, sf_dir):
    """Cut off while a shard is being combined: that shard is merged when the run goes on."""
    return _resumed(spark, sf_dir, COMBINING)


@query(_ORDERS)
def shard_resume_staged(spark, sf_dir):
    """Cut off while shards are staged: staged ones aren't read again, and the first plan holds."""
    return _resumed(spark, sf_dir, STAGED)


@query("SELECT count(*) AS n_rows, 1::BIGINT AS optimized, sum(o_totalprice) > 0 AS positive FROM orders")
def table_maintenance(spark, sf_dir):
    t = VersionedTable(spark, work_folder(spark), rows_per_file=2_000, sorted_by=("o_totalprice",), bloom=("o_orderkey",))
    t.overwrite(_orders(spark, sf_dir))
    upkeep = Maintenance(optimize=1, expire=1, orphans=1, analyze=1, keep_seconds=0)
    upkeep.after_batch(t)
    stats = t.stats()
    # one file, or files of half the target size at least: however many the rows make
    compact = stats["files"] <= 1 or stats["bytes"] >= stats["files"] * upkeep.target_bytes / 2
    return t.read().agg(F.count("*").alias("n_rows"), F.lit(1 if compact else 0).cast("long").alias("optimized"), (F.sum("o_totalprice") > 0).alias("positive"))
