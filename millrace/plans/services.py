"""Queries of sources on disk, tables, shapes and whole runs from settings."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import sizing
from millrace.operators import merge as m
from millrace.operators.select import FieldRule
from millrace.operators.table import VersionedTable, drop_by_prefix
from millrace.plans.merges import utf16_sha
from millrace.plans.registry import query, table
from millrace.plans.streams import work_folder
from millrace.sources import files as fl
from millrace.sources import folders
from millrace.sources.blobs import BlobStore, store_shards, stored_shard
from millrace.streaming import app
from millrace.streaming.backfill import grouped
from millrace.streaming.runner import run_from_settings
from millrace.streaming.throughput import Shaper, chunks

_MANIFEST = {"entities": [{"name": "supplier", "attributes": [{"name": n, "dataType": t} for n, t in (("Id", "guid"), ("name", "string"), ("nation", "int64"), ("balance", "decimal"), ("versionnumber", "int64"), ("IsDelete", "boolean"))]}]}


def _batches(spark, sf_dir) -> str:
    """Suppliers in three hourly batches: all, those with even keys renamed, and those with keys divisible by 5 deleted; and one in progress."""
    root, store = work_folder(spark), BlobStore(spark)
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").collect()
    line = lambda r, name, v, gone="": f'{r.s_suppkey},"{name}",{r.s_nationkey},{r.s_acctbal!r},{v},{gone}'
    batches = [
        ("2024-01-01T10.00.00Z", {2: [line(r, r.s_name, 1) for r in rows]}),
        ("2024-01-01T11.00.00Z", {2: [line(r, f"new, {r.s_name}", 2) for r in rows if r.s_suppkey % 2 == 0]}),
        ("2024-01-01T12.00.00Z", {1: [line(r, "", 3, "True") for r in rows if r.s_suppkey % 5 == 0], 2: [line(r, r.s_name, 3) for r in rows if r.s_suppkey % 5 == 0]}),
        ("2024-01-01T13.00.00Z", {2: [line(r, "in progress", 9) for r in rows]}),
    ]
    for folder, numbered in batches:
        store.write_text(f"{root}/{folder}/model.json", json.dumps(_MANIFEST))
        for n, lines in numbered.items():
            store.write_text(f"{root}/{folder}/supplier/{n}.csv", "\n".join(lines) + "\n")
    store.write_text(f"{root}/Changelog/changelog.info", "2024-01-01T13.00.00Z")
    return root


_S = "s_suppkey::VARCHAR AS Id, s_nationkey::BIGINT AS nation, s_acctbal AS balance"


@query(f"""SELECT {_S}, s_name AS name, 1::BIGINT AS version, false AS gone, '2024-01-01T10.00.00Z' AS folder, 2 AS file_order FROM supplier
UNION ALL SELECT {_S}, 'new, ' || s_name, 2, false, '2024-01-01T11.00.00Z', 2 FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT {_S}, NULL, 3, true, '2024-01-01T12.00.00Z', 1 FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT {_S}, s_name, 3, false, '2024-01-01T12.00.00Z', 2 FROM supplier WHERE s_suppkey % 5 = 0""")
def folder_batches(spark, sf_dir):
    """All finished batches of a folder source, typed by their manifests, with folder and file order."""
    df = folders.changes(spark, _batches(spark, sf_dir), "supplier")
    return df.select("Id", "nation", "balance", "name", F.col("versionnumber").alias("version"), F.coalesce("IsDelete", F.lit(False)).alias("gone"), F.col("batch_folder").alias("folder"), "file_order")


@query("SELECT '2024-01-01T11.00.00Z' AS folder UNION ALL SELECT '2024-01-01T12.00.00Z'")
def folder_listing(spark, sf_dir):
    """Batches of a time range, listed by their hours' prefixes; the one in progress doesn't count."""
    start = folders.folder_time("2024-01-01T11.00.00Z")
    found = folders.batch_folders(spark, _batches(spark, sf_dir), start, folders.folder_time("2024-01-01T13.00.00Z"))
    return spark.createDataFrame([(f,) for f in found], "folder string")


@query("SELECT s_suppkey AS id, s_name AS name, base64(unhex(sha256(lower(s_suppkey::VARCHAR)))) AS merge_key FROM supplier")
def parquet_file_drops(spark, sf_dir):
    """Parquet files under other names, of which a rule takes some columns."""
    folder = work_folder(spark)
    table(spark, sf_dir, "supplier").repartition(3).write.parquet(folder)
    rows = fl.parquet_rows(spark, folder, ["id"], mapping={"s_suppkey": "id", "s_name": "name"}, rule=FieldRule("include", ("name", "id")))
    return rows.where("createdon > 0").select("id", "name", "merge_key")


@query("SELECT event_id, event_type, base64(unhex(sha256(lower(event_id::VARCHAR)))) AS merge_key FROM events")
def json_file_drops(spark, sf_dir):
    """Compressed JSON lines with a root pointer, without a field that a rule excludes."""
    folder = work_folder(spark)
    e = table(spark, sf_dir, "events")
    e.select(F.to_json(F.struct(F.struct("event_id", "event_type", "user_id").alias("body"))).alias("value")).write.option("compression", "gzip").text(folder)
    schema = T.StructType().add("event_id", "long").add("event_type", "string").add("user_id", "long")
    return fl.json_rows(spark, folder, ["event_id"], schema, "/body", rule=FieldRule("exclude", ("USER_ID",))).drop("createdon")


@query("SELECT c_custkey, c_name, c_acctbal, base64(unhex(sha256(lower(c_custkey::VARCHAR)))) AS merge_key FROM customer")
def csv_file_drops(spark, sf_dir):
    folder = work_folder(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.write.option("header", "true").csv(folder)
    return fl.csv_rows(spark, folder, ["c_custkey"], c.schema).drop("createdon")


@query("SELECT count(*) AS n_files, sum(n) AS n_names, true AS same FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)")
def blob_shards(spark, sf_dir):
    """Lists of names stored as packed texts and read back; and a file's text, stream, copy, sample and end."""
    folder, store = work_folder(spark), BlobStore(spark)
    groups = [r.names for r in table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names")).collect()]
    paths = store_shards(store, folder, "stream", groups)
    back = [stored_shard(store, p) for p in paths]
    import tempfile

    local = tempfile.mkdtemp()
    copy = store.download(paths[0], local)
    with open(copy, "rb") as f:
        same = back == groups and f.read() == b"".join(store.stream(paths[0], 7)) == store.text(paths[0]).encode() and store.metadata(paths[0]).bytes > 0
    same = same and store.download_random(folder, local) is not None and len(list(store.names(folder, "stream__*.txt"))) == len(paths) and store.delete(paths[0]) and not store.exists(paths[0])
    return spark.createDataFrame([(len(paths), sum(map(len, back)), bool(same))], "n_files long, n_names long, same boolean")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS added FROM supplier")
def table_migration(spark, sf_dir):
    """Columns that come later are null in the rows before; tables are made, found and dropped by prefix."""
    folder = work_folder(spark)
    s = table(spark, sf_dir, "supplier")
    t = VersionedTable(spark, f"{folder}/target", key="s_suppkey").create(s.select("s_suppkey", "s_name").schema)
    t.append(s.where("s_suppkey % 2 = 1").select("s_name", "s_suppkey"))
    more = s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", F.col("s_acctbal").alias("added"))
    t.migrate(more.schema)
    t.append(more)
    old = VersionedTable(spark, f"{folder}/old_1").create(s.schema)
    if drop_by_prefix(spark, folder, "old_") != ["old_1"] or old.exists() or not t.exists():
        raise AssertionError("drop by prefix")
    return t.read()


@query("SELECT count(*) AS n_rows, 4::BIGINT AS n_files, sum(strlen(s_name)) AS name_bytes, true AS has_bytes FROM supplier")
def table_statistics(spark, sf_dir):
    t = VersionedTable(spark, work_folder(spark), key="s_suppkey")
    t.overwrite(table(spark, sf_dir, "supplier").repartition(4))
    stats = t.stats()
    return t.column_bytes().where("name = 's_name'").select(F.lit(stats["rows"]).cast("long").alias("n_rows"), F.lit(stats["files"]).cast("long").alias("n_files"), F.col("bytes").alias("name_bytes"), F.lit(stats["bytes"] > 0).alias("has_bytes"))


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def sorted_files(spark, sf_dir):
    """Rows of one file, which was written in descending order of a column, in the order of the file; out of order, there are none."""
    t = VersionedTable(spark, work_folder(spark), sorted_by=("s_acctbal",), key="s_suppkey")
    t.overwrite(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").coalesce(1))
    rows = t.read().withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql.window import Window

    ordered = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("s_acctbal"), "at")) - 1)
    return t.read() if ordered.where("rank <> at").isEmpty() else t.read().limit(0)


_ORDERS = "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 0 ELSE o_totalprice END AS o_totalprice, 1 AS n_rewritten FROM orders"


@query(_ORDERS)
def merge_rewrites_touched_files(spark, sf_dir):
    """A change of one key in a clustered table of many files rewrites one file."""
    t = VersionedTable(spark, work_folder(spark), rows_per_file=200, key="o_orderkey", clustered=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).cast("long").alias("ver"))
    t.overwrite(o)
    before = {f["path"] for f in t.state().files}
    t.merge(o.orderBy("o_orderkey").limit(1).withColumn("o_totalprice", F.lit(0.0)).withColumn("ver", F.lit(2).cast("long")), m.upsert("o_orderkey", "ver"))
    gone = len(before - {f["path"] for f in t.state().files})
    return t.read().select("o_orderkey", "o_totalprice", F.lit(gone).alias("n_rewritten"))


@query("SELECT 10::BIGINT AS shards, 103::BIGINT AS files, 220::BIGINT AS row_bytes, 25::BIGINT AS chunk, 7::BIGINT AS static_chunk, true AS jittered, '30 per 5 minutes' AS rate, true AS packed")
def sizes_and_codecs(spark, sf_dir):
    """Shard counts, row sizes, shapes, jitter and texts of rates and lists, by their rules."""
    import random

    rng = random.Random(3)
    schema = T.StructType().add("a", "string").add("b", "integer")
    row = (
        sizing.shard_count(1280, 1), sizing.files_per_shard(None), sizing.row_bytes(schema), sizing.memory_bound_shape(10_000, 99, sizing.Shape(1000, 100, 50)).chunk, sizing.static_shape(7, 1, 1).chunk,
        all(abs(sizing.jittered_seconds(10, 0.1, rng) - 10) <= 1 for _ in range(100)), app.format_rate(*app.parse_rate("30 per 5 minutes")), fl.unpack_names(fl.pack_names(["a", "b/ü"])) == ["a", "b/ü"],
    )
    return spark.createDataFrame([row], "shards long, files long, row_bytes long, chunk long, static_chunk long, jittered boolean, rate string, packed boolean")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, true AS apart FROM orders")
def shaped_chunks(spark, sf_dir):
    """A changeset in chunks of an estimated size: no row is lost and no key is in two chunks."""
    t = VersionedTable(spark, work_folder(spark), key="o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    t.overwrite(o)
    n = t.stats()["rows"]
    shape = Shaper("memoryBound", sizing.Shape(max(1, n // 3), 100, 10)).shape(t)
    parts = [p.withColumn("part", F.lit(k)) for k, p in enumerate(chunks(o, "o_orderkey", n, shape.chunk))]
    from functools import reduce

    whole = reduce(lambda a, b: a.union(b), parts)
    per = whole.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("part").alias("p"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.max("p") == 1).alias("apart"))


def _settings(behaviour: str = "Merge", **source) -> dict:
    return {
        "streamMode": {"changeCapture": {"changeCaptureInterval": "1 second", "rangeLimit": 40}, "backfill": {"backfillBehavior": behaviour}}, "sink": {"targetTableFullName": "lake.main.target", "maintenanceSettings": {}},
        "throughput": {"shaperImpl": {"memoryBound": {}}, "advisedChunkSize": 1_000_000, "advisedRate": "1000000000 per 1 second"}, "staging": {"table": {"maxRowsPerFile": 100_000}}, "source": {"configuration": source},
    }


def _finished(code: int, spark, warehouse):
    if code:
        raise RuntimeError(f"exit code {code}")
    if BlobStore(spark).exists(f"{warehouse}/staging") and [b for b in BlobStore(spark).names(f"{warehouse}/staging", "*.parquet")]:
        raise AssertionError("staging tables are left")
    return VersionedTable(spark, f"{warehouse}/lake/main/target").read()


def _tracked(spark, sf_dir) -> tuple[str, str, str]:
    """A base table without keys ending in 0, and its changes: deletes of those, updates of keys ending in 1."""
    folder = work_folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o.where("o_orderkey % 10 <> 0").write.parquet(f"{folder}/base")
    o.where("o_orderkey % 10 IN (0, 1)").select("o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("SYS_CHANGE_VERSION"), F.expr("if(o_orderkey % 10 = 0, 'D', 'U')").alias("SYS_CHANGE_OPERATION")).write.parquet(f"{folder}/changes")
    return folder, f"{folder}/base", f"{folder}/changes"


_BASE = f"SELECT o_orderkey, o_custkey, o_totalprice, {utf16_sha('o_orderkey::VARCHAR')} AS merge_key FROM orders WHERE o_orderkey % 10 <> 0"


@query(_BASE)
def run_change_stream(spark, sf_dir):
    """Change tracking from settings to a merged table: the whole table first, then ranges of versions, until it has caught up."""
    folder, base, changed = _tracked(spark, sf_dir)
    document = _settings(table=base, changes=changed, keys=["o_orderkey"])
    document["streamMode"]["changeCapture"]["rangeLimit"] = 7
    code = run_from_settings(spark, document, folder, "orders-1", "changes", until_caught_up=True)
    return _finished(code, spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", "merge_key")


@query(_BASE)
def run_change_overwrite(spark, sf_dir):
    """The same table by a sharded overwrite."""
    folder, base, changed = _tracked(spark, sf_dir)
    code = run_from_settings(spark, _settings("Overwrite", table=base, changes=changed, keys=["o_orderkey"], pages=384, readCost=1.0), folder, "orders-2", "changes", backfilling=True)
    return _finished(code, spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", "merge_key")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def run_file_overwrite(spark, sf_dir):
    """Parquet drops by a sharded overwrite; the shards are stored lists of files."""
    folder = work_folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(5).write.parquet(f"{folder}/drops")
    code = run_from_settings(spark, _settings("Overwrite", format="parquet", path=f"{folder}/drops", keys=["o_orderkey"]), folder, "orders-3", "files", backfilling=True)
    return _finished(code, spark, folder).select("o_orderkey", "o_totalprice")


_LEFT = "SELECT s_suppkey::VARCHAR AS Id, CASE WHEN s_suppkey % 2 = 0 THEN 'new, ' || s_name ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0"


@query(_LEFT)
def run_folder_stream(spark, sf_dir):
    """Folder batches from settings to a merged table, with tombstones after the rows of their batch."""
    folder = work_folder(spark)
    document = _settings(path=_batches(spark, sf_dir), entity="supplier")
    document["streamMode"]["changeCapture"]["rangeLimit"] = 1
    code = run_from_settings(spark, document, folder, "suppliers", "folders", until_caught_up=True)
    return _finished(code, spark, folder).select("Id", "name")


@query(_LEFT)
def run_folder_overwrite(spark, sf_dir):
    folder = work_folder(spark)
    code = run_from_settings(spark, _settings("Overwrite", path=_batches(spark, sf_dir), entity="supplier"), folder, "suppliers", "folders", backfilling=True)
    return _finished(code, spark, folder).select("Id", "name")


@query("SELECT s_suppkey, list_sort(list(s_nationkey)) AS items FROM supplier GROUP BY s_suppkey")
def grouped_small_chunks(spark, sf_dir):
    """Groups of names in order; and lists by key that are cut at a length, joined again."""
    from millrace.operators.reduce import grouped_lists

    if grouped(["a", "b", "c"], 2) != [["a", "b"], ["c"]] or app.parse_duration(app.format_duration(timedelta(minutes=90))) != timedelta(minutes=90):
        raise AssertionError("codec")
    cut = grouped_lists(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", most=1)
    return cut.groupBy("s_suppkey").agg(F.array_sort(F.flatten(F.collect_list("s_nationkey"))).alias("items"))
