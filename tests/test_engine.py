"""Operators, sources, tables, streaming and settings on small data."""

import json
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import json_rows as j
from millrace.functions import keys as k
from millrace.functions import sizing
from millrace.operators import merge as m
from millrace.operators import reduce as r
from millrace.operators import schema as s
from millrace.operators.select import FieldRule, RowModifications
from millrace.operators.table import CommitConflict, VersionedTable, drop_by_prefix
from millrace.sources import change_table as ct
from millrace.sources import files, folders
from millrace.streaming import app
from millrace.streaming import watermark as w
from millrace.streaming.backfill import COMBINED, OverwriteBackfill, grouped
from millrace.streaming.maintenance import Maintenance
from millrace.streaming.pipeline import Pipeline, file_stream, run_files

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)


def test_golden_key(spark):
    found = spark.range(2, 3).select(k.hashed_key(F.col("id")).alias("k")).first().k
    assert found == "913da1f8df6f8fd47593840d533ba0458cc9873996bf310460abb495b34c232a"
    assert spark.sql("SELECT CAST(NULL AS INT) AS a, 1 AS b").select(k.hashed_key("a", "b").alias("k")).first().k is None


def test_keys_need_their_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        k.blob_key(df, ["absent"])
    with pytest.raises(ValueError):
        k.id_key(df, "Ident")
    assert k.normalize_names(spark.sql("SELECT 1 AS `c/d`")).columns == ["cd"]
    assert spark.sql("SELECT 'a,\"b\nc\",d\ne' AS x").select(k.quoted_newlines_removed(F.col("x")).alias("y")).first().y == 'a,"bc",d\ne'


@pytest.mark.parametrize("spec,columns", [(m.change_tracking("k", "op", "ver"), "ct"), (m.tombstone("k", "gone", "ver"), "tomb"), (m.upsert("k", "ver"), "up")])
def test_merge_equals_native_merge(spark, spec, columns):
    """Random tables with nulls everywhere, against DuckDB's MERGE; both physical forms."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    target = [(pick(None, *range(30)), pick(None, 1, 2, 3), "I", False, f"t{i}") for i in range(25)]
    target = list({x[0] if x[0] is not None else ("n", i): x for i, x in enumerate(target)}.values())
    source = [(pick(None, *range(40)), pick(None, 1, 2, 3), pick(None, "I", "U", "D"), pick(None, True, False), f"s{i}") for i in range(40)]
    source = list({x[0] if x[0] is not None else ("n", i): x for i, x in enumerate(source)}.values())
    schema = "k int, ver int, op string, gone boolean, v string"
    c = duckdb.connect()
    for name, rows in (("t", target), ("s", source)):
        c.sql(f"CREATE TABLE {name} (k INT, ver INT, op VARCHAR, gone BOOLEAN, v VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?)", rows)
    sql = lambda x: x.replace("`", "")
    branches = (f"WHEN MATCHED AND {sql(spec.delete)} THEN DELETE " if spec.delete else "") + f"WHEN MATCHED AND {sql(spec.update)} THEN UPDATE SET ver = s.ver, op = s.op, gone = s.gone, v = s.v WHEN NOT MATCHED AND {sql(spec.insert)} THEN INSERT VALUES (s.k, s.ver, s.op, s.gone, s.v)"
    c.sql(f"MERGE INTO t USING s ON t.k = s.k {branches}")
    expected = sorted(c.sql("SELECT * FROM t").fetchall(), key=repr)
    a, b = spark.createDataFrame(target, schema), spark.createDataFrame(source, schema)
    for how in (m.merge, m.merge_small_source, lambda x, y, z: m.merge_small_source(x, y, z, most_rows=1)):
        assert sorted(map(tuple, how(a, b, spec).collect()), key=repr) == expected
    empty = spark.createDataFrame([], schema)
    assert m.merge(a, empty, spec).count() == len(target) and m.merge(empty, empty, spec).count() == 0


def test_merge_needs_key_and_insert():
    with pytest.raises(ValueError):
        m.MergeSpec("")
    with pytest.raises(ValueError):
        m.MergeSpec("k", insert="")


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d"), (2, 1, "e"), (2, 1, "f")], "k int, v int, x string")
    assert sorted(x.x for x in r.latest_per_key(df, "k", "v", ["x"]).collect()) == ["b", "d", "f"]
    assert sorted(x.x for x in r.latest_live(df, "k", "v", F.col("x") == "b").collect())[0] == "a"
    assert "b" not in [x.x for x in r.latest_then_live(df, "k", "v", F.col("x") == "b").collect()]


def test_versions(spark):
    df = spark.createDataFrame([(v, v * 10) for v in (1, 2, 2, 5, 9)], "v long, t long")
    assert r.nth_version(df, "v", 0, 9, 2).first().v == 2
    assert r.nth_version(df, "v", 9, 12, 2).first().v == 12
    assert r.version_at(df, "v", "t", 45).first().v == 5
    assert r.commit_time(df, "v", "t", 7, F.lit(-1)).first().t == -1


@pytest.mark.parametrize("line,fields", [('"q",,"13,21"', ["q", None, "13,21"]), ("a,b,c", ["a", "b", "c"]), (",,", [None, None, None])])
def test_csv_lines(line, fields):
    assert folders.parse_line(line, 3) == fields


@pytest.mark.parametrize("line", ['"q",","1321"', "a,b", "a,b,c,d", '"a,b,c'])
def test_bad_csv_lines(line):
    with pytest.raises(ValueError):
        folders.parse_line(line, 3)


def test_schema_differences():
    a = T.StructType().add("ID", "integer").add("x", "decimal(10,2)").add("n", T.StructType().add("p", "string").add("q", "long"))
    b = T.StructType().add("id", "short").add("X", "decimal(12,2)").add("n", T.StructType().add("q", "long").add("p", "string")).add("z", "string")
    assert [f.name for f in s.missing_fields(a, b)] == ["X", "z"]
    with pytest.raises(ValueError):
        s.evolved(a, b)
    assert s.evolved(a, T.StructType().add("z", "string")).names == ["ID", "x", "n", "z"]
    assert s.with_merge_key(s.with_merge_key(a)) == s.with_merge_key(a) and s.without_merge_key(s.with_merge_key(a)) == a
    assert s.jdbc_type("DECIMAL", 12, 3) == T.DecimalType(12, 3) and s.jdbc_type("FLOAT") == T.FloatType()
    with pytest.raises(ValueError):
        s.jdbc_type("GEOMETRY")


def test_field_rules():
    assert FieldRule.of({"rule": {"all": {}, "include": {"fields": ["a"]}}}).kind == "all"
    assert FieldRule.of({}).kind == "all"
    with pytest.raises(ValueError):
        FieldRule("include", ("a",), ("b",)).check()
    with pytest.raises(ValueError):
        FieldRule("exclude", ("b",), ("B",)).check()
    with pytest.raises(ValueError):
        FieldRule("exclude", ("k",)).checked_keys(["k"])
    with pytest.raises(ValueError):
        RowModifications(({"surrogateMergeKey": {}, "loadTimestamp": {}},))


def test_json_edges(spark):
    df = spark.createDataFrame([('{"a": 1, "items": []}',), ('{"a": 2, "items": [{"b": 5, "a": 9}, {"b": null}]}',)], "value string")
    schema = T.StructType().add("a", "long").add("b", "long").add("items", "string")
    rows = j.exploded_rows(j.root_rows(df, "value").drop("value"), "root", schema, [("/items", {"b": "b", "a": "a"})])
    assert sorted(map(tuple, rows.collect()), key=repr) == [(9, 5, None), (None, None, None)]
    for bad in ('"text"', '{"other": 1}'):
        with pytest.raises(Exception):  # noqa: B017
            j.exploded_rows(j.root_rows(spark.createDataFrame([(bad,)], "value string"), "value").drop("value"), "root", schema, [("/items", {"b": "b"})]).collect()
    with pytest.raises(ValueError):
        j.avro_schema({"fields": [{"name": "x", "type": "int"}]})
    assert j.pointer_parts("/a~1b/c~0d") == ["a/b", "c~d"]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", sorted_by=("a",), bloom=("a",))
    assert not t.exists()
    t.create(T.StructType().add("a", "long"), properties={"p": "1"})
    t.append(spark.range(5).select(F.col("id").alias("a")), q="2")
    assert t.read().count() == 5 and t.properties() == {"p": "1", "q": "2"}
    with pytest.raises(ValueError):
        t.append(spark.range(1).select(F.col("id").alias("b")))
    assert [f.name for f in t.migrate(T.StructType().add("b", "string"))] == ["b"] and t.migrate(T.StructType().add("B", "string")) == []
    assert t.read().where("b IS NULL").count() == 5
    old = t.state().version
    t.overwrite(t.read().where("a > 2"))
    assert t.read().count() == 2 and t.read(old).count() == 5
    with pytest.raises(CommitConflict):
        t._commit(t.state())
    t.optimize()
    assert t.stats()["files"] == 1 and t.analyze()["a"]["values"] == 2
    t.expire_versions(0, keep=1)
    assert t.remove_orphans(0) and t.read().count() == 2
    assert drop_by_prefix(spark, f"file://{tmp_path}", "t") == ["t"] and not t.exists()


def test_bloom_filters_fit_files(spark, tmp_path):
    """Filters are made for a file's rows, so small files look small to optimize(), which writes them again."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", rows_per_file=100, bloom=("a",))
    t.overwrite(spark.range(1000).select(F.col("id").alias("a")).coalesce(1))
    assert t.stats()["files"] == 10 and t.stats()["bytes"] < 20_000
    t.optimize()
    jvm = spark._jvm.org.apache
    (file,) = t.state().files
    found = jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(f"{t.path}/{file['path']}"), spark._jsc.hadoopConfiguration())
    reader = jvm.parquet.hadoop.ParquetFileReader.open(found)
    assert reader.getFooter().getBlocks().get(0).getColumns().get(0).getBloomFilterOffset() > 0 and file["bytes"] < 20_000
    reader.close()


def test_upkeep_of_many_target_files(spark, sf, monkeypatch):
    """Rows that make more than a few files of the target size are compact too; files that were left small aren't."""
    from millrace.plans import streams

    monkeypatch.setattr(streams, "Maintenance", lambda **more: Maintenance(target_bytes=2_000, **more))
    monkeypatch.setattr(streams, "VersionedTable", lambda *a, **more: VersionedTable(*a, **more | {"rows_per_file": 20}))
    assert streams.table_maintenance(spark, sf).first().optimized == 1
    monkeypatch.setattr(VersionedTable, "optimize", lambda *_: None)
    monkeypatch.setattr(streams, "Maintenance", Maintenance)
    assert streams.table_maintenance(spark, sf).first().optimized == 0


def test_maintenance_thresholds_and_failures():
    class Broken:
        def optimize(self, *_):
            raise RuntimeError

        def analyze(self, *_):
            return None

    upkeep = Maintenance(optimize=2, analyze=1)
    assert [upkeep.after_batch(Broken()) for _ in range(2)] == [["analyze"], ["analyze"]]
    assert Maintenance(analyze=1, backfilling=True).after_batch(Broken()) == []


def test_stream_restart_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "merge_key string, createdon long, v string")
    rows.write.parquet(f"{tmp_path}/in")
    t = VersionedTable(spark, f"file://{tmp_path}/t").create(rows.schema)
    pipeline = Pipeline(t, m.upsert(), "createdon")
    for _ in range(2):
        run_files(pipeline, file_stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/cp").awaitTermination()
    assert t.read().count() == 2
    assert pipeline.apply(rows, batch=0) is False
    spark.createDataFrame([("a", 2, "new", 7)], "merge_key string, createdon long, v string, extra long").createOrReplaceTempView("later")
    assert pipeline.apply(spark.table("later"), w.file_watermark(5), batch=9)
    assert {x.merge_key: x.extra for x in t.read().collect()} == {"a": 7, "b": None} and w.current(t) == w.file_watermark(5)
    assert pipeline.apply(rows.limit(0), w.file_watermark(6)) is False and w.current(t).version == "6"


def test_backfill_states(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = spark.range(100).select(F.col("id").cast("string").alias("merge_key"), F.lit(1).cast("long").alias("createdon"))
    reads = []

    def read(shard):
        reads.append(shard)
        return rows.where(F.pmod(F.xxhash64("merge_key"), F.lit(3)) == int(shard))

    b = OverwriteBackfill(spark, f"file://{tmp_path}/s", t, read)
    b.run(["0", "1", "2"], w.version_watermark(3, NOW))
    n = len(reads)
    b.run(["0", "1", "2"], w.version_watermark(4, NOW))
    assert len(reads) == n and t.read().count() == 100 and w.current(t) == w.version_watermark(3, NOW)
    assert b._table("shard_0").properties()["processing-state"] == COMBINED
    assert b.clean_up() and grouped(["a", "b", "c"], 2) == [["a", "b"], ["c"]]


def test_watermarks():
    a, b = w.version_watermark(9, NOW), w.version_watermark(10, NOW)
    assert a < b and w.Watermark.from_json(b.to_json()) == b and b.minus(1) == 9 and b.age(NOW + timedelta(seconds=5)) == 5
    assert w.folder_watermark("2024-01-01T10.00.00Z") < w.folder_watermark("2024-01-01T10.00.00-01:00")
    with pytest.raises(TypeError):
        a < w.file_watermark(1)  # noqa: B015
    with pytest.raises(ValueError):
        w.Watermark.from_json("{}")


def test_folder_batches(spark, tmp_path):
    manifest = {"entities": [{"name": "thing", "attributes": [{"name": n, "dataType": t} for n, t in (("Id", "guid"), ("SinkCreatedOn", "dateTime"), ("amount", "decimal"), ("versionnumber", "int64"), ("IsDelete", "boolean"), ("at", "dateTimeOffset"))]}]}
    for hour, lines in (("10", ['k1,"1/2/2024 3:04:05 PM",1.5,1,,2024-01-02T03:04:05.1234567+00:00', 'k2,,,2,,"2024-01-02T03:04:05Z"']), ("11", ['k1,,,3,True,', '"k\n3",,,4,,'])):
        folder = tmp_path / f"2024-01-01T{hour}.00.00Z"
        (folder / "thing").mkdir(parents=True)
        (folder / "model.json").write_text(json.dumps(manifest))
        (folder / "thing" / "1.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "2024-01-01T12.00.00Z" / "thing").mkdir(parents=True)
    (tmp_path / "2024-01-01T13.00.00Z").mkdir()
    (tmp_path / "2024-01-01T13.00.00Z" / "model.json").write_text(json.dumps(manifest))
    (tmp_path / "Changelog").mkdir()
    (tmp_path / "Changelog" / "changelog.info").write_text("2024-01-01T13.00.00Z")
    root = f"file://{tmp_path}"
    assert folders.batch_folders(spark, root) == ["2024-01-01T10.00.00Z", "2024-01-01T11.00.00Z"]
    rows = {(x.merge_key, x.versionnumber): x for x in folders.changes(spark, root, "thing").collect()}
    assert set(rows) == {("k1", 1), ("k2", 2), ("k1", 3), ("k3", 4)}
    assert str(rows["k1", 1].SinkCreatedOn) == "2024-01-02 15:04:05" and rows["k1", 1].at.microsecond == 123456 and rows["k1", 3].IsDelete is True and rows["k1", 1].file_order == 1
    assert folders.closest_folder(["2024-01-01T10.00.00Z", "2024-01-01T11.00.00Z"], datetime(2024, 1, 1, 10, 30, tzinfo=timezone.utc)) == "2024-01-01T11.00.00Z"


def test_file_drops(spark, tmp_path):
    spark.range(10).select("id", F.struct(F.col("id").alias("n")).alias("nested")).repartition(3).write.parquet(f"{tmp_path}/p")
    got = files.parquet_rows(spark, f"{tmp_path}/p", ["id"])
    assert got.count() == 10 and {"createdon", "merge_key"} < set(got.columns)
    assert files.parquet_rows(spark, f"{tmp_path}/p", ["id"], start=4_000_000_000).count() == 0
    spark.createDataFrame([('{"body": {"a": 1}}',), ('{"body": [{"a": 2}, {"a": 3}]}',)], "value string").write.option("compression", "gzip").text(f"{tmp_path}/j")
    assert sorted(x.a for x in files.json_rows(spark, f"{tmp_path}/j", ["a"], T.StructType().add("a", "integer"), "/body").collect()) == [1, 2, 3]
    listed = files.listing(spark, f"{tmp_path}/p", "*.parquet")
    per, shards = files.file_shards(listed)
    assert listed.count() == 3 and per == 10_000 and shards == 1 and files.latest_created(listed.limit(0)).first().created == 0
    assert files.unpack_names(files.pack_names(["a", "b/c"])) == ["a", "b/c"]
    assert files.split_path("s3a://bucket/a/b") == ("s3a", "bucket", "a/b")


def test_change_table(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "x int, v string")
    changes = spark.createDataFrame([(1, 5, "U"), (3, 6, "D")], "x int, SYS_CHANGE_VERSION long, SYS_CHANGE_OPERATION string")
    got = {x.x: x for x in ct.changes_since(base, changes, ["x"], 4).collect()}
    assert got[3].v is None and got[3].SYS_CHANGE_OPERATION == "D" and got[1].v == "a" and len(got[1]) == 6
    assert ct.changes_since(base, changes, ["x"], 4, until=5).count() == 1
    assert ct.as_changes(base, ["x"]).first().SYS_CHANGE_OPERATION == "I"


def test_sizing():
    assert sizing.cost_shard_size(0.1) == 1.0 and sizing.cost_shard_size(1) == 1 and sizing.cost_shard_size(1e9) == 1000
    assert sizing.files_per_shard(None) == 103 and sizing.files_per_shard(1) == 10_000 and sizing.shard_count(1280, 1) == 10
    assert sizing.row_bytes(T.StructType().add("a", "string").add("b", "integer")) == 28 + 64 * 2 + 60 + 4
    assert sizing.memory_bound_shape(10_000, 99, sizing.Shape(1000, 100, 50)).chunk == 25
    assert abs(sizing.jittered_seconds(10, 0.1, random.Random(1)) - 10) <= 1


def test_settings_and_exit_codes():
    document = {"streamMode": {"changeCapture": {"changeCaptureInterval": "5 seconds", "rangeLimit": 3}, "backfill": {"backfillBehavior": "Overwrite"}}, "sink": {"targetTableFullName": "a.b.c", "maintenanceSettings": {"optimizeSettings": {"batchThreshold": 4}}}, "source": {"buffering": {"bounded": {"size": 9}}}}
    found = app.Settings.from_environment({"MILLRACE__SPEC": json.dumps(document), "MILLRACE__BACKFILL": "true", "MILLRACE__STREAM_ID": "x-y"})
    assert found.target == ("a", "b", "c") and found.interval == timedelta(seconds=5) and found.maintenance.optimize == 4 and found.buffering.size == 9 and found.stream_id == "x_y"
    assert app.choose_run(found.backfilling, found.behaviour) == "backfill-overwrite" and app.choose_run(False, "x") == "stream"
    assert app.parse_rate("10 per 2 seconds") == (10, timedelta(seconds=2)) and app.parse_duration("PT1H30M") == timedelta(minutes=90)
    assert [app.exit_code(e) for e in (None, KeyboardInterrupt(), app.FatalError(), app.TransientError(), ValueError())] == [0, 0, 1, 2, 2]
    with pytest.raises(app.FatalError):
        app.table_name("a.b")


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return "ok"

    assert app.retried(flaky, sleep=lambda _: None)() == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        app.retried(lambda: (_ for _ in ()).throw(OSError()), mode="backfillOnly", sleep=lambda _: None)()


def test_bootstrap(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for name in ("s1__stage", "shard_1", "other"):
        VersionedTable(spark, f"file://{tmp_path}/staging/{name}").create(T.StructType().add("a", "long"))
    app.bootstrap(spark, f"file://{tmp_path}/staging", t, T.StructType().add("a", "long"), "s1", "backfill-overwrite")
    assert t.schema().names == ["a", k.MERGE_KEY] and sorted(p.name for p in (tmp_path / "staging").iterdir()) == ["other", "shard_1"]
    app.finalise(spark, f"file://{tmp_path}/staging", "backfill-overwrite")
    assert [p.name for p in (tmp_path / "staging").iterdir()] == ["other"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_polling_moves_on_and_stops(spark, tmp_path):
    import threading

    from millrace.streaming.pipeline import ChangeSource, poll_once, run_backfill_merge, run_polling

    rows = spark.createDataFrame([(str(v), v) for v in range(1, 10)], "merge_key string, createdon long")
    t = VersionedTable(spark, f"file://{tmp_path}/t").create(rows.schema)
    mark = lambda v: w.version_watermark(v, NOW)
    stop = threading.Event()

    def latest(before):
        if before is not None and int(before.version) >= 9:
            stop.set()
        return mark(9)

    between = lambda before, upto: rows.where((F.col("createdon") > (int(before.version) if before else 0)) & (F.col("createdon") <= int(upto.version)))
    source = ChangeSource(latest, lambda before, top: mark(min(int(top.version), (int(before.version) if before else 0) + 4)), between, lambda before: before is None or int(before.version) != 4)
    pipeline = Pipeline(t, m.upsert(), "createdon")
    assert run_polling(pipeline, source, stop, seconds=0.01) == 3
    assert sorted(r.createdon for r in t.read().collect()) == [1, 2, 3, 4, 9] and w.current(t) == mark(9) and poll_once(pipeline, source) is None
    assert run_backfill_merge(pipeline, source, None) == mark(9) and t.read().count() == 9


def test_metrics_listener():
    from types import SimpleNamespace as N

    from millrace.streaming.metrics import MetricsListener

    sent = []
    listener = MetricsListener(lambda *x: sent.append(x), {"stream_id": "s"})
    listener.onQueryProgress(N(progress=N(numInputRows=5, batchDuration=7)))
    listener.onQueryTerminated(N(exception=None))
    assert listener.totals["rows_incoming"] == 5 and listener.totals["queries_ended"] == 1 and sent[0] == ("rows_incoming", 5, {"stream_id": "s"})


def test_one_of_several_writers_commits(spark, tmp_path):
    """Four writers race for each version: just one succeeds, and no row or watermark of another is seen."""
    from concurrent.futures import ThreadPoolExecutor

    t = VersionedTable(spark, f"file://{tmp_path}/t").create(T.StructType().add("a", "long"))
    for n in range(50):
        s = t.state()

        def commit(k, s=s, n=n):
            other = VersionedTable(spark, f"file://{tmp_path}/t")
            try:
                other._commit(type(s)(s.version + 1, s.schema, s.files, s.properties | {"by": f"{n}-{k}"}))
                return k
            except CommitConflict:
                return None

        with ThreadPoolExecutor(4) as pool:
            won = [k for k in pool.map(commit, range(4)) if k is not None]
        assert len(won) == 1 and t.properties()["by"] == f"{n}-{won[0]}" and t.state().version == s.version + 1
    assert not [p for p in (tmp_path / "t" / "_meta").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_merge_keeps_untouched_files(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", rows_per_file=10, clustered=True)
    rows = spark.range(100).select(F.format_string("%03d", "id").alias("merge_key"), F.lit(1).cast("long").alias("createdon"))
    either = "merge_key string, createdon long"
    t.overwrite(rows.union(spark.createDataFrame([(None, 1)], either)))
    before = {f["path"] for f in t.state().files}
    t.merge(spark.createDataFrame([("005", 2), ("zzz", 2), (None, 3)], either), m.upsert())
    kept = before & {f["path"] for f in t.state().files}
    assert len(before) - len(kept) == 1 and t.read().count() == 103 and t.read().where("merge_key = '005' AND createdon = 2").count() == 1
    assert t.stats()["rows"] == 103
    t.merge(rows.limit(0), m.upsert())
    assert t.read().count() == 103 and VersionedTable(spark, f"file://{tmp_path}/e", clustered=True).create(rows.schema).merge(rows, m.upsert()).version == 1


def test_scans_of_many_files_list_folders(spark, tmp_path):
    """A version of many files is read by its folders without the files that are gone, and by path where it isn't known which are."""
    t = VersionedTable(spark, f"file://{tmp_path}/t", rows_per_file=10, clustered=True)
    rows = spark.range(1000).select(F.format_string("%04d", (F.col("id") * 7) % 1000).alias("merge_key"), F.lit(1).cast("long").alias("createdon"))
    t.overwrite(rows)
    bounds = sorted((f["low"], f["high"]) for f in t.state().files)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])), "files of a clustered table overlap"
    change = lambda key, version: t.merge(spark.createDataFrame([(key, version)], "merge_key string, createdon long"), m.upsert())
    for n, key in enumerate(("0500", "0500", "0007", "1000")):
        change(key, n + 2)
        state = t.state()
        paths, gone = t._scanned(state, state.files)
        assert len(paths) <= n + 2 and len(gone) <= 2
        assert t.read().count() == len({r.merge_key for r in t.read().collect()}) == (1001 if key == "1000" else 1000)
        assert t.read().where(f"merge_key = '{key}'").first().createdon == n + 2
    t.set_properties(p="1")
    t.append(rows.limit(0))
    assert t.read().count() == 1001 and t.read(0).count() == 1000
    state = t.state()
    t._commit(type(state)(state.version + 1, state.schema, state.files, state.properties))
    assert len(t._scanned(t.state(), t.state().files)[0]) > 90 and t.read().count() == 1001


def test_chunks_rewrite_their_ranges(spark, tmp_path, monkeypatch):
    """Chunks of a staged changeset are ranges of keys: all together, they rewrite each row of the target about once, however many they are."""
    import millrace.operators.table as tables
    import millrace.streaming.pipeline as pipelines
    from millrace.streaming.throughput import Shaper

    monkeypatch.setattr(pipelines, "MOST_KEYS", 5, raising=False)
    monkeypatch.setattr(tables, "MOST_KEYS", 5)
    touched, plain = [], VersionedTable._touched

    def counted(self, *a, **more):
        found = plain(self, *a, **more)
        touched.append(sum(f["rows"] for f in found[0]))
        return found

    monkeypatch.setattr(VersionedTable, "_touched", counted)
    t = VersionedTable(spark, f"file://{tmp_path}/t", rows_per_file=20, clustered=True)
    rows = spark.range(200).select(F.when(F.col("id") > 0, F.format_string("%03d", (F.col("id") * 7) % 200)).alias("merge_key"), F.lit(1).cast("long").alias("createdon"))
    t.create(rows.schema)
    pipeline = Pipeline(t, m.upsert(), "createdon", staging=f"file://{tmp_path}/staged__", shaper=Shaper("static", sizing.Shape(20, 100, 10)))
    pipeline.apply(rows)
    assert len(touched) >= 10 and sum(touched) == 0 and t.read().count() == 200 and t.read().where("merge_key IS NULL").count() == 1
    touched.clear()
    pipeline.apply(rows.where("merge_key IS NOT NULL").withColumn("createdon", F.lit(2).cast("long")))
    assert len(touched) >= 10 and sum(touched) <= 600  # files at the ends of a range are rewritten by both of its neighbours
    assert sorted(map(tuple, t.read().collect()), key=repr) == sorted([(None, 1), *((f"{k:03d}", 2) for k in range(1, 200))], key=repr)
    staged = VersionedTable(spark, f"file://{tmp_path}/s", rows_per_file=60, clustered=True)
    staged.overwrite(rows)
    parts = pipeline._parts(staged, staged.read(), 200, 20)
    assert len(parts) >= 10 and sorted((r.merge_key for p, _, _ in parts for r in p.collect()), key=repr) == sorted((r.merge_key for r in rows.collect()), key=repr)
    staged.append(rows.limit(50))
    assert staged.ranges(20) is None


def test_throttle_and_shapes(spark, tmp_path):
    from millrace.streaming.throughput import ESTIMATES, Shaper, Throttle

    clock, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    t = Throttle(100, timedelta(seconds=1), 50, sleep, lambda: clock[0])
    assert t.take(50) == 0 and t.take(100) == 1.0 and t.take(100) == 1.0 and sum(slept) == 2.0
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(T.StructType().add("a", "string"))
    table.append(spark.createDataFrame([("x" * 100,)] * 10, "a string"))
    shaper = Shaper("memoryBound", sizing.Shape(1000, 100, 50), now=lambda: clock[0])
    assert shaper.shape(table).chunk == 1000 and json.loads(table.properties()[ESTIMATES])["row_bytes"] == 28 + 64 + 40 + 200
    version = table.state().version
    shaper.shape(table)
    assert table.state().version == version
    clock[0] += 4000
    shaper.shape(table)
    assert table.state().version == version + 1
    assert Shaper("static", sizing.Shape(7, 8, 9)).shape(table) == sizing.Shape(7, 8, 9)


def test_runner_maps_failures(spark, tmp_path):
    from millrace.streaming import runner

    run = lambda document, kind: runner.run_from_settings(spark, document, f"file://{tmp_path}", "s", kind, until_caught_up=True)
    assert run({}, "unknown") == 1 and run({"sink": {"targetTableFullName": "a.b"}}, "files") == 1
    assert run({"retryMode": "never", "source": {"configuration": {"format": "parquet", "path": f"{tmp_path}/absent", "keys": ["a"]}}}, "files") == 2


def test_run_goes_on_where_it_stopped(spark, tmp_path):
    """A file stream runs twice: the second run takes only what came later; metrics and maintenance run along."""
    import os

    from millrace.streaming import runner

    folder, sent = f"file://{tmp_path}", []
    document = {"sink": {"targetTableFullName": "a.b.c", "maintenanceSettings": {"optimizeSettings": {"batchThreshold": 1}}}, "source": {"configuration": {"format": "parquet", "path": f"{folder}/in", "keys": ["x"]}}}
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, "x long, v string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for p in (tmp_path / "in").glob("*.parquet"):
            if p.stat().st_mtime > 1_900_000_000 or p.stat().st_mtime > 1_000_000_100 + n:
                os.utime(p, (1_000_000_000 + n * 50, 1_000_000_000 + n * 50))
        assert runner.run_from_settings(spark, document, folder, "s-1", "files", sink=lambda *x: sent.append(x), until_caught_up=True) == 0
    t = VersionedTable(spark, f"{folder}/a/b/c")
    assert {r.x: r.v for r in t.read().collect()} == {1: "a", 2: "c", 3: "d"} and w.current(t) == w.file_watermark(1_000_000_050)
    assert {"rows.staged", "batch.merge_duration", "watermark.updates"} <= {n for n, _, _ in sent} and all(tags["stream_id"] == "s-1" for _, _, tags in sent)
    assert not [p for p in (tmp_path / "staging").iterdir()] if (tmp_path / "staging").exists() else True


def test_statsd_sink():
    import socket

    from millrace.streaming.metrics import Metrics, statsd

    server = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    server.bind(("127.0.0.1", 0))
    server.settimeout(5)
    metrics = Metrics(statsd(f"127.0.0.1:{server.getsockname()[1]}"), {"stream_id": "s"})
    metrics.count("rows.staged", 3)
    with metrics.timed("batch.stage_duration"):
        pass
    assert server.recv(200) == b"millrace.stream.rows.staged:3|c|#stream_id:s" and server.recv(200).split(b":")[0] == b"millrace.stream.batch.stage_duration"


def test_jdbc_options_and_scalars(spark):
    whole = ct.jdbc_options("jdbc:x", "SELECT 1", 500)
    assert whole == {"url": "jdbc:x", "fetchsize": "500", "query": "SELECT 1"}
    parts = ct.jdbc_options("jdbc:x", "SELECT a FROM t", split=("a", 1, 99, 4))
    assert "query" not in parts and parts["dbtable"] == "(SELECT a FROM t) q" and (parts["partitionColumn"], parts["lowerBound"], parts["upperBound"], parts["numPartitions"]) == ("a", "1", "99", "4")
    assert r.scalar(spark.range(7, 8)) == 7 and r.scalar(spark.range(0)) is None
    for wrong in (spark.range(2), spark.range(1).selectExpr("id", "id AS b")):
        with pytest.raises(ValueError):
            r.scalar(wrong)


def test_documented_limits_of_keys(spark):
    a, b = "x" * 128 + "a", "x" * 128 + "b"
    df = spark.createDataFrame([(a, "1", "23"), (b, "12", "3")], "k string, p string, q string")
    assert df.select(k.hashed_key("k")).distinct().count() == 1 and df.select(k.hashed_key("k", most_chars=None)).distinct().count() == 2
    assert df.select(k.blob_key(df, ["p", "q"])).distinct().count() == 1 and df.select(k.blob_key(df, ["p", "q"], separator="#")).distinct().count() == 2
