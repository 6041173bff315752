"""Queries of keys, change tables, versions, files' sizes and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import keys as k
from millrace.functions.sizing import MOST_FILES_PER_SHARD, SHARD_BYTES, cost_shard_size_column
from millrace.operators import reduce as r
from millrace.operators.select import FieldRule, RowModifications, select_fields
from millrace.plans.merges import utf16_sha
from millrace.plans.registry import events, query, table
from millrace.sources import change_table as ct
from millrace.sources import files as fl


@query(f"SELECT o_orderkey, {utf16_sha('o_orderkey::VARCHAR')} AS merge_key FROM orders")
def merge_key_ct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", k.hashed_key("o_orderkey").alias("merge_key"))


@query(f"SELECT l_orderkey, l_linenumber, {utf16_sha("l_orderkey::VARCHAR || '#' || l_linenumber::VARCHAR")} AS merge_key FROM lineitem")
def merge_key_ct_composite(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.hashed_key("l_orderkey", "l_linenumber").alias("merge_key"))


@query("SELECT c_custkey, base64(unhex(sha256(lower(c_custkey::VARCHAR || c_name)))) AS merge_key FROM customer")
def merge_key_blob(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", k.blob_key(c, ["c_custkey", "c_name"]).alias("merge_key"))


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS merge_key FROM supplier")
def merge_key_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", k.id_key(s, "S_SUPPKEY").alias("merge_key"))


@query("SELECT c_custkey, 0::BIGINT AS createdon FROM customer")
def version_enrich_default(spark, sf_dir):
    return k.with_version(table(spark, sf_dir, "customer").select("c_custkey"), None)


def _tracked(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    base = o.where("o_orderkey % 10 <> 0")
    changes = o.where("o_orderkey % 10 IN (0, 1)").select("o_orderkey", (F.col("o_orderkey") % 100).alias(ct.VERSION), F.expr("if(o_orderkey % 10 = 0, 'D', 'U')").alias(ct.OPERATION))
    return base, changes


@query(f"""WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0),
c AS (SELECT o_orderkey, o_orderkey % 100 AS v, CASE WHEN o_orderkey % 10 = 0 THEN 'D' ELSE 'U' END AS op FROM orders WHERE o_orderkey % 10 IN (0, 1))
SELECT c.o_orderkey, c.v::BIGINT AS SYS_CHANGE_VERSION, c.op AS SYS_CHANGE_OPERATION, b.o_custkey, b.o_totalprice, 20::BIGINT AS ChangeTrackingVersion, {utf16_sha('c.o_orderkey::VARCHAR')} AS merge_key FROM b RIGHT JOIN c ON b.o_orderkey = c.o_orderkey WHERE c.v > 20 AND c.v <= 80""")
def change_projection_right_join(spark, sf_dir):
    return ct.changes_since(*_tracked(spark, sf_dir), ["o_orderkey"], after=20, until=80)


@query("SELECT 1::BIGINT AS probe, true AS has_changes UNION ALL SELECT 2, false")
def change_has_rows(spark, sf_dir):
    base, changes = _tracked(spark, sf_dir)
    some, none = (r.has_rows(ct.changes_since(base, changes, ["o_orderkey"], after=a)) for a in (20, 1000))
    return spark.range(1, 3).select(F.col("id").alias("probe"), F.when(F.col("id") == 1, F.lit(some)).otherwise(F.lit(none)).alias("has_changes"))


@query(f"SELECT o_orderkey, 0::BIGINT AS SYS_CHANGE_VERSION, 'I' AS SYS_CHANGE_OPERATION, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 7::BIGINT AS ChangeTrackingVersion, {utf16_sha('o_orderkey::VARCHAR')} AS merge_key FROM orders")
def full_scan_as_changes(spark, sf_dir):
    return ct.as_changes(table(spark, sf_dir, "orders").drop("o_orderdate"), ["o_orderkey"], version=7)


@query("""WITH c AS (SELECT 'r' || (n_regionkey)::VARCHAR AS tn, n_name AS cn, n_nationkey AS o FROM nation), t AS (SELECT 'r' || r_regionkey::VARCHAR AS tn, 'pk' || r_regionkey::VARCHAR AS pk FROM region WHERE r_regionkey < 4),
k AS (SELECT 'pk' || n_regionkey::VARCHAR AS pk, n_name AS cn FROM nation WHERE n_nationkey % 3 = 0)
SELECT c.cn AS name, k.cn IS NOT NULL AS is_primary_key FROM c LEFT JOIN t ON c.tn = t.tn LEFT JOIN k ON t.pk = k.pk AND c.cn = k.cn WHERE t.pk IS NOT NULL""")
def column_summary_left_join(spark, sf_dir):
    n, g = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    columns = n.select(F.expr("concat('r', n_regionkey)").alias("table_name"), F.col("n_name").alias("column_name"), F.col("n_nationkey").alias("ordinal"))
    constraints = g.where("r_regionkey < 4").select(F.expr("concat('r', r_regionkey)").alias("table_name"), F.expr("concat('pk', r_regionkey)").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"))
    own = n.where("n_nationkey % 3 = 0").select(F.expr("concat('pk', n_regionkey)").alias("constraint_name"), F.col("n_name").alias("key_column"))
    return ct.column_summaries(columns, constraints, own)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_join_schemas(spark, sf_dir):
    n, g = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return r.schema_tables(n, g.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "n_name", "r_name")


@query("SELECT coalesce(max(user_id), 60) AS user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id > 10 AND user_id <= 60 ORDER BY user_id LIMIT 5)")
def version_in_range(spark, sf_dir):
    return r.nth_version(events(spark, sf_dir), "user_id", 10, 60, 5)


@query("SELECT min(event_id) AS event_id FROM events WHERE epoch_us(ts) >= 1705363200000000")
def version_from_timestamp(spark, sf_dir):
    return r.version_at(events(spark, sf_dir), "event_id", "ts_us", 1_705_363_200_000_000)


@query("SELECT coalesce((SELECT min(epoch_us(ts)) FROM events WHERE event_id = 17), 0)::BIGINT AS ts_us UNION ALL SELECT 0")
def commit_time_default(spark, sf_dir):
    e = events(spark, sf_dir)
    return r.commit_time(e, "event_id", "ts_us", 17, F.lit(0)).unionAll(r.commit_time(e, "event_id", "ts_us", -5, F.lit(0)))


_FILES = "SELECT event_type || event_id::VARCHAR AS name, epoch_us(ts) // 1000000 AS created, length(props)::BIGINT AS bytes FROM events"


def _files(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat("event_type", F.col("event_id").cast("string")).alias("name"), F.expr("ts_us div 1000000").alias("created"), F.length("props").cast("long").alias("bytes"))


@query(f"SELECT coalesce(max(created), 0)::BIGINT AS created FROM ({_FILES})")
def latest_version(spark, sf_dir):
    return fl.latest_created(_files(spark, sf_dir))


@query(f"SELECT max(created)::BIGINT AS created FROM (SELECT created FROM ({_FILES}) ORDER BY created, name LIMIT 50)")
def version_range_topn(spark, sf_dir):
    return fl.latest_created(_files(spark, sf_dir), most=50)


@query(f"SELECT name, created::BIGINT AS created, bytes FROM ({_FILES}) WHERE created BETWEEN 1704500000 AND 1706000000")
def time_range_files(spark, sf_dir):
    return fl.in_time_range(_files(spark, sf_dir), 1_704_500_000, 1_706_000_000)


@query("SELECT c_custkey, c_name FROM customer")
def select_include(spark, sf_dir):
    return select_fields(table(spark, sf_dir, "customer"), FieldRule("include", ("C_CUSTKEY", "c_name"), ("c_custkey",)).check())


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def select_exclude(spark, sf_dir):
    return select_fields(table(spark, sf_dir, "customer"), FieldRule("exclude", ("C_Name", "c_acctbal"), ("c_custkey",)).check())


@query("SELECT c_custkey, c_acctbal FROM customer")
def select_include_essential(spark, sf_dir):
    return select_fields(table(spark, sf_dir, "customer"), FieldRule("include", ("c_acctbal",), ("c_custkey",)), keep_essential=True)


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def select_server_side(spark, sf_dir):
    return select_fields(table(spark, sf_dir, "customer"), FieldRule("exclude", ("c_name", "c_acctbal"), (), True).checked_keys(["c_custkey"]))


@query(r"SELECT * FROM (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE 'x' END) AS name FROM part) WHERE name LIKE 'small\_%' ESCAPE '\'")
def like_prefix_escaped(spark, sf_dir):
    """Half of the names have an underscore after the prefix, which alone may match."""
    name = F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "_").otherwise("x"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(ct.like_prefix("name", "small_"))


@query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, 8::BIGINT AS n_shards FROM orders")
def shard_modulo_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("shard", ct.shard_of(["o_orderkey"], 8))
    per = o.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("d"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_keys"), F.count("*").alias("n_shards"))


@query("SELECT event_id, strftime(unnest(generate_series(date_trunc('hour', ts), date_trunc('hour', ts + INTERVAL 3 HOUR) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)), '%Y-%m-%dT%H') AS prefix FROM events")
def hour_prefix_series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(k.hours_between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 3 HOUR"))).alias("prefix"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 100")
def sort_order_desc_nulls_last(spark, sf_dir):
    return r.highest(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", 100, ["event_id"])


@query("SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20")
def topn_distinct(spark, sf_dir):
    return r.distinct_lowest(table(spark, sf_dir, "events"), "user_id", 20)


@query("SELECT epoch_us(ts) AS ts_us, event_id FROM events WHERE epoch_us(ts) >= 1705363200000000 ORDER BY ts, event_id LIMIT 1")
def first_match_after(spark, sf_dir):
    return r.first_at_or_after(events(spark, sf_dir).select("ts_us", "event_id"), "ts_us", 1_705_363_200_000_000)


@query("SELECT l_returnflag, count(*) AS records, sum(l_linenumber)::BIGINT AS size, count(DISTINCT l_linestatus) AS partitions FROM lineitem GROUP BY l_returnflag")
def table_stats_rollup(spark, sf_dir):
    return r.file_stats(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)), "l_returnflag", "one", "l_linenumber", "l_linestatus")


@query(f"SELECT round(avg(coalesce(bytes, 104857600)), 6) AS average, count(*) AS files FROM (SELECT bytes FROM ({_FILES}) ORDER BY created DESC, name LIMIT 1000)")
def avg_file_size(spark, sf_dir):
    return r.average_size(_files(spark, sf_dir)).select(F.round("average", 6).alias("average"), "files")


@query("SELECT round(sum(l_quantity + l_linenumber), 4) AS cost FROM lineitem")
def read_cost_sum(spark, sf_dir):
    return r.read_cost(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber").select(F.round("cost", 4).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN 1 + pow(ln(l_extendedprice / 10000), 3) < 0 THEN 1 WHEN 1 + pow(ln(l_extendedprice / 10000), 3) > 1000 THEN 1000 ELSE 1 + pow(ln(l_extendedprice / 10000), 3) END, 6) AS shard_mb FROM lineitem")
def shard_cost_size(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(cost_shard_size_column(F.col("l_extendedprice") / 10000), 6).alias("shard_mb"))


@query("SELECT p_size, least(floor(10737418240 / (p_size * 1048576.0)) + 1, 10000)::BIGINT AS files FROM (SELECT DISTINCT p_size FROM part)")
def shard_files(spark, sf_dir):
    files = F.least(F.floor(F.try_divide(F.lit(float(SHARD_BYTES)), F.col("p_size") * 1_048_576.0)) + 1, F.lit(MOST_FILES_PER_SHARD))
    return table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", files.cast("long").alias("files"))


@query("SELECT user_id, list_sort(list(event_id)) AS event_id FROM events GROUP BY user_id")
def grouped_chunks(spark, sf_dir):
    return r.grouped_lists(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT event_id, round(100 * (2 / (1 + exp(-0.01 * value)) - 1), 6) AS scaled FROM events")
def scaled_sigmoid(spark, sf_dir):
    from millrace.functions.sizing import scaled_sigmoid_column

    return table(spark, sf_dir, "events").select("event_id", F.round(scaled_sigmoid_column(F.col("value"), 100, 0.01), 6).alias("scaled"))


_NAMES = "unnest(['mergeKey', 'SinkCreatedOn', 'aBcD', 'plain', 'c/d e-f'])"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ["mergeKey", "SinkCreatedOn", "aBcD", "plain", "c/d e-f"]))).alias("name"))


@query(f"SELECT n_nationkey, name, lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM (SELECT n_nationkey, {_NAMES} AS name FROM nation)")
def snake_case_names(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("snake", k.snake_case(F.col("name")))


@query(f"SELECT n_nationkey, name, regexp_replace(name, '\\W+', '', 'g') AS normal FROM (SELECT n_nationkey, {_NAMES} AS name FROM nation)")
def normalize_names(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("normal", k.normalized_name(F.col("name")))


@query("SELECT n_nationkey, lower(translate(regexp_replace('Data-Lake/2024.01:' || n_name || '//', '/+$', ''), '-.:/', '____')) AS shard FROM nation")
def name_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", k.shard_name(F.concat(F.lit("Data-Lake/2024.01:"), "n_name", F.lit("//"))).alias("shard"))


@query("SELECT event_id, (epoch_us(ts) // 1000000)::BIGINT AS seconds, ((epoch_us(ts) // 1000000) * 1000000)::BIGINT AS back_us FROM events")
def epoch_roundtrip(spark, sf_dir):
    seconds = k.epoch_seconds(F.col("ts_us"))
    return events(spark, sf_dir).select("event_id", seconds.alias("seconds"), k.epoch_micros(seconds).alias("back_us"))


@query(f"SELECT o_orderkey, o_totalprice, {utf16_sha('o_orderkey::VARCHAR')} AS row_key, 5::BIGINT AS row_version FROM orders")
def row_modifications(spark, sf_dir):
    steps = RowModifications(({"fieldSelector": {"include": {"fields": ["o_orderkey", "o_totalprice"]}}}, {"surrogateMergeKey": {"name": "row_key", "fields": ["o_orderkey"]}}, {"surrogateVersion": {"name": "row_version"}}))
    return steps.apply(table(spark, sf_dir, "orders"), version=F.lit(5).cast("long"))
