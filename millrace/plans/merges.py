"""Queries of reduction and MERGE."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.keys import hashed_key
from millrace.operators import merge as m
from millrace.operators.reduce import latest_live, latest_per_key, latest_then_live
from millrace.plans.registry import events, query, table

SPLIT, SPLIT_US = "TIMESTAMP_NTZ'2024-01-16 00:00:00'", 1_705_363_200_000_000
_E = "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events"


@query(f"SELECT * FROM ({_E}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key_events(spark, sf_dir):
    return latest_per_key(events(spark, sf_dir), "user_id", "event_id")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"""SELECT {_LINE}, epoch_us(l_shipdate) AS ship_us FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""")
def latest_per_key_lineitem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_LINE.split(", "), F.expr("unix_micros(cast(l_shipdate as timestamp))").alias("ship_us"))
    return latest_per_key(rows, ["l_orderkey", "l_linenumber"], "ship_us", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])


@query(f"SELECT * FROM ({_E}) WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_live_events(spark, sf_dir):
    return latest_live(events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")


@query(f"SELECT * FROM (SELECT * FROM ({_E}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def latest_then_live_events(spark, sf_dir):
    return latest_then_live(events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")


def _keyed(df):
    return df.select(hashed_key("user_id").alias("merge_key"), F.col("event_id").alias("versionnumber"), (F.col("event_type") == "error").alias("IsDelete"), "user_id", "event_type", "value")


def event_sides(spark, sf_dir):
    """An earlier snapshot of live rows, and the later changes, both keyed and reduced."""
    e = table(spark, sf_dir, "events")  # the bound is on the stored column, so that it reaches the scan
    base = latest_live(_keyed(e.where(f"ts < {SPLIT}")), "merge_key", "versionnumber", F.col("IsDelete"))
    return base, latest_per_key(_keyed(e.where(f"ts >= {SPLIT}")), "merge_key", "versionnumber")


def utf16_sha(expression: str) -> str:
    return f"sha256(unhex(regexp_replace(hex({expression}), '(..)', '\\100', 'g')))"


_SIDES = f"""WITH e AS (SELECT {utf16_sha('user_id::VARCHAR')} AS merge_key, event_id AS versionnumber, event_type = 'error' AS IsDelete, user_id, event_type, value, epoch_us(ts) AS us FROM events),
t AS (SELECT * EXCLUDE (us) FROM e WHERE us < {SPLIT_US} AND NOT IsDelete QUALIFY row_number() OVER (PARTITION BY merge_key ORDER BY versionnumber DESC) = 1),
s AS (SELECT * EXCLUDE (us) FROM e WHERE us >= {SPLIT_US} QUALIFY row_number() OVER (PARTITION BY merge_key ORDER BY versionnumber DESC) = 1) """
_TOMB = """SELECT t.* FROM t LEFT JOIN s ON t.merge_key = s.merge_key WHERE s.merge_key IS NULL OR (NOT s.IsDelete AND NOT s.versionnumber > t.versionnumber)
 UNION ALL SELECT s.* FROM s LEFT JOIN t ON t.merge_key = s.merge_key WHERE NOT s.IsDelete AND (t.merge_key IS NULL OR s.versionnumber > t.versionnumber)"""


@query(_SIDES + _TOMB)
def merge_tombstone(spark, sf_dir):
    return m.merge(*event_sides(spark, sf_dir), m.tombstone())


@query(_SIDES + _TOMB)
def merge_tombstone_small_source(spark, sf_dir):
    return m.merge_small_source(*event_sides(spark, sf_dir), m.tombstone())


@query(_SIDES + _TOMB)
def merge_replay_idempotent(spark, sf_dir):
    base, changes = event_sides(spark, sf_dir)
    return m.merge(m.merge(base, changes, m.tombstone()), changes, m.tombstone())


@query(_SIDES + """SELECT t.* FROM t LEFT JOIN s ON t.merge_key = s.merge_key WHERE s.merge_key IS NULL OR NOT s.versionnumber > t.versionnumber
 UNION ALL SELECT s.* FROM s LEFT JOIN t ON t.merge_key = s.merge_key WHERE t.merge_key IS NULL OR s.versionnumber > t.versionnumber""")
def merge_upsert(spark, sf_dir):
    return m.merge(*event_sides(spark, sf_dir), m.upsert(version="versionnumber"))


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def order_sides(spark, sf_dir, version="1L", operation="CASE o_orderkey % 10 WHEN 0 THEN 'D' WHEN 1 THEN 'U' ELSE 'I' END", kinds="o_orderkey % 10 IN (0, 1, 2)", base_version="1L", key="o_orderkey"):
    """orders as the target, and changes: keys ending in 0 deleted, in 1 updated, in 2 inserted under new keys."""
    o = table(spark, sf_dir, "orders").select(*_ORDER.split(", "))
    target = o.withColumn("ver", F.expr(base_version)).withColumn("op", F.lit("I"))
    changes = o.where(kinds).select(F.expr(f"CASE WHEN o_orderkey % 10 = 2 THEN o_orderkey + 1000000000 ELSE {key} END").alias("o_orderkey"), "o_custkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.expr(version).alias("ver"), F.expr(operation).alias("op"))
    return target, changes


_CT = m.change_tracking(key="o_orderkey", operation="op", version="ver")


def _orders_oracle(version="2", operation="CASE o_orderkey % 10 WHEN 0 THEN 'D' WHEN 1 THEN 'U' ELSE 'I' END", base_version="1", key="o_orderkey", on="t.o_orderkey = s.o_orderkey"):
    return f"""WITH t AS (SELECT {_ORDER}, {base_version}::BIGINT AS ver, 'I' AS op FROM orders),
s AS (SELECT CASE WHEN o_orderkey % 10 = 2 THEN o_orderkey + 1000000000 ELSE {key} END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, {version}::BIGINT AS ver, {operation} AS op FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)),
j AS (SELECT t, s, t.op IS NOT NULL AS in_t, s.o_custkey IS NOT NULL AS in_s FROM t FULL JOIN s ON {on}),
r AS (SELECT CASE WHEN in_t AND in_s AND coalesce(s.op = 'D', false) THEN NULL WHEN in_t AND in_s AND coalesce(s.op <> 'D' AND s.ver > t.ver, false) THEN
 {{'o_orderkey': t.o_orderkey, 'o_custkey': s.o_custkey, 'o_orderstatus': s.o_orderstatus, 'o_totalprice': s.o_totalprice, 'ver': s.ver, 'op': s.op}} WHEN in_t THEN t WHEN coalesce(s.op <> 'D', false) THEN s END AS x FROM j)
SELECT x.o_orderkey, x.o_custkey, x.o_orderstatus, x.o_totalprice, x.ver, x.op FROM r WHERE x IS NOT NULL"""


@query(_orders_oracle())
def merge_change_tracking(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="2L"), _CT)


@query(_orders_oracle(version="0", operation="'U'"))
def merge_stale_update(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="0L", operation="'U'"), _CT)


@query(_orders_oracle(version="0", operation="'D'"))
def merge_stale_delete(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="0L", operation="'D'"), _CT)


@query(_orders_oracle(operation="NULL::VARCHAR"))
def merge_null_op(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="2L", operation="cast(NULL as string)"), _CT)


@query(_orders_oracle(version="CASE WHEN o_orderkey % 20 = 1 THEN NULL ELSE 2 END"))
def merge_null_version(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="CASE WHEN o_orderkey % 20 = 1 THEN NULL ELSE 2L END"), _CT)


@query(_orders_oracle(key="CASE WHEN o_orderkey % 20 = 1 THEN NULL ELSE o_orderkey END"))
def merge_null_key(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="2L", key="CASE WHEN o_orderkey % 20 = 1 THEN NULL ELSE o_orderkey END"), _CT)


@query(_orders_oracle(on="t.o_orderkey = s.o_orderkey AND (t.o_orderstatus = s.o_orderstatus OR s.o_orderstatus IS NULL)"))
def merge_partition_residual(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="2L"), m.change_tracking(key="o_orderkey", operation="op", version="ver", partition_keys=("o_orderstatus",)))


@query(_orders_oracle(on="t.o_orderkey = s.o_orderkey AND t.o_orderstatus IN ('O', 'F')"))
def merge_partition_in_list(spark, sf_dir):
    return m.merge(*order_sides(spark, sf_dir, version="2L"), m.change_tracking(key="o_orderkey", operation="op", version="ver", partition_values={"o_orderstatus": ["O", "F"]}))
