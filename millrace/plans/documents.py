"""Queries of CSV, JSON, variants, lists and schemas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import json_rows as j
from millrace.operators.schema import aligned, evolved, missing_fields, union_by_name
from millrace.plans.registry import query, table
from millrace.sources.folders import folder_time_column, typed_value


@query("SELECT c_custkey, 'x' || chr(10) || c_name AS raw, 'x' || c_name AS name, c_acctbal, c_mktsegment FROM customer")
def csv_multiline_parse(spark, sf_dir):
    """Quoted fields with line feeds and commas through a CSV line and back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("x\n"), "c_name").alias("raw"), "c_acctbal", "c_mktsegment")
    line = F.to_csv(F.struct("c_custkey", "raw", "c_acctbal", "c_mktsegment"), {"quoteAll": "true"})
    back = F.from_csv(line, "c_custkey long, raw string, c_acctbal double, c_mktsegment string", {"mode": "FAILFAST"})
    return c.select(back.alias("b")).select("b.c_custkey", "b.raw", F.regexp_replace("b.raw", "\n", "").alias("name"), "b.c_acctbal", "b.c_mktsegment")


@query("SELECT c_custkey, c_nationkey::BIGINT AS nation, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, c_acctbal AS balance, c_custkey % 2 = 0 AS even FROM customer")
def csv_typed_values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = {"nation": F.col("c_nationkey").cast("string"), "name": F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")), "balance": F.col("c_acctbal").cast("string"), "even": (F.col("c_custkey") % 2 == 0).cast("string")}
    kinds = {"nation": T.LongType(), "name": T.StringType(), "balance": T.DoubleType(), "even": T.BooleanType()}
    return c.select("c_custkey", *(typed_value(raw[n], n, kinds[n]).alias(n) for n in raw))


_PARTS = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query("""SELECT event_id, (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS sink_us, (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS plain_us, (epoch_us(ts) // 1000000 * 1000000 + 123456)::BIGINT AS zoned_us, (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS folder_us FROM events""")
def timestamp_formats(spark, sf_dir):
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    sink = typed_value(F.date_format(ts, "M/d/yyyy h:mm:ss a"), "SinkCreatedOn", T.TimestampNTZType())
    plain = typed_value(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), "modifieddatetime", T.TimestampNTZType())
    zoned = typed_value(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".1234567+00:00 ")), "createdon", T.TimestampType())
    folder = folder_time_column(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH.mm.ss"), F.lit("Z")))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", us(sink).alias("sink_us"), us(plain).alias("plain_us"), us(zoned).alias("zoned_us"), us(folder).alias("folder_us"))


def _bodies(spark, sf_dir):
    """Events as nested documents: {"body": {id, kind, props}}."""
    e = table(spark, sf_dir, "events")
    return e.select(F.to_json(F.struct(F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props")).alias("body"))).alias("value"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_pointer(spark, sf_dir):
    body = _bodies(spark, sf_dir).select(j.at_pointer(F.col("value"), "/body").alias("b"))
    return body.select(F.get_json_object("b", j.json_path("/event_id")).cast("long").alias("event_id"), F.get_json_object("b", j.json_path("/event_type")).alias("event_type"), F.get_json_object("b", j.json_path("/props/k")).cast("int").alias("k"))


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("value")).select(F.to_json(F.struct("conv_id", F.struct(F.col("value")).alias("nested_array"), F.lit("root").alias("role"))).alias("value"))


@query("SELECT conv_id, turn AS turn_number, role, NULL::VARCHAR AS absent FROM conversations WHERE conv_id IS NOT NULL")
def json_explode_rename(spark, sf_dir):
    """An element's role replaces the root's; the array's property leaves the root; a missing field is null."""
    schema = T.StructType().add("conv_id", "long").add("turn_number", "long").add("role", "string").add("absent", "string")
    rows = j.root_rows(_turns(spark, sf_dir), "value").drop("value")
    return j.exploded_rows(rows, "root", schema, [("/nested_array/value", {"turn": "turn_number", "role": "role"})])


@query("SELECT n_regionkey AS region, d.n_nationkey::BIGINT AS nation, x::BIGINT AS item FROM nation AS d, (SELECT unnest([1, 2, 3]) AS x)")
def json_explode_chained(spark, sf_dir):
    """Regions with an array of nations, each with an array of items."""
    n = table(spark, sf_dir, "nation").withColumn("nested", F.array(*(F.struct(F.lit(k).alias("item")) for k in (1, 2, 3))))
    docs = n.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", F.struct(F.col("nested").alias("value")).alias("nested_array"))).alias("data")).select(F.to_json(F.struct(F.col("n_regionkey").alias("region"), "data")).alias("value"))
    schema = T.StructType().add("region", "integer").add("nation", "long").add("item", "long")
    rows = j.root_rows(docs, "value").drop("value")
    return j.exploded_rows(rows, "root", schema, [("/data", {"n_nationkey": "nation"}), ("/nested_array/value", {"item": "item"})])


@query("SELECT event_id, event_type, NULL::BIGINT AS missing_number, NULL::VARCHAR AS missing_text FROM events")
def json_default_fill(spark, sf_dir):
    fields = [{"name": n, "type": ["null", t], "default": None} for n, t in (("event_id", "long"), ("event_type", "string"), ("missing_number", "long"), ("missing_text", "string"))]
    rows = j.root_rows(_bodies(spark, sf_dir), "value", "/body").drop("value")
    return j.exploded_rows(rows, "root", j.avro_schema({"type": "record", "fields": fields}))


@query("SELECT event_id, event_type, x::INTEGER AS copy FROM events, (SELECT unnest([1, 2]) AS x)")
def json_array_root(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    docs = e.select(F.to_json(F.struct(F.array(*(F.struct("event_id", "event_type", F.lit(k).alias("copy")) for k in (1, 2))).alias("body"))).alias("value"))
    rows = j.root_rows(docs, "value", "/body").drop("value")
    return j.exploded_rows(rows, "root", T.StructType().add("event_id", "long").add("event_type", "string").add("copy", "integer"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def variant_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings")
def list_type_explode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode("embedding").alias("x")).select("vec_id", "label", F.col("x").cast("double").alias("x"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events")
def union_changesets_by_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return union_by_name([e.where("event_id % 2 = 0").select("event_id", "user_id", "value"), e.where("event_id % 2 = 1").select("user_id", "event_id")])


@query("SELECT unnest(['value', 'extra']) AS name, unnest(['double', 'string']) AS kind")
def schema_missing_fields(spark, sf_dir):
    target = table(spark, sf_dir, "events").select("EVENT_ID", "user_id").schema
    source = table(spark, sf_dir, "events").select("event_id", "value", F.lit("x").alias("extra")).schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in missing_fields(target, source)], "name string, kind string")


@query("SELECT event_id, user_id, NULL::VARCHAR AS added FROM events")
def schema_align_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return aligned(e, evolved(e.schema, T.StructType().add("USER_ID", "long").add("added", "string")))
