import zlib

import duckdb
import pytest

from millrace.llm import feistel_shards as fs
from millrace.llm import url_reputation as ur


def oracle(sf, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c.sql(sql).fetchall()


def test_op1_equals_sql(spark, sf):
    found = ur.op1_url_reputation(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(oracle(sf, ur.ORACLE_SQL, "pages", "labels"))


def test_op1_edges(spark):
    urls = [None, "", "no-scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.com/de/", "http://badexample.com/de/", "http://x.org/fr/1", "http://x.org?/fr/", "http://x.net", "http://x.net/a", "http://h:80/p", "a://b://c/d\ne", "http://x.net/a"]
    pages = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, rate double")
    labels = spark.createDataFrame([(4, 1, 0, "x"), (4, 0, None, "x"), (None, 1, 0, "x"), (5, None, 1, "x")], "doc_id long, quality int, toxic int, host string")
    got = {r.page_id: r for r in ur.judge_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    assert [(got[k].host, got[k].path) for k in (0, 1, 2)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4].rule == "example.com/de/" and got[4].verdict == "block" and got[5].rule is None
    assert got[6].rule == "org/fr/" and got[7].rule is None and got[7].path == "" and got[8].rule is None and got[9].rule == "net/"
    assert got[10].host == "h:80" and (got[11].host, got[11].path) == ("b:", "//c/d\ne")
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert ur.judge_urls(pages.limit(0), labels).count() == 0
    assert ur.judge_urls(pages, labels.limit(0)).where("rate <> 0.5").count() == 0


def test_op1_reputation_shrinks(spark):
    """Few outcomes lean on the domain's, many on the host's own."""
    rows = [("a.good.com", 1, 400), ("b.good.com", 1, 400), ("c.good.com", 0, 1), ("a.bad.com", 0, 400), ("b.bad.com", 0, 300), ("new.bad.com", 0, 0), ("new.good.com", 0, 0)]
    pages, labels, k = [], [], 0
    for host, good, n in rows:
        for _ in range(max(1, n)):
            pages.append((k, f"http://{host}/"))
            if n:
                labels.append((k, good, 0))
            k += 1
    got = {r.host: r.verdict for r in ur.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got["a.good.com"] == got["b.good.com"] == "allow" and got["a.bad.com"] == got["new.bad.com"] == "block"


def test_op2_equals_plain_permutation(spark, sf):
    rows = fs.op2_feistel_shards(spark, sf).collect()
    n = len(rows)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    order = {d: k for k, d in enumerate(sorted(texts))}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.row_number) == (len(raw) + 16, zlib.crc32(raw), order[r.doc_id])
        place = fs.permute_number(r.row_number, n, 7)
        assert (r.shard, r.slot, r.law, r.grown_shard) == (place % 40, place // 40, "rows", None)
    assert sorted(r.slot * 40 + r.shard for r in rows) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 37, 400])
def test_feistel_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r.p for r in spark.range(n).select(fs.feistel_place("id", n, 3).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and got == [fs.permute_number(k, n, 3) for k in range(n)]
    assert F is not None


def test_op2_edges(spark):
    rows = [(None, None), (None, "x"), (5, "é"), (5, "é"), (-3, ""), (2**62, "long" * 10_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    got = fs.assign_shards(df, 4).collect()
    assert len(got) == 6 and sorted(r.slot * 4 + r.shard for r in got) == list(range(6))
    assert {(r.doc_id, r.size) for r in got} == {(None, 16), (None, 17), (5, 18), (-3, 16), (2**62, 40_016)}
    assert fs.assign_shards(df.limit(0), 4).count() == 0


def test_op2_ids_of_any_spread(spark):
    """An outlier, hashed ids and a row that a third of the table repeats: no range has more than twice its part."""
    from pyspark.sql import functions as F

    from millrace.llm.common import in_order

    df = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") == 1, F.lit(2**62)).otherwise(F.xxhash64("id")).alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in in_order(df, ["doc_id"], 16).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 120_000 / 16
    got = fs.assign_shards(df, 4)
    assert got.agg(F.countDistinct("row_number")).first()[0] == 120_000 and got.agg(F.max("row_number")).first()[0] == 119_999
    assert got.where("doc_id = 7").agg(F.max("row_number") - F.min("row_number") + 1).first()[0] == 40_000
