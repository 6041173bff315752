import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import warc_fixity as wf
from millrace.llm.common import read, written
from millrace.llm.drr_packing import SEQUENCE


def test_op3_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, wf.op3_merkle_fixity(spark, sf).collect())) == sorted(c.sql(wf.ORACLE_SQL).fetchall())


def _records(spark, n=400):
    return spark.range(n).select((F.col("id") % 5).alias("file"), (F.col("id") * 3000).alias("offset"), F.lit(3000).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))


def test_audit_finds_each_kind_of_damage(spark):
    a = _records(spark)
    b = a.where("offset <> 300000").withColumn("digest", F.when(F.col("offset") == 600_000, "x").otherwise(F.col("digest")))
    b = b.union(spark.createDataFrame([(3, 10**9, 5, "new")], "file long, offset long, length long, digest string"))
    got = sorted((r.file, r.offset, r.length, r.damage) for r in wf.audit(a, b, span=16_384, fanout=4).collect())
    assert got == [(0, 300_000, 3000, "missing"), (0, 600_000, 3000, "altered"), (3, 10**9, 5, "extra")]


def test_audit_edges(spark):
    a = _records(spark)
    assert wf.audit(a, a).count() == 0 and wf.audit(a.limit(0), a.limit(0)).count() == 0
    assert wf.audit(a, a.limit(0)).where("damage = 'missing'").count() == 400 and wf.audit(a.limit(0), a).where("damage = 'extra'").count() == 400
    assert wf.audit(a.union(a), a).count() == 400
    one = spark.createDataFrame([(0, 0, 1, "d")], "file long, offset long, length long, digest string")
    assert wf.audit(one, one.withColumn("digest", F.lit("e"))).count() == 1


def test_records_of_odd_pages(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, "u", "", 1), (1, "u", "é" * 50_000, 1), (1, "u", "é" * 50_000, 1)], "page_id long, url string, html string, offset int")
    got = wf.placed_records(df).orderBy("file", "offset").collect()
    assert [r.page_id for r in got] == [None, None, 1, 1] and got[0].file < wf.NULL_FILES and got[2].file == got[3].file == wf.NULL_FILES
    assert got[2].offset == 0 and got[3].offset == got[2].length > 100_000


def test_records_of_any_id(spark):
    """Hashed ids and one page that half of the rows repeat."""
    ids = [2**62, -(2**62), 12_345, *range(5)] + [7] * 500
    df = spark.createDataFrame([(k, "u", f"body {n}") for n, k in enumerate(ids)], "page_id long, url string, html string")
    got = wf.placed_records(df)
    assert got.count() == len(ids)
    ends = {}
    for r in got.orderBy("file", "offset").collect():
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
    a = got.select("file", "offset", "length", "digest")
    assert wf.audit(a, a.where("file <> 1024")).where("damage = 'missing'").count() == 505


def test_warc_folders(spark, tmp_path):
    """A record removed from the middle, one cut, one that is broken: the records after them have moved and are no damage."""
    from millrace.llm import warc_files as wa

    pages = spark.createDataFrame([(f"f{k % 2}", f"{k:04d}", f"http://x/{k}", (f"page {k} " * (k + 1)).encode()) for k in range(60)] + [("f0", None, None, None)], "file string, record_id string, uri string, payload binary")
    for kind in (True, False):
        a, b = f"file://{tmp_path}/a{kind}", f"file://{tmp_path}/b{kind}"
        made = wa.write_warc(pages, a, kind).collect()
        back = wa.read_warc(spark, a)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made)) and len(made) == 61 and wa.audit_folders(spark, a, a).count() == 0
        other = pages.where("record_id IS NULL OR record_id <> '0020'").withColumn("payload", F.when(F.col("record_id") == "0031", F.substring("payload", 1, 9)).otherwise(F.col("payload")))
        wa.write_warc(other, b, kind).collect()
        found = [(r.file[:2], r.damage, r.length) for r in wa.audit_folders(spark, a, b).collect()]
        of = {r.record_id: r for r in made}
        assert sorted(found) == sorted([("f0", "missing", of["urn:page:0020"].length), ("f1", "altered", of["urn:page:0031"].length)])
        broken = next(p for p in (tmp_path / f"b{kind}").iterdir() if p.name.startswith("f1"))
        raw, hit = bytearray(broken.read_bytes()), of["urn:page:0011"]
        raw[hit.offset + 2] ^= 0x55
        broken.write_bytes(bytes(raw))
        found = {(r.damage, r.offset) for r in wa.audit_folders(spark, a, b).where("file LIKE 'f1%'").collect()}
        assert {("missing", hit.offset), ("altered", of["urn:page:0031"].offset)} <= found | {("missing", hit.offset) for d, o in found if d == "altered" and o == hit.offset}
        assert wa.read_warc(spark, b).where("digest = 'unreadable'").count() >= 1
    assert wa.write_warc(pages.limit(0), f"file://{tmp_path}/c").count() == 0 and wa.read_warc(spark, f"file://{tmp_path}/c").count() == 0


def test_pipeline_stages(spark):
    """Each stage against what is left of its own input; decisions take effect and clean documents stay."""
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    columns, tables = docs.columns, [docs]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], sf), "stage"))
        assert name == "packing" or tables[-1].columns == columns
    ids = [{r.doc_id for r in t.select("doc_id").distinct().collect()} for t in tables]
    assert ids[0] > ids[1] >= ids[2] > ids[3] > ids[4] == ids[5]

    from millrace.llm.oph_minhash import near_duplicates
    from millrace.llm.suffix_decontam import contamination
    from tests.llm.test_duplicates import plain_components, plain_hits

    texts = {r.doc_id: r.text for r in tables[2].collect()}
    assert ids[3] == {i for i, (_, c) in plain_components(texts, 5).items() if i == c}
    assert near_duplicates(tables[3], 5).where("NOT kept").count() == 0
    assert contamination(tables[4], read(spark, sf, "benchmark")).where("contaminated").count() == 0
    assert tables[2].where("n_chars <> length(text)").count() == 0
    last = tables[5].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert last.where(F.col("n") != SEQUENCE).count() <= 1 and plain_hits("", [])[1] == 0


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, a very long text, clashing extra columns; and no rows at all."""
    good = " ".join(f"word{k} goes{k} on" for k in range(40))
    rows = [(1, good, "en", "a", 9, 7, "x"), (1, good, "en", "a", 9, 7, "x"), (None, good + " more", None, None, None, None, None), (2, None, "en", "a", 0, 7, "x"), (3, "", "en", "b", 0, 7, "x"), (4, " ".join(f"w{k}" for k in range(30_000)), "en", "b", 1, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, gone string")
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES:
            before, kept = kept, written(stage(spark, kept, sf), "odd")
            assert stage is corpus_pipeline.packing or kept.columns == before.columns
        ids = {r.doc_id for r in kept.select("doc_id").distinct().collect()}
        assert ids == ({1, None, 4} if table is docs else set())


def test_pipeline_removes_short_boilerplate(spark):
    rows = [(k, f"Own {k}.\n\nAll rights reserved.\n著作権はすべて当社に帰属します。\nNine.", "en", f"site{k}", 0) for k in range(9)]
    rows += [(k, f"Own {k}.\n\nAll rights reserved.\n著作権はすべて当社に帰属します。", "en", f"site{k}", 0) for k in range(9, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got[0] == rows[0][1] and got[8] == "Own 8.\n\nNine." and got[11] == "Own 11.\n"


def test_pipeline_marks_lines_once(spark, sf):
    """The filter on the text that is left doesn't mark lines again, in Python workers of its own."""
    out = corpus_pipeline.line_dedup(spark, read(spark, sf, "documents"), sf)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pipeline_run(spark, sf):
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(whole.columns)
