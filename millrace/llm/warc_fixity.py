"""Merkle fixity audit of WARC replicas.

A record's digest is the SHA-256 of its bytes. Records lie at offsets of files; a leaf covers a range of ``SPAN`` bytes of
a file and hashes its records' (offset, length, digest) in order, and each node above hashes up to ``FANOUT`` children in
order, up to the file's root. Above the files, nodes go by the first bits of the hash of the file's name, up to one root.
Two replicas are compared from the root down: a level is compared only below nodes that differ, and only the records of
differing leaves are compared one by one. There, records that have only moved in their file, as all do behind a lost one,
are matched by their digests and are no damage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import in_order, read, written

SPAN = 1 << 18
FANOUT = 16
RECORDS_PER_FILE = 1_000
NULL_FILES = 1_024


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """The bytes of a WARC resource record; nulls are written as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _hashed(children: DataFrame, by: list[str], *fields: str) -> DataFrame:
    """Nodes from their children, in order; a node's children are bounded by the span, the fanout or the bits of a hash."""
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    return children.groupBy(*by).agg(F.sha2(F.concat_ws("|", F.transform(listed, lambda r: F.concat_ws(",", *(r[f].cast("string") for f in fields)))), 256).alias("digest"))


def tree_heights(replicas: list[DataFrame], span: int = SPAN, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels above the leaves within files, and above the files: enough for the largest file and for all names."""
    bits = fanout.bit_length() - 1
    both = replicas[0].select("file", "offset")
    for r in replicas[1:]:
        both = both.union(r.select("file", "offset"))
    last, files = both.agg(F.max(F.expr(f"offset div {span}L")), F.approx_count_distinct("file")).first()
    return -(-int(last or 0).bit_length() // bits), -(-int(files // fanout).bit_length() // bits)


def merkle_levels(records: DataFrame, heights: tuple[int, int], span: int = SPAN, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree over ``records`` (file, offset, length, digest) from the leaves to the root, in written tables.

    Levels within files have (file, node, digest), those above them (node, digest). An empty table has empty levels.
    """
    if fanout & (fanout - 1) or fanout < 2:
        raise ValueError("the fanout must be a power of two")
    bits = fanout.bit_length() - 1
    levels = [written(_hashed(records.withColumn("node", F.expr(f"offset div {span}L")), ["file", "node"], "offset", "length", "digest"), "merkle-leaves")]
    for _ in range(heights[0]):
        levels.append(written(_hashed(levels[-1].withColumnsRenamed({"node": "child"}).withColumn("node", F.shiftright("child", bits)), ["file", "node"], "child", "digest"), "merkle-file"))
    place = _bucket(F.col("file"), heights[1], bits)
    above = levels[-1].select(place.alias("node"), "file", "digest")
    levels.append(written(_hashed(above, ["node"], "file", "digest"), "merkle-names"))
    for _ in range(heights[1]):
        levels.append(written(_hashed(levels[-1].withColumnsRenamed({"node": "child"}).withColumn("node", F.shiftright("child", bits)), ["node"], "child", "digest"), "merkle-top"))
    return levels


def _bucket(file: Column, levels: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(file.cast("string")), 64 - levels * bits) if levels else F.lit(0).cast("long")


def differing_leaves(left: list[DataFrame], right: list[DataFrame], heights: tuple[int, int], fanout: int = FANOUT) -> DataFrame | None:
    """(file, node) of the leaves that differ, found from the root down; None where the roots are equal."""
    bits, below = fanout.bit_length() - 1, None
    for level in range(len(left) - 1, -1, -1):
        keys = ["node"] if level > heights[0] else ["file", "node"]
        a, b = left[level], right[level]
        if below is not None:
            if level > heights[0]:
                up = {"up": F.shiftright("node", bits)}
            elif level == heights[0]:
                up = {"up": _bucket(F.col("file"), heights[1], bits)}
            else:
                up = {"file_up": F.col("file"), "up": F.shiftright("node", bits)}
            only = below.select(*(F.col("file" if k == "file_up" else "node").alias(k) for k in up))
            a, b = (x.withColumns(up).join(only, list(up), "left_semi") for x in (a, b))
        a, b = a.select(*keys, F.col("digest").alias("da")), b.select(*keys, F.col("digest").alias("db"))
        below = written(a.join(b, keys, "full_outer").where("NOT (da <=> db)").select(*keys), "differing")
        if below.isEmpty():
            return None
    return below


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> DataFrame:
    """Damaged records: file, offset, found_offset, length, expected, found, damage (altered, missing or extra).

    Both tables have file (a number or a name), offset, length, digest, none of them null, and may have record_id, which
    then tells which record an altered one was; without it, its offset does. Equal replicas give no rows, and then nothing
    but the trees is read. A record with the same bytes at another offset of the file is no damage. Repeated rows count as
    often as they come; other columns are ignored; an empty table lacks all records of the other.
    """
    own = ["file", "offset", "length", "digest", "record_id"]
    primary, replica = (x.select(*own[:4], (F.col("record_id") if "record_id" in x.columns else F.lit(None)).cast("string").alias("record_id")) for x in (primary, replica))
    heights = tree_heights([primary, replica], span, fanout)
    leaves = differing_leaves(merkle_levels(primary, heights, span, fanout), merkle_levels(replica, heights, span, fanout), heights, fanout)
    sides = primary.withColumn("n", F.lit(1)).union(replica.withColumn("n", F.lit(-1)))
    if leaves is None:
        sides = sides.limit(0)
    else:
        sides = sides.withColumn("node", F.expr(f"offset div {span}L")).join(leaves, ["file", "node"], "left_semi")
    # records of one side only, with their number; then those whose bytes lie elsewhere in the file go, in pairs
    single = sides.groupBy(*own).agg(F.sum("n").alias("n")).where("n <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int")))).withColumn("side", F.signum("n"))
    order = [F.col(c) for c in ("offset", "length", "record_id", "copy")]
    single = single.withColumn("k", F.row_number().over(Window.partitionBy("file", "digest", "side").orderBy(*order)))
    alone = single.withColumn("met", F.count("*").over(Window.partitionBy("file", "digest", "k"))).where("met = 1")
    alone = alone.withColumn("which", F.coalesce("record_id", F.concat(F.lit("@"), F.col("offset").cast("string"))))
    alone = alone.withColumn("k", F.row_number().over(Window.partitionBy("file", "which", "side").orderBy(*order)))
    left = lambda c: F.max(F.when(F.col("side") > 0, F.col(c)))
    right = lambda c: F.max(F.when(F.col("side") < 0, F.col(c)))
    pairs = alone.groupBy("file", "which", "k").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("l", left), ("r", right)) for c in ("offset", "length", "digest")))
    damage = F.when(F.col("r_digest").isNull(), "missing").when(F.col("l_digest").isNull(), "extra").otherwise("altered")
    return pairs.select(
        "file", F.coalesce("l_offset", "r_offset").alias("offset"), F.col("r_offset").alias("found_offset"), F.coalesce("l_length", "r_length").alias("length"), F.col("l_digest").alias("expected"), F.col("r_digest").alias("found"), damage.alias("damage")
    )


def with_offsets(records: DataFrame, order: list[str], lengths: dict[str, str], rows_per_range: int = 100_000) -> DataFrame:
    """Adds running sums of lengths within files: {new column: length column}. A file of any number of rows is summed in ranges."""
    n = records.count()
    ranged = in_order(records, ["file", *order], max(16, n // rows_per_range)).withColumn("__id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("__range", F.shiftright("__id", 33)), "ordered-records")
    before = Window.partitionBy("__range", "file").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range", "file").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"__sum_{k}") for k, c in lengths.items()))
    earlier = Window.partitionBy("file").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__range", "file", *(F.coalesce(F.sum(f"__sum_{k}").over(earlier), F.lit(0)).alias(f"__base_{k}") for k in lengths))
    out = ranged.withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in lengths.items()}).join(bases, ["__range", "file"])
    return out.withColumns({k: F.col(k) + F.col(f"__base_{k}") for k in lengths}).drop("__id", "__range", *(f"__base_{k}" for k in lengths))


def placed_records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """page_id, file, offset, length, digest, replica_offset, replica_length, replica_digest: pages as records of files of ``per_file`` ids.

    The replica has damage for the audit to find: of the pages with a page_id divisible by 101 the payload is cut in half,
    by 103 its first letter e is changed, by 107 the record is missing; its other records follow on without a gap. Rows
    without page_id lie in the files below NULL_FILES by their checksum. Only ids, lengths and digests are shuffled.
    """
    page, url, body = F.col("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    damaged = F.when(page % 101 == 0, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).when(page % 103 == 0, F.regexp_replace(body, "^([^e]*)e", "$1E")).otherwise(body)
    record, copy = warc_record(page, url, body), warc_record(page, url, damaged)
    there = F.coalesce(page % 107 != 0, F.lit(True))
    own = pages.select(page.cast("long").alias("page_id"), url.alias("url"), F.col("html").alias("html")).select(
        "page_id", F.coalesce(F.expr(f"page_id div {per_file}L") + NULL_FILES, F.pmod(F.crc32(record.cast("binary")), F.lit(NULL_FILES))).alias("file"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
        F.when(there, F.octet_length(copy).cast("long")).alias("replica_length"), F.when(there, F.sha2(copy, 256)).alias("replica_digest"),
    )
    return with_offsets(written(own, "digests"), ["page_id", "length", "digest"], {"offset": "length", "replica_offset": "replica_length"})


def op3_merkle_fixity(spark, sf_dir):
    records = written(placed_records(read(spark, sf_dir, "pages")), "records")
    primary = records.select("file", "offset", "length", "digest", F.col("page_id").alias("record_id"))
    replica = records.where("replica_digest IS NOT NULL").select("file", F.col("replica_offset").alias("offset"), F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest"), F.col("page_id").alias("record_id"))
    found = audit(primary, replica)
    return found.join(records.select("page_id", "file", "offset"), ["file", "offset"]).select("page_id", "file", "offset", "length", "expected", "found", "damage")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, page_id // 1000 + 1024 AS file, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, CASE WHEN page_id % 101 = 0 THEN substr(html, 1, (length(html) // 2)::BIGINT) WHEN page_id % 103 = 0 THEN regexp_replace(html, '^([^e]*)e', '\1E') ELSE html END AS copy FROM p),
r AS (SELECT page_id, file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
 || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, copy FROM q),
s AS (SELECT page_id, file, head || strlen(html)::VARCHAR || gap || html || gap AS rec, head || strlen(copy)::VARCHAR || gap || copy || gap AS rep FROM r),
d AS (SELECT page_id, file, strlen(rec) AS length, sha256(rec) AS expected, CASE WHEN page_id % 107 = 0 THEN NULL ELSE sha256(rep) END AS found FROM s),
o AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, length, expected ROWS UNBOUNDED PRECEDING) - length AS pos FROM d)
SELECT page_id, file::BIGINT AS file, pos::BIGINT AS "offset", length::BIGINT AS length, expected, found, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS damage FROM o WHERE found IS NULL OR found <> expected
"""
