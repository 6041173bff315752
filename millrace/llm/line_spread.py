"""Line dedup by spread over sites: HyperLogLog sketches per line hash, exact counts near the threshold.

Each line hash has a HyperLogLog sketch of its sites, merged by aggregation on both sides of the shuffle. Lines whose
estimate is below half the threshold stay, those above twice the threshold are boilerplate, and those between are counted
exactly. With 2**12 registers an estimate is off by a factor of two with no practical probability at any size: few sites
are held as a list of 26-bit hashes, which is exact but for equal hashes, and beyond it the standard error is 1.6 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from millrace.llm.common import read, ship, unused, written

LOG_REGISTERS = 12
#: Lines of four words or more, as the query's SQL counts, and all lines that aren't blank.
FOUR_WORDS = r"(?:[^ \t\x0B\f\r]+[ \t\x0B\f\r]+){3}[^ \t\x0B\f\r]"
NOT_BLANK = r"[^ \t\x0B\f\r]"
#: Flagged lines that are broadcast, at 16 bytes each; with more, they are joined.
MOST_BROADCAST_ROWS = 1_000_000
#: Stand for a missing doc_id, and for lines that aren't counted.
_NO_ID, _BLANK = -(2**63), -(2**63) + 1


def sketched(rows: DataFrame, key: str, site: str) -> DataFrame:
    """Per ``key``: rows, the smallest doc_id, and the estimated number of sites; nulls are no site."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"), F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(site, LOG_REGISTERS)), F.lit(0)).alias("sites"))


def _lines(documents: DataFrame, counted: str) -> DataFrame:
    lines = documents.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike(counted)).select("doc_id", "site", F.xxhash64("line").alias("line"))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast while it is small; beyond that, a shuffled join whose hot lines the adaptive skew join splits."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST_ROWS else df


def boilerplate(documents: DataFrame, sites: int, counted: str = FOUR_WORDS) -> DataFrame:
    """(line hash, keeper) of the lines that match ``counted`` and are on ``sites`` distinct sites or more; keeper is the smallest doc_id that has the line.

    A line in fewer rows than ``sites`` can't qualify. An estimate below half the threshold or above twice the threshold
    decides; the lines between are counted exactly, by distinct (line, site).
    """
    lines = _lines(documents, counted)
    found = written(sketched(lines, "line", "site").where((F.col("n") >= sites) & (2 * F.col("sites") >= sites)), "sketches")
    far = found.where(F.col("sites") > 2 * sites).select("line", "keeper")
    near = found.where(F.col("sites") <= 2 * sites).select("line", "keeper")
    pairs = lines.join(_sized(near.select("line")), "line", "left_semi").where("site IS NOT NULL").select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count("*").alias("c")).where(F.col("c") >= sites)
    return written(far.union(near.join(exact.select("line"), "line", "left_semi")), "boilerplate")


def _gone(flagged) -> F.Column:
    """Tells, for the line hashes of a document, which are flagged and kept by another document.

    It counts as nondeterministic, so that a filter on the text that is left doesn't evaluate it again: a second one in a
    task has a Python worker of its own, and an executor keeps that for later stages.
    """

    @F.arrow_udf(ArrayType(BooleanType()))
    def gone(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lines, keepers = flagged.value
        for hashes, ids in batches:
            values = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            at = np.minimum(np.searchsorted(lines, values), max(0, len(lines) - 1))
            hit = (lines[at] == values) & (keepers[at] != own) if len(lines) else np.zeros(len(values), bool)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hit))

    return gone.asNondeterministic()


def without_boilerplate(documents: DataFrame, sites: int = 10, counted: str = FOUR_WORDS) -> DataFrame:
    """``documents`` (doc_id, text, source and any other columns) with cross-site boilerplate lines removed from text.

    A line (split at \\n, compared whole) that matches ``counted`` (four words or more, or NOT_BLANK: every line but blank
    ones, the distinct sources alone deciding) and occurs on ``sites`` distinct sites or more is removed everywhere but in
    the document with the smallest doc_id that has it, so nothing is lost altogether and one of a group of copies stays as
    it is. Other lines keep their order. Rows without source count for no site; rows without doc_id are no keepers unless
    no other has the line. Null and empty texts stay; repeated rows are treated alike; an empty table gives none. No row
    is dropped. Any threshold of 1 or more may be asked for.

    Up to MOST_BROADCAST_ROWS flagged lines are broadcast as sorted hashes, and no text is shuffled; with more, documents
    are joined with their own flagged lines, by id and text, so that rows without id don't meet in one task.
    """
    spark = documents.sparkSession
    flagged = boilerplate(documents, sites, counted)
    text = documents["text"]
    lines = F.split(text, "\n")
    if flagged.count() <= MOST_BROADCAST_ROWS:
        ship(spark)
        # 16 bytes a line, and a bounded number of them
        table = flagged.orderBy("line").toArrow()
        packed = spark.sparkContext.broadcast((table.column("line").to_numpy().astype(np.int64), table.column("keeper").fill_null(_NO_ID).to_numpy().astype(np.int64)))
        hashes = F.transform(lines, lambda x: F.when(x.rlike(counted), F.xxhash64(x)))
        known = F.transform(hashes, lambda h: F.coalesce(h, F.lit(_BLANK)))
        gone = unused(documents, "gone")
        marked = documents.withColumn(gone, _gone(packed)(known, documents["doc_id"].cast("long")))
        rest = F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col(gone), i)), "\n")
        changed = F.exists(gone, lambda x: x)
        return marked.select(*(F.when(changed, rest).otherwise(text).alias("text") if c == "text" else documents[c] for c in documents.columns))
    own = documents.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), text.alias("text"), F.xxhash64(text).alias("digest"))
    spread = own.select("doc_id", "digest", F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike(counted)).select("doc_id", "digest", F.xxhash64("x").alias("line"))
    of_id, of_text, gone = (unused(documents, x) for x in ("hit_id", "hit_text", "gone"))
    hits = (
        spread.join(flagged, "line").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(of_id), F.col("digest").alias(of_text)).agg(F.collect_set("line").alias(gone))
    )
    marked = documents.join(hits, documents["doc_id"].eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_text)), "left")
    rest = F.array_join(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone), F.xxhash64(x)) & x.rlike(counted), F.lit(False))), "\n")
    return marked.select(*(F.when(F.col(gone).isNotNull(), rest).otherwise(text).alias("text") if c == "text" else documents[c] for c in documents.columns))


def op10_line_spread(spark, sf_dir):
    """Per document: lines before, lines after, characters after, and the MD5 of what is left."""
    documents = read(spark, sf_dir, "documents")
    before = documents.select("doc_id", "text", "source", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = without_boilerplate(before)
    left = F.coalesce("text", F.lit(""))
    n_chars = F.length(left).cast("long")
    return out.select("doc_id", "n_lines", n_chars.alias("n_chars_left"), F.md5(left.cast("binary")).alias("text_md5"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, source, i, line, regexp_matches(line, '(?:[^ \t\x0B\f\r]+[ \t\x0B\f\r]+){3}[^ \t\x0B\f\r]') AS long FROM
 (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
b AS (SELECT line, min(doc_id) AS keeper FROM l WHERE long GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (SELECT l.doc_id, i, l.line, b.line IS NULL OR keeper = l.doc_id AS stays FROM l LEFT JOIN b ON l.line = b.line AND long),
t AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5 FROM t
"""
