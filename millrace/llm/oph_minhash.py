"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets and star-shaped edges.

1. Each text becomes its set of distinct word shingles (64-bit hashes). The sets' one-permutation signature takes the
   smallest hash in each of ``bands * rows`` bins; an empty bin borrows from the first full bin of its own probe sequence.
2. Texts with equal sets form a class; only its smallest doc_id goes on, so copies never meet each other.
3. Bands of the signature are buckets. A bucket links its smallest member (the hub) to the others: candidates grow with
   the bucket's size, not its square. Candidates are confirmed on the full sets, and confirmed links give components.
4. A bucket whose members then lie in several components still has pairs that no hub has seen. In a bucket of at most
   SMALL members, those outside its largest component are held against the members of other components. The members of
   larger such buckets, texts that share much without being links, are searched by exact prefix filtering: two sets that
   are similar enough share one of their rarest shingles, so their pairs don't grow with the bucket's square.

With 32 bands of 4 rows, a pair at similarity 0.8 shares no bucket with a probability of 5e-8; steps 3 and 4 lose none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textcore as tc
from millrace.llm.common import read, settled, ship, written
from millrace.llm.components import connected_components

BANDS, ROWS = 32, 4
#: Members of a bucket whose pairs may all be held against each other.
SMALL = 64
#: Rows of two longs that are broadcast at most.
MOST_BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint64(2**64 - 1)
_PROBES: dict[int, np.ndarray] = {}


def _probe(bins: np.ndarray, attempt: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tc.mix(bins.astype(np.uint64) * tc.U64(1_000_003) + tc.U64(attempt * 7_919 + 13)) % tc.U64(k)).astype(np.int64)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The densified one-permutation signature of a non-empty set, given as ascending distinct hashes."""
    bins = (((shingles >> tc.U64(32)) * tc.U64(k)) >> tc.U64(32)).astype(np.int64)
    first = np.ones(len(bins), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    out = np.full(k, _EMPTY)
    out[bins[first]] = shingles[first]
    full = out != _EMPTY
    empty = np.flatnonzero(~full)
    if len(empty):
        if k not in _PROBES:
            _PROBES[k] = np.stack([_probe(np.arange(k), a, k) for a in range(4 * k)])
        table = _PROBES[k]
        tried = 0
        while len(empty) and tried < len(table):
            block = table[tried : tried + (8 if tried < 32 else 128)][:, empty]
            ok = full[block]
            at = ok.argmax(axis=0)
            found = ok[at, np.arange(len(empty))]
            out[empty[found]] = out[block[at[found], np.flatnonzero(found)]]
            empty = empty[~found]
            tried += len(block)
        while len(empty):  # only sets of a few shingles come here
            p = _probe(empty, tried, k)
            found = full[p]
            out[empty[found]] = out[p[found]]
            empty = empty[~found]
            tried += 1
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``size`` words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, ascending.

    With fewer words, the whole sequence is one shingle; a null, an empty text and one without words have none.
    """
    for _, _, data, offsets in tc.text_slices(texts):
        data = tc.LOWER[data]
        starts, ends, first = tc.word_spans(data, offsets, tc.SPACED)
        words = tc.span_hashes(data, starts, ends)
        for k in range(len(first) - 1):
            found = tc.shingle_hashes(words[first[k] : first[k + 1]], size)
            found.sort()
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def _profiles(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, buckets = [], [], []
            for s in shingle_sets(batch.column(1), size):
                counts.append(len(s))
                if not len(s):
                    keys.append(None)
                    buckets.append(None)
                    continue
                with np.errstate(over="ignore"):
                    keys.append(np.array([tc.mix(s).sum(), np.bitwise_xor.reduce(tc.mix(s + tc.U64(0x51ED270B)))], dtype=np.uint64).tobytes())
                    parts = signature(s, bands * rows).reshape(bands, rows)
                    h = np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        h = tc.mix(h * tc.U64(0x9FB21C651E98DF25) + parts[:, r])
                buckets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "buckets"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())], names=["node", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(k) for k in range(4))
            keep, last, mine = [], None, None
            for k in range(batch.num_rows):
                raw = sa[k].as_buffer()
                if last is None or not raw.equals(last):
                    last, mine = raw, np.frombuffer(raw, dtype=np.uint64)
                other = np.frombuffer(sb[k].as_buffer(), dtype=np.uint64)
                both = np.concatenate((mine, other))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough. Each pair carries one set through one shuffle."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast a narrow table of up to MOST_BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS else df


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_buffer(), np.int64))], names=["shingle"])


def _prefixes(frequent, percent: int):
    """(shingle, place, node, component, n) of each set's first shingles in an order of all shingles, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = frequent.value
        for batch in batches:
            for node, component, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.int64)
                rank = np.zeros(len(s), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[at] == s, ranks[at], 0)
                # of n shingles, percent of n are common with any link, so one of the others and one more is
                first = np.lexsort((s, rank))[: len(s) - -(-percent * len(s) // 100) + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(s[first]), *(pa.array(np.full(k, x), pa.int64()) for x in (0, node, component, len(s)))], names=["shingle", "place", "node", "component", "n"]).set_column(1, "place", pa.array(np.arange(k)))

    return run


def crowded_pairs(crowd: DataFrame, percent: int, most_frequent: int = 1_000_000) -> DataFrame:
    """Pairs (a, b) of different components that may be links, among the sets of ``crowd`` (node, component, shingles).

    Exact for any order of the shingles; the most frequent ones, a bounded number, come last so that what many sets share
    makes no pairs. A pair is taken only if enough shingles are left behind the one it shares.
    """
    spark = crowd.sparkSession
    counts = crowd.select("shingles").mapInArrow(_exploded, "shingle long").groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    top = counts.orderBy(F.desc("c"), "shingle").limit(most_frequent).toArrow()
    hashes, c = top.column(0).to_numpy().astype(np.int64), top.column(1).to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast((hashes[order], c[order]))
    prefix = written(crowd.select("node", "component", "shingles").mapInArrow(_prefixes(frequent, percent), "shingle long, place long, node long, component long, n long"), "prefixes")
    x, y = (prefix.select("shingle", *(F.col(k).alias(f"{k}_{side}") for k in ("place", "node", "component", "n"))) for side in "xy")
    # at the first shingle that both have, in the common order, all others that both have are still to come
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    near = (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    enough = (100 + percent) * left >= percent * (F.col("n_x") + F.col("n_y"))
    return x.join(y, "shingle").where(near & enough).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def unseen_pairs(shared: DataFrame, components: DataFrame, sets: DataFrame, percent: int, small: int = SMALL) -> DataFrame:
    """Pairs (a, b) of members of one bucket that lie in different components and have not met in a star."""
    placed = shared.join(components, "node", "left").select("bucket", "node", "n", "hub", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    split = parts.groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("c"), F.sum("m").alias("m")).where("c > 1").select("bucket", "main", "m")
    rows = written(placed.join(split, "bucket"), "split")
    few = rows.where(F.col("m") <= small)
    outside = few.where("component <> main AND node <> hub").select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    others = few.where("node <> hub").select("bucket", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"))
    pairs = outside.join(others, "bucket").where(f"cx <> cy AND 100 * least(nx, ny) >= {int(percent)} * greatest(nx, ny)").select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a")).distinct()
    many = rows.where(F.col("m") > small).select("node", "component").distinct()
    if many.isEmpty():
        return pairs.select("a", "b")
    crowd = written(sets.join(_sized(many), "node"), "crowd")
    return pairs.select("a", "b").union(crowded_pairs(crowd, percent)).distinct()


def near_duplicates(documents: DataFrame, size: int, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``documents`` (doc_id, text).

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that can be reached, kept tells whether it is the row's own. Texts without words are linked with nothing. The
    texts of rows with the same doc_id are linked with each other, so that a document has one component. Rows without
    doc_id are kept, with a null component. Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    profiles = written(texts.mapInArrow(_profiles(size, bands, rows), "doc_id long, n_shingles long, set_key binary, buckets array<long>"), "profiles")

    def linked() -> DataFrame:
        known = profiles.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
        classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"))
        heads = known.select("doc_id", "set_key", "n_shingles", "buckets").join(classes.withColumnRenamed("set_key", "k"), (F.col("set_key") == F.col("k")) & (F.col("doc_id") == F.col("node")), "left_semi")
        members = heads.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
        hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub < far")
        shared = written(members.join(hubs.select("bucket", "hub"), "bucket").distinct(), "buckets")

        wanted = _sized(written(shared.select(F.col("node").alias("doc_id")).distinct(), "wanted"))
        sets = written(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "node long, shingles binary").dropDuplicates(["node", "shingles"]), "sets")
        star = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        links = written(_confirmed(star, sets, percent), "links")
        first = written(connected_components(links), "components")

        more = written(_confirmed(unseen_pairs(shared, first, sets, percent), sets, percent), "more-links")
        # texts of one id
        several = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id")
        of_id = known.select("doc_id", "set_key").join(several, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "node")
        same = written(of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "same-id")
        components = first
        if not (more.isEmpty() and same.isEmpty()):
            components = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")).union(same))
        return classes.join(components, "node", "left").select(F.col("set_key").alias("class_key"), F.coalesce("component", "node").alias("class_component"))

    whole = settled(linked, "classes")
    found = profiles.join(whole, profiles["set_key"] == whole["class_key"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_oph_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), size=2)


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents``, all columns, that aren't near-duplicates of a document with a smaller doc_id."""
    gone = near_duplicates(documents, size, percent).where("NOT kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return documents.join(gone, documents["doc_id"] == gone["__gone_id"], "left_anti")


#: Plain: all pairs that share a shingle, and reachability. For small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON r.a = e.a),
m AS (SELECT a, min(m) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.a
"""
