"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of a few megabytes. A shard is an index that is kept: its words as numbers in a vocabulary of
its own, with a 0 after each document, and the order of all their suffixes. Each suffix of each test item is searched for
in every shard by binary search over that order, at the length of a window; each place found is extended to the longest
match with any item, by binary search over the items' own suffixes. Test items are a stated query set; tasks write them as
blocks of bounded size and hold one or two of those at a time, however large the benchmark is.
"""

from __future__ import annotations

import functools
import hashlib
import io
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textcore as tc
from millrace.llm.common import fresh_path, read, ship, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
NO_ID = -(2**63)
SPAN = "struct<item_id:long,item_start:long,start:long,length:long>"
RESULT = f"n_words long, n_hit long, n_items long, items_sha256 string, spans array<{SPAN}>"
RESULT_NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "spans")
_SPAN_TYPE = pa.struct([("item_id", pa.int64()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_NONE = np.zeros(0, np.int64)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The positions of x (numbers from 0 on) in the order of their suffixes, to full depth.

    Several numbers are sorted as one key at first; then only suffixes that are still equal are sorted, by the ranks of
    what follows, at twice the depth each time. Beyond the end, all is 0.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int32)
    bits = max(1, int(x.max()).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        if k < n:
            key[: n - k] |= x[k:]
    order = np.argsort(key, kind="stable")
    group, rank = np.empty(n, np.int64), np.empty(n, np.int64)

    def heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(keys)))

    first, size = heads(key[order])
    group[:] = np.repeat(first, size)
    rank[order] = group
    unsettled = np.flatnonzero(np.repeat(size > 1, size))
    while len(unsettled) and depth < n:
        at = order[unsettled]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = group[unsettled] * (n + 2) + after
        sort = np.argsort(key, kind="stable")
        at = at[sort]
        order[unsettled] = at
        first, size = heads(key[sort])
        group[unsettled] = np.repeat(unsettled[first], size)
        rank[at] = group[unsettled]
        unsettled = unsettled[np.repeat(size > 1, size)]
        depth *= 2
    return order.astype(np.int32)


def _lengths(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words a from each p on and b from each q on have in common, up to a 0 in either."""
    out, live = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        i, j = p[live] + out[live], q[live] + out[live]
        inside = (i < len(a)) & (j < len(b))
        live, i, j = live[inside], i[inside], j[inside]
        live = live[(a[i] == b[j]) & (a[i] > 0)]
        out[live] += 1
    return out


def _places(a: np.ndarray, order: np.ndarray, b: np.ndarray, q: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """Where the stretches of b from each q on, ``most`` words or up to a 0, go in the order of a's suffixes; after equal ones or before."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        at, start, size = order[mid].astype(np.int64), q[open_], most[open_]
        sign, live, d = np.zeros(len(open_), np.int8), np.arange(len(open_)), 0
        while len(live):
            live = live[size[live] > d]
            i, j = at[live] + d, start[live] + d
            left, right = np.where(i < len(a), a[np.minimum(i, len(a) - 1)], 0), np.where(j < len(b), b[np.minimum(j, len(b) - 1)], 0)
            sign[live] = np.where(left < right, -1, np.where(left > right, 1, 0))
            live = live[(left == right) & (left > 0)]
            d += 1
        right_ = (sign < 0) | ((sign == 0) & after)
        low[open_[right_]] = mid[right_] + 1
        high[open_[~right_]] = mid[~right_]
    return low


@dataclass
class Shard:
    """Training text as an index: ``words`` are numbers in the sorted ``vocabulary`` from 1 on, with a 0 after each document."""

    vocabulary: np.ndarray
    words: np.ndarray
    order: np.ndarray
    first: np.ndarray  # of each document's words, and one more

    @staticmethod
    def of(hashes: np.ndarray, first: np.ndarray) -> Shard:
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        words = np.insert(numbers.astype(np.int64) + 1, first[1:], 0)
        return Shard(vocabulary, words.astype(np.int32), suffix_array(words), first + np.arange(len(first)))


@dataclass
class Block:
    """Test items in the same form, with their distinct windows and the items that have each."""

    vocabulary: np.ndarray
    words: np.ndarray
    order: np.ndarray
    starts: np.ndarray  # of the windows, in words
    lengths: np.ndarray  # of the windows
    owners: np.ndarray  # numbers of items, window by window
    owner_first: np.ndarray  # of each window's owners, and one more
    item_first: np.ndarray
    item_ids: list[int | None]


def make_block(ids: list[int | None], texts: list[str | None], window: int = WINDOW) -> Block:
    hashes, counts = [np.zeros(0, np.uint64)], []
    for _, _, data, offsets in tc.text_slices(pa.array(texts, pa.string())):
        data = tc.LOWER[data]
        s, e, first = tc.word_spans(data, offsets, tc.ALNUM)
        hashes.append(tc.span_hashes(data, s, e))
        counts.append(np.diff(first))
    counts = np.concatenate(counts) if counts else _NONE
    shard = Shard.of(np.concatenate(hashes), np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
    size = np.minimum(window, counts)
    n = np.where(size > 0, counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    starts = shard.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    lengths, key = size[owner], np.zeros(len(owner), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        inside = lengths > k
        key[inside] = tc.mix(key[inside] * tc.U64(0x9FB21C651E98DF25) + shard.words[starts[inside] + k].astype(np.uint64) + tc.U64(1))
    # equal windows are one, whose owners are the items that have it, each once
    sort = np.lexsort((owner, key))
    key, owner, starts, lengths = key[sort], owner[sort], starts[sort], lengths[sort]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    once = new.copy()
    once[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    return Block(shard.vocabulary, shard.words, shard.order, starts[first], lengths[first], owner[once], np.append(np.cumsum(once)[first] - 1, once.sum()), shard.first, list(ids))


@dataclass
class Found:
    hits: np.ndarray  # flags of the shard's words
    documents: np.ndarray  # of pairs of documents and items
    items: np.ndarray
    starts: np.ndarray  # of the longest matches, in the shard's words
    sizes: np.ndarray
    item_starts: np.ndarray  # in the block's words


def search_shard(shard: Shard, block: Block) -> Found:
    """All places of the block's windows, and the longest matches: where one begins that isn't part of the one before it."""
    hits = np.zeros(len(shard.words), bool)
    none = Found(hits, _NONE, _NONE, _NONE, _NONE, _NONE)
    if not len(shard.vocabulary) or not len(block.starts):
        return none
    at = np.minimum(np.searchsorted(shard.vocabulary, block.vocabulary), len(shard.vocabulary) - 1)
    number = np.concatenate(([0], np.where(shard.vocabulary[at] == block.vocabulary, at + 1, -1)))
    y = number[block.words]
    unknown = np.concatenate(([0], np.cumsum(y <= 0)))
    known = np.flatnonzero(unknown[block.starts + block.lengths] == unknown[block.starts])
    q, size = block.starts[known], block.lengths[known]
    low, high = (_places(shard.words, shard.order, y, q, size, after) for after in (False, True))
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    place = shard.order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
    if not len(place):
        return none
    covered = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + size[which], -1)
    hits = np.cumsum(covered[:-1]) > 0
    document = np.searchsorted(shard.first, place, side="right") - 1
    pairs = np.unique(document * len(block.starts) + known[which])
    document, window = pairs // len(block.starts), pairs % len(block.starts)
    m = block.owner_first[window + 1] - block.owner_first[window]
    owner = block.owners[np.repeat(block.owner_first[window], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
    # the longest match from each place on is with one of the two item suffixes that it would lie between
    place = np.unique(place)
    of_item = np.concatenate(([np.uint64(0)], block.vocabulary))[block.words]
    text = np.concatenate(([np.uint64(0)], shard.vocabulary))
    near = _places(of_item, block.order, _Words(text, shard.words), place, np.full(len(place), len(shard.words) + 1), False)
    best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for side in (near - 1, near):
        ok = np.flatnonzero((side >= 0) & (side < len(block.order)))
        start = block.order[side[ok]].astype(np.int64)
        length = _lengths(_Words(text, shard.words), place[ok], of_item, start)
        more = length > best[ok]
        best[ok[more]], where[ok[more]] = length[more], start[more]
    left = np.ones(len(place), bool)
    left[1:] = (place[1:] != place[:-1] + 1) | (best[1:] >= best[:-1])
    return Found(hits, document.repeat(m), owner, place[left], best[left], where[left])


class _Words:
    """The hashes of numbered words, looked up as they're needed."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        self.hashes, self.numbers = hashes, numbers

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        return self.hashes[self.numbers[k]]


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a small file whole, so that a task that runs again leaves the same."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
        return stream.read()


def blocks_of(benchmark: DataFrame, window: int, most_bytes: int = BLOCK_BYTES) -> tuple[str, list[str]]:
    """Writes the test items as blocks of about ``most_bytes`` of text; their folder and names. Items don't pass the driver."""
    spark = benchmark.sparkSession
    ship(spark)
    folder = fresh_path(spark, "blocks")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = hashlib.sha256(repr((ids, texts)).encode()).hexdigest()
            _put(folder, name, pickle.dumps(make_block(ids, texts, window)))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= most_bytes:
                    yield close()
                    ids, texts, size = [], [], 0
        if ids:
            yield close()

    whole = text_bytes(items)
    made = items.repartitionByRange(max(1, -(-whole // most_bytes)), "item_id", "text").mapInArrow(run, "name string")
    return folder, sorted({r.name for r in made.collect()})


@functools.lru_cache(maxsize=2)
def _block(folder: str, name: str) -> Block:
    return pickle.loads(_get(folder, name))


def _results(shard: Shard, blocks: tuple[str, list[str]]) -> list[pa.Array]:
    """The columns of RESULT for the shard's documents."""
    n = len(shard.first) - 1
    hits, names, spans = np.zeros(len(shard.words), bool), [set() for _ in range(n)], {}
    for name in blocks[1]:
        block = _block(blocks[0], name)
        found = search_shard(shard, block)
        hits |= found.hits
        for d, i in zip(found.documents.tolist(), found.items.tolist(), strict=True):
            if block.item_ids[i] is not None:
                names[d].add(block.item_ids[i])
        items = np.searchsorted(block.item_first, found.item_starts, side="right") - 1
        for start, size, item, begin in zip(found.starts.tolist(), found.sizes.tolist(), items.tolist(), (found.item_starts - block.item_first[items]).tolist(), strict=True):
            if start not in spans or spans[start][0] < size:
                spans[start] = size, block.item_ids[item], begin
    listed, reached = [[] for _ in range(n)], -1
    for start in sorted(spans):
        size, item, begin = spans[start]
        if start + size > reached:  # else it is part of a match with another block
            d = int(np.searchsorted(shard.first, start, side="right")) - 1
            listed[d].append({"item_id": item, "item_start": begin, "start": int(start - shard.first[d]), "length": size})
            reached = start + size
    total = np.concatenate(([0], np.cumsum(hits)))[shard.first]
    digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in names]
    return [pa.array(np.diff(shard.first) - 1, pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digests), pa.array(listed, pa.list_(_SPAN_TYPE))]


def _shards(texts: pa.Array) -> Iterator[tuple[int, int, Shard]]:
    for a, b, data, offsets in tc.text_slices(texts, SHARD_BYTES):
        low = tc.LOWER[data]
        starts, ends, first = tc.word_spans(low, offsets, tc.ALNUM)
        yield a, b, Shard.of(tc.span_hashes(low, starts, ends), first)


_FIELDS = ("vocabulary", "words", "order", "first", "rows")


def index_documents(documents: DataFrame, folder: str) -> DataFrame:
    """Writes a suffix array of every shard of ``documents`` (doc_id, text) below ``folder``, and returns (shard, n_docs, n_words).

    The arrays stay there: later benchmarks are searched for without sorting again. A shard is what a task has at hand, up
    to SHARD_BYTES of text or one longer document; it is named by its content. Null texts have no words.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shard in _shards(batch.column(1)):
                rows = batch.column(0).slice(a, b - a).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                out = io.BytesIO()
                np.savez(out, rows=rows, **{k: getattr(shard, k) for k in _FIELDS[:4]})
                data = out.getvalue()
                name = f"{hashlib.sha256(data).hexdigest()[:32]}-{uuid.uuid4().hex[:8]}"
                _put(folder, name, data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b - a], pa.int64()), pa.array([len(shard.words) - (b - a)], pa.int64())], names=["shard", "n_docs", "n_words"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    own.mapInArrow(run, "shard string, n_docs long, n_words long").write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.schema("shard string, n_docs long, n_words long").parquet(f"{folder}/manifest")


def search_index(manifest: DataFrame, folder: str, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, RESULT and shard for each indexed document; a task loads one shard at a time."""
    blocks = blocks_of(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = np.load(io.BytesIO(_get(folder, name)))
                rows = held["rows"]
                found = _results(Shard(*(held[k] for k in _FIELDS[:4])), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64(), mask=rows == NO_ID), *found, pa.array([name] * len(rows))], names=["doc_id", *RESULT_NAMES, "shard"])

    shards = manifest.select("shard")
    return shards.repartition(max(1, min(manifest.count(), 10_000)), "shard").mapInArrow(run, f"doc_id long, {RESULT}, shard string")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, index: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, spans, shard and contaminated for each row of ``documents`` (doc_id, text).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is ``window`` consecutive
    words of an item of ``benchmark`` (item_id, text), or the whole of an item that has fewer. spans has the longest
    verbatim matches (item_id, item_start, start, length; counted in words): from each place where one begins that isn't
    part of the one before, with one of the items it is longest with. Null texts have no words; items without words have
    no windows; items without id make hits but aren't named; repeated items and rows count as they are. Other columns are
    ignored; an empty table gives no rows. The suffix arrays lie in ``index``, a new folder that stays, or in the session's
    shared folder. Nothing is shuffled but the shards' names.
    """
    folder = index or fresh_path(documents.sparkSession, "suffix-arrays")
    return search_index(index_documents(documents, folder), folder, benchmark, window).withColumn("contaminated", F.col("n_hit") > 0)


def op7_suffix_decontam(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents``, all columns, in which no window of a test item occurs. Neither joined nor shuffled.

    The suffix arrays are built in passing, shard by shard, and not kept.
    """
    ship(documents.sparkSession)
    blocks = blocks_of(benchmark, window)
    own = documents.columns
    at = own.index("text")
    rows = documents.toDF(*(f"c{k}" for k in range(len(own))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shard in _shards(batch.column(at)):
                hits = np.zeros(len(shard.words), bool)
                for name in blocks[1]:
                    hits |= search_shard(shard, _block(blocks[0], name)).hits
                total = np.concatenate(([0], np.cumsum(hits)))[shard.first]
                yield batch.slice(a, b - a).filter(pa.array(total[1:] == total[:-1]))

    return rows.mapInArrow(run, rows.schema).toDF(*own)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i : i + l - 1], ' ') AS win FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM (SELECT *, least(10, len(w)) AS l FROM b WHERE len(w) > 0))),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
