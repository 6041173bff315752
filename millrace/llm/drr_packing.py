"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A round serves each queue in turn; a queue's deficit grows by its
quantum (its target share of a window) and it is served as many whole tokens as its deficit holds, in order, cutting
documents where the deficit ends. The fraction left is carried into the next round. After r rounds a queue has been served
floor(r * quantum) tokens, or all it has, so deficits need no running state: any task can compute where its tokens go
from the queues' sizes and its documents' places in them, which are prefix sums over ranges of ids. The rounds' output is cut
into full sequences; only the last one is padded. Beyond FAN_OUT sources, a group of small ones is a queue whose tokens
come in the order of the group's own rounds, so the work per piece doesn't grow with the number of sources.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import in_order, read, ship, text_bytes, written
from millrace.llm.wordcache import tokenizer

SEQUENCE = 2048
#: Quanta are multiples of 1 / 2**SCALE tokens; a queue may hold 2**(62 - SCALE) tokens.
SCALE = 20
#: Queues of one level; with more sources, the smaller ones are served in groups, each by a round-robin of its own.
FAN_OUT = 256
ENCODED = "part long, doc_id long, source string, local_start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], tok.dtype).tobytes()
        served: dict[str | None, int] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                ids = [x + end for x in tok.encode([t or "" for t in rows.column(2).to_pylist()])]
                sizes = [len(x) // tok.dtype.itemsize for x in ids]
                starts = []
                for q, n in zip(rows.column(1).to_pylist(), sizes, strict=True):
                    starts.append(served.get(q, 0))
                    served[q] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int64()), rows.column(0), rows.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "source", "local_start", "doc_tokens", "ids"],
                )

    return run


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of first[i], first[i] + 1, ... (count[i] of them)."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


class Rounds:
    """The schedule: ``sizes`` tokens in the queues, ``quanta`` in units of 2**-SCALE tokens."""

    def __init__(self, sizes: np.ndarray, quanta: np.ndarray, sequence: int) -> None:
        self.sizes, self.quanta, self.sequence = sizes.astype(np.int64), quanta.astype(np.int64), sequence

        self.ends = -((-self.sizes << SCALE) // self.quanta)  # rounds after which a queue is used up

    def served(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        return np.minimum((np.minimum(rounds, self.ends[queue]) * self.quanta[queue]) >> SCALE, self.sizes[queue])

    def position(self, queue: np.ndarray, rounds: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Where token number ``token`` of a queue, which is served in that round, comes in the output."""
        out = token - self.served(queue, rounds)
        seen, at = np.unique(rounds, return_inverse=True)
        every = np.arange(len(self.sizes))[:, None]
        for first in range(0, len(seen), 2048):
            r = seen[None, first : first + 2048]
            before = self.served(every, r)
            ahead = self.served(every, r + 1) - before
            ahead = np.cumsum(ahead, axis=0) - ahead + before.sum(axis=0)
            k = np.flatnonzero((at >= first) & (at < first + 2048))
            out[k] += ahead[queue[k], at[k] - first]
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents at ``start`` of their queues, cut by rounds and sequences: (document, start in it, length, position)."""
        num = self.quanta[queue]
        served_in = lambda token, n: -((-(token + 1) << SCALE) // n) - 1
        r0, r1 = served_in(start, num), served_in(start + length - 1, num)
        by_token = num < 1 << SCALE  # rounds that serve a token or none: one step per token
        d1, t1 = _ranges(start, np.where(by_token, length, 0))
        d2, r2 = _ranges(r0, np.where(by_token, 0, r1 - r0 + 1))
        a = np.maximum(start[d2], self.served(queue[d2], r2))
        b = np.minimum((start + length)[d2], self.served(queue[d2], r2 + 1))
        doc, rounds = np.concatenate((d1, d2)), np.concatenate((served_in(t1, num[d1]), r2))
        first, n = np.concatenate((t1, a)), np.concatenate((np.ones(len(t1), np.int64), b - a))
        some = n > 0
        doc, rounds, first, n = doc[some], rounds[some], first[some], n[some]
        order = np.lexsort((first, doc))
        doc, rounds, first, n = doc[order], rounds[order], first[order], n[order]
        at = self.position(queue[doc], rounds, first)
        i, seq = _ranges(at // self.sequence, (at + n - 1) // self.sequence - at // self.sequence + 1)
        low, high = np.maximum(at[i], seq * self.sequence), np.minimum((at + n)[i], (seq + 1) * self.sequence)
        doc, first, at, n = doc[i], first[i] + low - at[i], low, high - low
        doc, first, n, at = _joined(doc, first, n, at, self.sequence)
        return doc, first - start[doc], n, at


def _joined(doc: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joins what follows on within one sequence; pieces come in order of document and place in it."""
    if len(doc):
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != (at + n)[:-1]) | (at[1:] % sequence == 0)
        k = np.flatnonzero(new)
        doc, first, at, n = doc[k], first[k], at[k], np.add.reduceat(n, k)
    return doc, first, n, at


class Tree:
    """Rounds over any number of queues: those with the largest quanta by themselves, the others in groups."""

    def __init__(self, sizes: np.ndarray, quanta: np.ndarray, sequence: int, fan_out: int = FAN_OUT) -> None:
        self.sequence, self.groups = sequence, []
        self.own = len(sizes) if len(sizes) <= fan_out else fan_out // 2
        order = np.argsort(-quanta, kind="stable") if len(sizes) > fan_out else np.arange(len(sizes))
        self.slot, self.inner = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        self.slot[order[: self.own]] = np.arange(self.own)
        top = [sizes[order[: self.own]]], [quanta[order[: self.own]]]
        for g, members in enumerate(np.array_split(order[self.own :], fan_out - self.own) if self.own < len(sizes) else []):
            if len(members):
                self.slot[members], self.inner[members] = self.own + g, np.arange(len(members))
                # no sequences within a group: they're cut on the way up
                self.groups.append(Tree(sizes[members], quanta[members], 1 << 62, fan_out))
                top[0].append(sizes[members].sum(keepdims=True))
                top[1].append(quanta[members].sum(keepdims=True))
        self.top = Rounds(np.concatenate(top[0]), np.concatenate(top[1]), sequence)

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        slot = self.slot[queue]
        if not self.groups:
            return self.top.pieces(slot, start, length)
        k = np.flatnonzero(slot < self.own)
        parts = [(k, np.zeros(len(k), np.int64), length[k], start[k])]
        for s in np.unique(slot[slot >= self.own]).tolist():
            k = np.flatnonzero(slot == s)
            doc, begin, n, at = self.groups[s - self.own].pieces(self.inner[queue[k]], start[k], length[k])
            parts.append((k[doc], begin, n, at))
        doc, begin, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        i, more, n, at = self.top.pieces(slot[doc], at, n)
        doc, begin = doc[i], begin[i] + more
        order = np.lexsort((begin, doc))
        return _joined(doc[order], begin[order], n[order], at[order], self.sequence)


def _packer(rounds: Tree, item_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                rows = batch.slice(first, 200)
                queue, start, length = (rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
                doc, begin, n, at = rounds.pieces(queue, start, length)
                ids = [np.frombuffer(x.as_buffer(), f"<u{item_bytes}").astype("<u4") for x in rows.column(4)]
                crc = [zlib.crc32(ids[d][a:b]) for d, a, b in zip(doc.tolist(), begin.tolist(), (begin + n).tolist(), strict=True)]
                pick = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pick), pa.array(begin), pa.array(n), pa.array(crc, pa.int64()), rows.column(3).take(pick), pa.array(at // rounds.sequence), pa.array(at % rounds.sequence), rows.column(1).take(pick)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    return run


def targets(sizes: np.ndarray, stated: Mapping[int, float]) -> np.ndarray:
    """Each queue's part of a window: as ``stated``; the others share the rest by their tokens."""
    if any(not (math.isfinite(x) and x > 0) for x in stated.values()):
        raise ValueError("shares must be above 0")
    taken, rest = math.fsum(stated.values()), np.ones(len(sizes), bool)
    rest[list(stated)] = False
    if taken > 1 + 1e-9 or (len(sizes) and not rest.any() and taken < 1 - 1e-9):
        raise ValueError(f"shares sum to {taken}; they may sum to 1 at most, and must where all sources have one")
    out = np.where(rest, sizes, 0) * (max(0.0, 1 - taken) / max(1, int(sizes[rest].sum())))
    for k, x in stated.items():
        out[k] = x
    return out


def pack(documents: DataFrame, vocabulary: str, end_id: int = 1, sequence: int = SEQUENCE, window: int | None = None, shares: Mapping[str, float] | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """The pieces of all rows of ``documents`` (doc_id, text, source), with their ids' checksum, sequence and offset.

    A round fills a window of ``window`` tokens (default: one sequence). Every source is a queue, numbered from the one
    with the most tokens on; rows without source share one. A queue's documents come in ascending doc_id (those without id
    first, equal ids by their texts' checksums), however the input is cut into partitions. ``shares`` gives the queues' parts of a window by source, the
    others share what is left by their tokens; by default each queue's share of all tokens, so all last to the end. A share
    that can't be held (of a source without rows, not above 0, more than 1 together) is a ValueError; where the stated ones
    leave nothing, the others get the smallest quantum. A queue that is used up is skipped. A null or empty text is its end
    id alone. Every id lies in one piece; only the last sequence is not full. Equal rows are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("text"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc"))
    whole = text_bytes(texts)
    texts = in_order(texts, ["doc_id", "crc", "source"], -(-whole // max(4 << 20, min(task_bytes, whole // (4 * spark.sparkContext.defaultParallelism)))))
    encoded = written(texts.mapInArrow(_encoder(vocabulary, end_id), ENCODED), "encoded")
    parts = written(encoded.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "queue-parts")
    numbered = F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_last("source"))) - 1
    queues = written(parts.groupBy("source").agg(F.sum("n").alias("n")).select("source", "n", numbered.alias("queue")), "queues")
    # 8 bytes a source, and no names but those with a share
    sizes = queues.orderBy("queue").select("n").toArrow().column(0).to_numpy().astype(np.int64)
    stated = {r.source: r.queue for r in queues.where(F.col("source").isin(list(shares))).collect()} if shares else {}
    if len(sizes) and (absent := sorted(set(shares or {}) - set(stated))):
        raise ValueError(f"shares of sources without rows: {absent}")
    target = targets(sizes, {q: shares[s] for s, q in stated.items()} if stated else {})
    quanta = np.maximum(1, np.round(target * (window or sequence) * (1 << SCALE))).astype(np.int64)
    base = (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base")
    bases = parts.select("part", "source", base).alias("b").join(queues.select("source", "queue").alias("q"), F.col("b.source").eqNullSafe(F.col("q.source"))).select(F.col("part").alias("p"), F.col("b.source").alias("s"), "base", "queue")
    small = parts.count() <= 200_000
    placed = encoded.join(F.broadcast(bases) if small else bases, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    item_bytes = tokenizer(vocabulary).dtype.itemsize
    return placed.select("doc_id", "queue", (F.col("base") + F.col("local_start")).alias("at"), "doc_tokens", "ids").mapInArrow(_packer(Tree(sizes, quanta, sequence), item_bytes), PIECES)


def op9_drr_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), word_vocabulary())
