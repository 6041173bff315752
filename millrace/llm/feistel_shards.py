"""Sharding by a Feistel permutation of global row numbers, with cycle walking. DataFrame functions only.

Rows are numbered by (id, size, checksum of the text), the number n of rows sets a grid a x b that just covers n, and a
keyed Feistel network permutes the grid; values beyond n walk on along their cycle. A row at place p of the shuffle lies
in shard p mod shards, at slot p div shards: sizes differ by one row at most, and row number, shard and slot can be
computed from one another without a table.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import in_order, read, written

PRIME = 2_147_483_647
ROUNDS = 6


def _keys(seed: int) -> list[tuple[int, int, int]]:
    """Per round: multiplier, addend, second addend, all below PRIME."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        out.append(tuple(1 + int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (PRIME - 1) for i in range(3)))
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_number(x: int, n: int, seed: int) -> int:
    """Where the permutation of range(n) puts x: the plain form of feistel_place(), for lookups without Spark."""
    a, b = grid(n)
    while True:
        left, right = divmod(x, b)
        for k, (m, c, d) in enumerate(_keys(seed)):
            y = ((left if k % 2 else right) * m + c) % PRIME
            y = (y * y + d) % PRIME
            if k % 2:
                right = (right + y) % b
            else:
                left = (left + y) % a
        x = left * b + right
        if x < n:
            return x


def _network(x: str, a: int, b: int, seed: int) -> str:
    """SQL of one pass through the network, as a fold over the rounds' keys, so that no expression is repeated."""
    keys = ", ".join(f"named_struct('k', {k}, 'm', {m}L, 'c', {c}L, 'd', {d}L)" for k, (m, c, d) in enumerate(_keys(seed)))
    y = f"((((if(r.k % 2 = 1, s.l, s.r) * r.m + r.c) % {PRIME}L) * ((if(r.k % 2 = 1, s.l, s.r) * r.m + r.c) % {PRIME}L) + r.d) % {PRIME}L)"
    step = f"named_struct('l', if(r.k % 2 = 1, s.l, (s.l + {y}) % {a}L), 'r', if(r.k % 2 = 1, (s.r + {y}) % {b}L, s.r))"
    return f"aggregate(array({keys}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, r) -> {step}, s -> s.l * {b}L + s.r)"


def feistel_place(number: str, n: int, seed: int) -> Column:
    """The place of a row number (name of a long column without nulls) in the shuffle of n rows.

    The grid has fewer than sqrt(n) + 1 cells beyond n, so a cycle leaves them after at most that many passes; one row in
    sqrt(n) needs a second pass. The walk is a fold that stops changing once it is inside.
    """
    a, b = grid(n)
    once = _network(number, a, b, seed)
    beyond = a * b - n
    if not beyond:
        return F.expr(once)
    walk = f"aggregate(sequence(1, {beyond}), {{0}}, (x, i) -> if(x < {n}L, x, {_network('x', a, b, seed)}))"
    return F.expr(f"element_at(transform(array({once}), y -> if(y < {n}L, y, {walk.format('y')})), 1)")


def number_rows(rows: DataFrame, order: list[str], n: int, rows_per_range: int = 100_000) -> DataFrame:
    """The ``n`` rows with row_number, counting from 0 in the order of ``order``, as a written table and a broadcast of the ranges' sums.

    Range bounds are drawn anew whenever a plan runs, so the numbers within ranges are written before they're summed up.
    """
    place = F.monotonically_increasing_id()
    ranged = in_order(rows, order, max(16, n // rows_per_range)).withColumn("__id", place)
    # the high bits of the id are the range, the low 33 the row within it
    placed = written(ranged.withColumns({"__range": F.shiftright("__id", 33), "__within": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id"), "numbered")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    bases = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__base"))
    # broadcast: a row per range, of which there are MOST_RANGES at most
    return placed.join(F.broadcast(bases), "__range").withColumn("row_number", F.col("__base") + F.col("__within")).drop("__range", "__within", "__base")


def assign_shards(documents: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number for each row of ``documents`` (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 16; a null or empty text has checksum 0. Rows without doc_id come
    first. Texts are read once: range bounds, counts and numbers come from a written table of their digests. Equal rows get
    neighbouring numbers, and places of their own. An empty table gives no rows; other columns are ignored.
    """
    raw = F.col("text").cast("binary")
    digest = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    digest = written(digest, "digests")
    n = digest.count()
    numbered = number_rows(digest, ["doc_id", "size", "text_crc32"], n)
    placed = numbered.withColumn("place", feistel_place("row_number", max(n, 1), seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}L").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op2_feistel_shards(spark, sf_dir):
    return assign_shards(read(spark, sf_dir, "documents"), shards=40)


def _oracle(shards: int = 40, seed: int = 7) -> str:
    """The same in DuckDB SQL: CRC-32 over the bytes by its table, the network unrolled, the walk as a recursion."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = "SELECT rn, x // b AS l, x % b AS r, walk, n, a, b FROM w WHERE walk = 0 OR x >= n"
    for k, (m, c, d) in enumerate(_keys(seed)):
        y = f"(((({'l' if k % 2 else 'r'} * {m} + {c}) % {PRIME}) * (({'l' if k % 2 else 'r'} * {m} + {c}) % {PRIME}) + {d}) % {PRIME})"
        step = f"SELECT rn, {'l' if k % 2 else f'(l + {y}) % a'} AS l, {f'(r + {y}) % b' if k % 2 else 'r'} AS r, walk, n, a, b FROM ({step})"
    return f"""
WITH RECURSIVE tab AS (SELECT {table}::BIGINT[] AS tab),
d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda acc, y: xor(acc >> 8, tab[(xor(acc, y) & 255) + 1])), 4294967295::BIGINT) END AS text_crc32 FROM documents, tab),
o AS (SELECT *, (row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1)::BIGINT AS rn, (count(*) OVER ())::BIGINT AS n FROM d),
g AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM o),
w AS (SELECT rn, rn AS x, 0 AS walk, n, a, ((n + a - 1) // a)::BIGINT AS b FROM g UNION ALL SELECT rn, l * b + r AS x, walk + 1 AS walk, n, a, b FROM ({step})),
p AS (SELECT rn, x FROM w WHERE walk > 0 AND x < n)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {shards})::INTEGER AS shard, (x // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, rn AS row_number FROM o JOIN p USING (rn)
"""


ORACLE_SQL = _oracle()
