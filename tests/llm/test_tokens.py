import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import drr_packing as dp
from millrace.llm import token_files as tf
from millrace.llm.wordcache import CachedTokenizer

ODD = ["", "a", "a  b", " x", "x ", "a\nb", "a\n\nb", "a\tb", "a\n b", "a \nb", "\na", "a\r\nb", "<|endoftext|> hi", "a<|endoftext|>b c", "<|startoftext|>", "I'm don't 'S x's. a.b, c,", "12,3. 4.", "é. È, ñ.", "x y   z", "ΣΑΣ ΟΔΟΣ. ς", "a . b ,", "a.. b,, c.,",
       "éx", "́a b ́", "Ⅷ. ½, ª.", "a\0b c", "ﬁ. ǅ.", "中文 字. 。", "İ i̇", "a\x1c b", "a \x1cb", "a\x0b b", "a\x85b c", "a   b", "😀 👩‍👩‍👧. x"]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_library_s(spark, file, monkeypatch):
    from millrace.llm import wordcache

    monkeypatch.setattr(wordcache, "MOST_PARTS", 3_000)  # generations change while it runs
    path = public_tokenizers.path(file)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    plain, cached = Tokenizer.from_file(path), CachedTokenizer(path)
    for _ in range(2):
        for t, ids in zip(texts, cached.encode(texts), strict=True):
            assert np.frombuffer(ids, cached.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def expected_ids(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op8_round_trip(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    at, t = 0, Tokenizer.from_file(tf.byte_vocabulary())
    for r in sorted(tf.op8_token_files(spark, sf).collect()):
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8_files_and_edges(spark):
    rows = [(None, "b"), (None, None), (7, "x y"), (7, "x y"), (-5, ""), (2**60, "w " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    folder, manifest = tf.write_token_files(df, tf.byte_vocabulary())
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in tf.read_token_files(folder, manifest).collect()))
    assert [x[1] for x in got] == [None, None, -5, 7, 7, 2**60] and [x[2] for x in got[:5]] == [1, 2, 1, 3, 3]
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    first = manifest.orderBy("shard").first()
    ids, offsets, docs = tf.open_shard(folder, first.shard, first.item_bytes)
    assert ids.dtype == np.dtype("<u2") and offsets.dtype == np.dtype("<i8") and len(offsets) == len(docs) + 1 and isinstance(ids, np.memmap)
    assert tf.read_token_files(*tf.write_token_files(df.limit(0), tf.byte_vocabulary())).count() == 0


def check_packing(pieces, texts, sequence=2048):
    t = Tokenizer.from_file(dp.word_vocabulary())
    by, seqs = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert set(by) == set(texts)
    for i, own in by.items():
        ids, at = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(seqs) == list(range(len(seqs)))
    for k, own in seqs.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == sequence or k == len(seqs) - 1
    return seqs


def test_op9_windows_hold_the_mixture(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    pieces = dp.op9_drr_packing(spark, sf).collect()
    seqs = check_packing(pieces, texts)
    total = {}
    for p in pieces:
        total[p.queue] = total.get(p.queue, 0) + p.length
    for k, own in seqs.items():
        if k < len(seqs) - 2:
            for q, n in total.items():
                assert abs(sum(p.length for p in own if p.queue == q) - 2048 * n / sum(total.values())) <= len(total) + 1


def test_op9_targets_and_exhaustion(spark):
    texts, rows = {}, []
    for k in range(60):
        texts[k] = " ".join(f"{'ab'[k % 2]}{j}" for j in range(100 + 10 * k))
        rows.append((k, texts[k], "big" if k % 3 else "small", 5))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int")
    pieces = dp.pack(df, dp.word_vocabulary(), sequence=128, window=256, shares={"big": 0.25, "small": 0.75}).collect()
    seqs = check_packing(pieces, texts, 128)
    early = [p for k in range(20) for p in seqs[k]]
    share = {q: sum(p.length for p in early if p.queue == q) / (20 * 128) for q in {p.queue for p in early}}
    assert sorted(round(v, 1) for v in share.values()) in ([0.2, 0.8], [0.3, 0.7], [0.2, 0.7], [0.3, 0.8])


def test_op9_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "hello world", "a"), (3, "one " * 9000, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, ids int")
    check_packing(dp.pack(df, dp.word_vocabulary()).collect(), {r[0]: r[1] for r in rows})
    twice = dp.pack(df.union(df), dp.word_vocabulary()).collect()
    assert sum(p.length for p in twice) == 2 * sum(p.length for p in dp.pack(df, dp.word_vocabulary()).collect())
    assert dp.pack(df.limit(0), dp.word_vocabulary()).count() == 0


def test_rounds_with_tiny_queues():
    sizes, quanta = np.array([50_000, 30, 7]), np.array([2047 << 12, 5, 1])
    rounds = dp.Rounds(sizes, quanta, 2048)
    seen = np.zeros(int(sizes.sum()), int)
    for q, size in enumerate(sizes):
        cuts = np.unique(np.concatenate(([0], np.random.default_rng(q).integers(0, size, 12), [size])))
        _, begin, n, at = rounds.pieces(np.full(len(cuts) - 1, q), cuts[:-1], np.diff(cuts))
        for a, m in zip(at, n):
            assert a // 2048 == (a + m - 1) // 2048
            seen[a : a + m] += 1
    assert (seen == 1).all()


def test_op9_every_source_is_a_queue(spark):
    """More sources than one level holds: each source keeps its own proportion, and a stated share counts for any of them."""
    rows = [(k, " ".join(f"w{j}" for j in range(30 + k % 7)), f"s{k // 2}") for k in range(600)] + [(600, " ".join(f"long{j}" for j in range(9000)), "few rows")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    pieces = dp.pack(df, dp.word_vocabulary(), sequence=1024).collect()
    seqs = check_packing(pieces, texts, 1024)
    assert len({p.queue for p in pieces}) == 301 and len({(source[p.doc_id], p.queue) for p in pieces}) == 301
    total = Counter()
    for p in pieces:
        total[source[p.doc_id]] += p.length
    for k in range(len(seqs) - 2):
        here = Counter()
        for p in seqs[k]:
            here[source[p.doc_id]] += p.length
        off = {s: abs(here[s] - 1024 * n / sum(total.values())) for s, n in total.items()}
        assert off.pop("few rows") <= 302 and max(off.values()) <= 5
    early = [p for p in dp.pack(df, dp.word_vocabulary(), sequence=1024, shares={"s299": 0.05}).collect() if p.sequence_id == 0]
    assert abs(sum(p.length for p in early if source[p.doc_id] == "s299") - 51) <= 3
    for wrong in ({"absent": 0.1}, {"s1": 0.0}, {"s1": 0.7, "s2": 0.6}):
        with pytest.raises(ValueError):
            dp.pack(df, dp.word_vocabulary(), shares=wrong)


def test_tree_of_rounds_covers_every_place():
    rng = np.random.default_rng(3)
    sizes = (rng.pareto(1.5, 500) * 50).astype(np.int64) + 1
    tree = dp.Tree(sizes, rng.integers(1, 1 << 22, 500), 256, fan_out=8)
    queue = np.repeat(np.arange(500), 2)
    half = sizes // 2
    doc, begin, n, at = tree.pieces(queue, np.stack((0 * half, half), 1).ravel(), np.stack((half, sizes - half), 1).ravel())
    seen = np.zeros(int(sizes.sum()), int)
    for a, m in zip(at, n):
        assert a // 256 == (a + m - 1) // 256
        seen[a : a + m] += 1
    assert (seen == 1).all()


def test_op9_does_not_depend_on_partitions(spark):
    rows = [(k % 90 if k % 10 else None, f"text {k % 40} " * (1 + k % 13), f"s{k % 3}" if k % 7 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda p: tuple(-1 if x is None else x for x in p)
    found = [sorted(map(key, dp.pack(df.repartition(n), dp.word_vocabulary(), sequence=256).collect())) for n in (2, 5)]
    assert found[0] == found[1] and len(found[0]) >= 200


def test_op9_shares_of_small_sources(spark):
    """A source with few rows holds the share it is given until it is used up; the others share the rest."""
    text = " ".join(f"w{j}" for j in range(60))
    four = spark.createDataFrame([(k, text, "abcd"[k % 4]) for k in range(400)], "doc_id long, text string, source string")
    rare = spark.createDataFrame([(k, text, "rare" if k % 400 == 7 else "big") for k in range(2000)], "doc_id long, text string, source string")
    for df, source, share, windows in ((four, "a", 0.5, 10), (rare, "rare", 0.5, 3)):
        own = {r.doc_id for r in df.where(f"source = '{source}'").collect()}
        shares = {source: share} if source == "a" else {"rare": 0.5, "big": 0.5}
        pieces = dp.pack(df, dp.word_vocabulary(), sequence=256, shares=shares).collect()
        for k in range(windows):
            assert abs(sum(p.length for p in pieces if p.sequence_id == k and p.doc_id in own) - 128) <= df.select("source").distinct().count()


def test_op8_files_outlive_and_ids_spread(spark, tmp_path):
    """Files in a folder of their own, read by a manifest that was kept; an outlier and a repeated id don't crowd a task."""
    from pyspark.sql import functions as F

    ids = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(2**62)).when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("same words " * 200).alias("text"))
    folder, _ = tf.write_token_files(ids, tf.byte_vocabulary(), shard_bytes=1 << 20, destination=f"file://{tmp_path}/out", task_bytes=4 << 20)
    manifest = tf.read_manifest(spark, folder)
    rows = manifest.orderBy("shard").collect()
    per_task = {}
    for r in rows:
        per_task[r.shard // tf.FILES_PER_TASK] = per_task.get(r.shard // tf.FILES_PER_TASK, 0) + r.n_docs
    assert sum(per_task.values()) == 20_000 and max(per_task.values()) <= 2 * 20_000 / len(per_task) and len(per_task) > 5 and len(rows) > len(per_task)
    got = tf.read_token_files(folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and got[-1].doc_id == 2**62
    with pytest.raises(FileExistsError):
        tf.write_token_files(ids.limit(1), tf.byte_vocabulary(), destination=folder)


def test_op8_tokenizes_a_word_once(tmp_path, monkeypatch):
    """A task's writer asks the library for each of 450,000 words once, though they come twice."""
    from itertools import product
    from types import SimpleNamespace

    import pyarrow as pa

    from millrace.llm import wordcache

    words = ["".join(x) for x in product("abcdefghijklmnopqrstuvwxyz", repeat=4)][:450_000]
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
    asked = []

    def counted(*args):
        tok = wordcache.tokenizer(*args)
        if not asked:
            real, _ = tok.model, asked.append(0)

            def tokenize(piece):
                asked[0] += 1
                return real.tokenize(piece)

            tok.model = SimpleNamespace(tokenize=tokenize)
        return tok

    wordcache.release()
    monkeypatch.setattr(tf, "tokenizer", counted)
    monkeypatch.setattr(tf, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    manifest = list(tf._writer(str(tmp_path), tf.byte_vocabulary(), 0, 1 << 30)([batch, batch]))
    wordcache.release()
    assert len(words) <= asked[0] <= len(words) + len(texts)
    assert manifest[0].column(1).to_pylist() == [2 * len(texts)]
    ids, offsets, _ = tf.open_shard(str(tmp_path), 0, 2)
    plain = Tokenizer.from_file(tf.byte_vocabulary())
    for k in (0, 1, 449, 450, 899):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*plain.encode(texts[k % 450], add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_full_cache_keeps_to_its_size(file, monkeypatch):
    """A cache that is full again and again, also within a text, and texts that hold the characters it uses itself."""
    path = public_tokenizers.path(file)
    odd = ["a\x01b c", "\x01", "\x01 x", "x \x01y", "a\n\x01b", "a\n", "Ünï, the&&& 7 the, 7", "\n", "привет, мир. привет! 12 12"]
    texts = odd + [" ".join(f"{'abcdefghij'[j % 10] * (1 + j % 7)}{'.,!'[j % 3] * (j % 4)} the w{j * k}" for j in range(90)) for k in range(60)] + odd
    monkeypatch.setattr("millrace.llm.wordcache.STRETCH", 40)
    plain, cached = Tokenizer.from_file(path), CachedTokenizer(path, 100)
    for t, ids in zip(texts, cached.encode(texts), strict=True):
        assert np.frombuffer(ids, cached.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert 0 < len(cached.parts) <= 100
