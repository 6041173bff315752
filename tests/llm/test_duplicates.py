import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import components as cc
from millrace.llm import oph_minhash as oph
from millrace.llm import suffix_decontam as sd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(texts, size, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    having, parent = {}, {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(o for x in s for o in having[x] if o < i)
        for o, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((find(i), find(o)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("size", [2, 5])
def test_op6_equals_plain_search(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    expected = plain_components(texts, size)
    for r in oph.near_duplicates(docs, size).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_op6_chains_and_hubs(spark):
    """Drifting copies: neighbours are similar, the ends aren't, and many buckets have a hub that isn't linked with all."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts, i = {}, 0
    for _ in range(12):
        base = rng.sample(words, 120)
        for _ in range(14):
            texts[i] = " ".join(base)
            i += 1
            for _ in range(rng.randrange(1, 6)):
                base[rng.randrange(len(base))] = rng.choice(words)
    ids = list(texts)
    rng.shuffle(ids)
    texts = dict(zip(ids, texts.values()))
    expected = plain_components(texts, 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in oph.near_duplicates(df, 2).collect()} == expected


def test_op6_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "é x"), (7, "É x"), (None, "one"), (8, "a b c"), (8, "a b c"), (9, "A B C"), (10, "z " * 50_000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in oph.near_duplicates(df, 2).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6][1] == 6 and got[7][1] == 7 and got[None] == (1, None, True) and got[8] == (2, 8, True) and got[9] == (2, 8, False) and got[10] == (1, 10, True)
    kept = oph.drop_near_duplicates(df, 2)
    assert kept.columns == df.columns and kept.count() == 10
    assert oph.near_duplicates(df.limit(0), 2).count() == 0 and oph.near_duplicates(df.where("doc_id = 1"), 2).count() == 1


def test_op6_rows_of_one_id(spark):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "e f g h"), (9, "e f g h"), (11, "x y z"), (12, None), (12, "x y z")]
    got = sorted({(r.doc_id, r.component_id, r.kept) for r in oph.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()})
    assert got == [(3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (12, 11, False), (12, 12, True)]


def test_op6_crowds_make_few_pairs(spark):
    """Texts that share a passage in every bucket without being links, and a few links among them: pairs grow with the members."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(30)]
    texts = {}
    for i in range(3000):
        own = [f"w{rng.randrange(10**6)}" for _ in range(14)]
        texts[i] = " ".join(common + own)
        if i % 500 == 0:
            texts[i + 10_000] = " ".join(common + own[:-1] + ["changed"])
    sets = {i: np.array([hash(x) for x in zip(t.split(), t.split()[1:])], np.int64) for i, t in texts.items()}
    crowd = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, component long, shingles binary")
    pairs = {(r.a, r.b) for r in oph.crowded_pairs(crowd, 80).collect()}
    assert {(i, i + 10_000) for i in range(0, 3000, 500)} <= pairs and len(pairs) <= len(texts)
    some = {i: texts[i] for i in [*range(400), 10_000]}
    for small in (4, 10**6):
        oph_small, oph.unseen_pairs.__defaults__ = oph.unseen_pairs.__defaults__, (small,)
        try:
            got = oph.near_duplicates(spark.createDataFrame(list(some.items()), "doc_id long, text string"), 2).collect()
        finally:
            oph.unseen_pairs.__defaults__ = oph_small
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(some, 2)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for n, share in ((4, 0.5), (60, 0.8), (5000, 0.8)):
        same = []
        for _ in range(200 if n < 1000 else 20):
            common = max(1, int(round(share * n)))
            pool = rng.integers(1, 2**64 - 1, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n:])))
            same.append((oph.signature(a, 128) == oph.signature(b, 128)).mean())
        assert abs(np.mean(same) - common / (2 * n - common)) < 0.08


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, sd.op7_suffix_decontam(spark, sf).collect())) == sorted(c.sql(sd.ORACLE_SQL).fetchall())


def plain_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        q = words(t)
        size = min(window, len(q))
        for k in range(len(q) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == q[k : k + size]:
                    hit |= set(range(p, p + size))
                    names.add(name)
    return len(w), len(hit), names - {None}


def longest_matches(w, items, window):
    """(start, length) of the longest match with any item from each place of a window on, but those within the one before."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in items]
    out, reached = [], -1
    for p in range(len(w)):
        best = 0
        for q in filter(None, words):
            for k in range(len(q)):
                n = 0
                while k + n < len(q) and p + n < len(w) and q[k + n] == w[p + n]:
                    n += 1
                if n >= min(window, len(q)):
                    best = max(best, n)
        if best and p + best > reached:
            out.append((p, best))
            reached = p + best
    return out


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (300, 2), (500, 40), (400, 10**6)):
        x = rng.integers(0, top, n)
        ordered = [x[k:].tolist() + [0] * int(k) for k in sd.suffix_array(x)]
        assert ordered == sorted(ordered)


def test_op7_a_window_of_many_items():
    """2,000 items with one common window: the work is that of one, and so are the spans."""
    common = " ".join(f"w{k}" for k in range(10))
    block = sd.make_block(list(range(2000)), [f"a{k} {common} b{k}" for k in range(2000)])
    assert (block.owner_first[1:] - block.owner_first[:-1]).max() == 2000
    texts = pa.array([f"x {common} y " * 2000])
    _, _, shard = next(sd._shards(texts))
    found = sd.search_shard(shard, block)
    assert len(found.starts) == 2000 and len(found.items) == 2000 and found.hits.sum() == 20_000 and (found.sizes == 10).all()


def test_op7_kept_arrays(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four"), (None, "two three"), (3, None)], "doc_id long, text string")
    bench = lambda t: spark.createDataFrame([(1, t)], "item_id long, text string")
    folder = f"file://{tmp_path}/arrays"
    manifest = sd.index_documents(docs, folder)
    for text, hits in (("two three", {1: 2, None: 2, 3: 0}), ("Four", {1: 1, None: 0, 3: 0})):
        assert {r.doc_id: r.n_hit for r in sd.search_index(manifest, folder, bench(text)).collect()} == hits


def test_op7_random_texts(spark):
    rng = random.Random(6)
    make = lambda n, v="abc": " ".join(rng.choice(v) for _ in range(n))
    items = [(k, make(rng.randrange(0, 25))) for k in range(8)] + [(100, None), (None, "null item words here"), (7, "Seven, again!"), (101, "?!")]
    texts = [make(rng.randrange(0, 120), "abcd") for _ in range(60)] + ["x NULL item. Words-here y", None, "", "seven AGAIN", "the " * 3000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hits int")
    for window in (10, 4):
        got = {r.doc_id: r for r in sd.contamination(docs, bench, window).collect()}
        for k, t in enumerate(texts):
            n, hit, names = plain_hits(t, items, window)
            assert (got[k].n_words, got[k].n_hit, got[k].n_items) == (n, hit, len(names)), (k, t)
            own_words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
            assert [(s.start, s.length) for s in got[k].spans] == longest_matches(own_words, items, window), (k, t)
            for s in got[k].spans:
                own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))[s.start : s.start + s.length]
                assert any(i == s.item_id and re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))[s.item_start : s.item_start + s.length] == own for i, x in items)
    clean = sd.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, t in enumerate(texts) if not plain_hits(t, items)[1]}
    assert sd.contamination(docs.limit(0), bench).count() == 0 and sd.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_op7_blocks_of_items(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(tuple(r)[:5] for r in sd.contamination(docs, bench).collect())
    real = sd.blocks_of
    monkeypatch.setattr(sd, "blocks_of", lambda b, w: real(b, w, most_bytes=2_500))
    assert sorted(tuple(r)[:5] for r in sd.contamination(docs, bench).collect()) == whole
