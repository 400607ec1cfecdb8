"""Exact search and near-duplicate groups against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import near_dup, topk
from barloom.llm.components import components
from tests.llm.cases import documents, empty_documents, plain


def brute_top(rows, k=5):
    usable = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, [math.floor(256 * x) for x in vector]))
    want = Counter()
    for query_id, q in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in usable if i != query_id)[:k]
        want.update((query_id, rank, i, -s) for rank, (s, i) in enumerate(scored, 1))
    return want


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, score string, cell int")


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 8]) for i in range(700)]
    rows += [(700, None), (750, [None, 1.0, 1.0, 1.0]), (800, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows += [rows[5], rows[100], (1000, [0.0] * 4), (1050, [2.0, 1.0])]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, block=32)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows)


def test_top_k_of_large_vectors(spark):
    """No finite vector is left out, sums do not wrap, and only a result beyond 64 bits fails."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 2) / 8]) for i in range(120)]
    rows += [(200, [float(2**20), 1.0]), (201, [1e7, 0.0]), (202, [3e12, 1.0]), (203, [-1e30, 0.0]), (204, [0.0, 2.0**40])]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=130, block=32)
    with pytest.raises(Exception, match="64 bits"):
        got.collect()
    single = [(i, np.array(v, np.float32).tolist()) for i, v in rows if i not in (202, 203)]
    got = topk.exact_top_k(vectors(spark, single), F.col("vec_id") % 50 == 0, block=32)
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(single)
    wide = [(i, [float(2**20 - 1)] * 600) for i in range(5)] + [(i, [0.0] * 600) for i in range(50, 54)]
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_top_k(vectors(spark, wide), F.col("vec_id") == 0).collect()
    assert topk.exact_top_k(vectors(spark, wide), F.col("vec_id") == 50).count() == 5


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0])]
    got = topk.exact_top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 768 - 512 * 256)]
    assert topk.exact_top_k(vectors(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_far_below_are_not_scored():
    rng = np.random.default_rng(2)
    near = rng.integers(200, 250, (64, 8))
    far = [rng.integers(-250, 0, (64, 8)) for _ in range(20)]
    blocks = [(np.arange(64 * k, 64 * k + 64), v) for k, v in enumerate([*far, near])]
    ids, scores, scored = topk.search_blocks(np.array([-1]), near[:1], blocks, 5)
    assert scored == 64
    want = np.sort(near[:1] @ near.T)[0, ::-1][:5]
    assert scores[0].tolist() == want.tolist() and (ids[0] >= 64 * 20).all()


# ---- near-duplicates


def brute_groups(rows, size):
    def shingles(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        width = min(size, len(words))
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()

    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    want = Counter()
    for d, s in sets:
        root = None if d is None else find(d)
        want[d, len(s), root, d is None or d == root] += 1
    return want


def edited(text, rng, share):
    words = text.split(" ")
    for i in rng.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[i] = f"edit{i}"
    return " ".join(words)


@pytest.mark.parametrize("block_docs,block_shingles", [(1024, 1 << 19), (48, 1 << 19), (1024, 6000)])
def test_a_group_of_edited_copies_just_under_the_limit(spark, monkeypatch, block_docs, block_shingles):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", block_shingles)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]

    def copy(share):
        words = list(base)
        for i in rng.choice(120, int(120 * share), replace=False):
            words[i] = f"e{rng.integers(0, 10**6)}"
        return " ".join(words)

    # similarities of pairs around 0.7, some beyond 0.8, and chains of links
    rows = [(i, copy(rng.choice([0.03, 0.05, 0.06, 0.08]))) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs, 2).collect())
    want = brute_groups(rows, 2)
    assert got == want
    assert 20 < len({c for _, _, c, _ in want}) < 250


def test_links_that_leave_a_task_are_fewer_than_its_documents():
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    texts = [" ".join(f"w{i}" for i in range(40)) + f" x{k % 3}" for k in range(30)] + ["quite another text"]
    table = pa.table({
        "node": list(range(31)), "component": list(range(31)), "block": [1] * 15 + [2] * 16,
        "body": [pack(t.encode()) for t in texts], "left": [1] * 31, "right": [2] * 31,
    })
    links = near_dup._joining(table, 2, 80)
    assert len(links) == 29 and all(a < 15 <= b < 30 for a, b in links)
    sets = [near_dup.shingle_set(t, 2) for t in texts]
    common = near_dup._common(sets, (0, 20), (20, 31))
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[20 + j])) for i in range(20) for j in range(11))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = np.random.default_rng(size)
    base = " ".join(f"w{x}" for x in rng.integers(0, 500, 300))
    passage = " ".join(f"p{i}" for i in range(90))
    extra = [(2000 + i, edited(base, rng, share)) for i, share in enumerate([0.01] * 25 + [0.03] * 15 + [0.06] * 15)]
    extra += [(3000 + i, passage + " " + " ".join(f"o{x}" for x in rng.integers(0, 10**6, 60))) for i in range(40)]
    extra += [(4000, "One"), (4001, "one "), (4002, "one two"), (2001, "another text of the same id")]
    docs = documents(spark, extra)
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs, size).collect())
    assert got == brute_groups(plain(docs), size)


def test_no_documents(spark):
    assert near_dup.near_duplicates(empty_documents(spark)).count() == 0
    assert near_dup.keep_one_of_each(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(empty_documents(spark), percent=70)


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {r.doc_id for r in near_dup.near_duplicates(docs, 5).where("kept").collect()}
    assert set(ids) == want and len([i for i in ids if i is not None]) == len(want - {None})


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(4)]
    rows = [(10, base[0]), (11, edited(base[0], rng, 0.01)), (11, base[1]), (11, base[1]), (11, base[2])]
    rows += [(5, edited(base[2], rng, 0.01)), (12, base[3]), (12, edited(base[3], rng, 0.01)), (12, None), (12, ""), (None, base[0])]
    want, groups = Counter(), brute_groups(list(enumerate(t or "" for _, t in rows)), 5)
    root = {i: r for i, _, r, _ in groups}
    first = {}
    for i, (d, t) in enumerate(rows):
        if d is not None:
            first.setdefault(root[i], []).append((d, t))
    texts = {(d, t) for d, t in rows if d is not None}
    for members in first.values():
        least = min(d for d, _ in members)
        want[least, len({t for d, t in members if d == least})] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dup.keep_one_of_each(docs).collect()]
    assert len(set(got)) == len(got) and set(got) <= texts | {(None, base[0])}
    assert Counter(d for d, _ in got) == Counter([10, 11, 5, 12, 12, 12, None])
    assert (10, base[0]) in got and (11, base[1]) in got and {(12, None), (12, "")} <= set(got)
    assert sum(want.values()) == len([d for d, _ in got if d is not None])


def test_signatures_within_the_radius_always_share_a_key():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 65536, near_dup.N_LANES).astype(np.uint16)
    radius = 2 * near_dup.CHUNKS - 1
    for _ in range(50):
        other = sig.copy()
        other[rng.choice(near_dup.N_LANES, radius, replace=False)] ^= 1
        x, y = near_dup.bucket_keys(np.array([sig, other]))
        assert set(x) & set(y)


def test_sketches_hardly_lose_a_pair_at_the_limit():
    # a 4-bit lane of a pair of similarity 0.8 differs with a probability of 0.2 * 15 / 16
    n, p = near_dup.N_LANES, 0.2 * 15 / 16
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dup.FAR + 1, n + 1)) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
