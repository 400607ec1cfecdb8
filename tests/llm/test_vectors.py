"""Hard negatives and vector codes against brute force in Python integers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives as hn
from barloom.llm import vector_codes as vc
from barloom.llm.whole_vectors import MOST, in_long

LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"
ANCHORS = "vec_id % 50 = 0"


def vectors(spark, rows):
    """Rows under more columns with names the operators use inside."""
    data = [(*r, "x", 0, 1.0) for r in rows]
    return spark.createDataFrame(data, "vec_id long, label int, embedding array<float>, mark string, cell int, vector double")


def usable(rows):
    for vec_id, label, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            yield vec_id, label, tuple(math.floor(256 * x) for x in np.array(vector, np.float32).tolist())


def brute_negatives(rows):
    own = [(i, (n + 1) % 10 if i % 7 == 0 else n, v) for i, n, v in usable(rows) if i is not None and n is not None]
    want = Counter()
    for anchor, label, q in {r for r in own if r[0] % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, n) for i, n, v in own if i != anchor)
        for score, positive in [(-s, i) for s, i, n in scored if n == label][:5]:
            window = [(-s, i) for s, i, n in scored if n != label and 50 * score <= 100 * -s <= 95 * score]
            want.update((anchor, positive, rank, i, score, s) for rank, (s, i) in enumerate(window[:3], 1))
    return want


def odd_rows(seed=1, n=700):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(n)]
    rows += [(700, 1, None), (750, 1, [None, 1.0, 1.0, 1.0]), (800, 1, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(None, 1, [1.0] * 4), (850, None, [1.0] * 4), rows[5], rows[100], (1000, 1, [0.0] * 4), (1050, 2, [2.0, 1.0])]
    # large numbers, one id with two vectors, and a number far beyond 64 bits whose scores stay small
    rows += [(1100, 1, [1e6, 0.0, 1.0, 2.0]), (1101, 1, [1e6, 1.0, 0.0, 0.0]), (1102, 2, [7e5, 1.0, 0.0, 0.0])]
    return [*rows, (50, 2, [1.0, 1.0, 1.0, 1.0]), (1103, 2, [1.0, 0.0, 0.0, 0.0, 1e30])]


def negatives(spark, rows):
    return Counter(tuple(r) for r in hn.hard_negatives(vectors(spark, rows), F.expr(LABEL), F.expr(ANCHORS)).collect())


def test_hard_negatives_with_ties_nulls_repeats_and_large_numbers(spark):
    rows = odd_rows()
    want = brute_negatives(rows)
    assert want and negatives(spark, rows) == want


def test_hard_negatives_of_copies_and_few_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64) / 8
    rows = [(i, i % 2, [float(x) for x in base + rng.standard_normal(64) * (0.02 if i % 3 else 0.1)]) for i in range(400)]
    assert negatives(spark, rows) == brute_negatives(rows)
    assert negatives(spark, rows[:3]) == brute_negatives(rows[:3])
    assert negatives(spark, rows[:0]) == Counter()


def test_a_score_beyond_64_bits_fails_instead_of_wrapping(spark):
    rows = [(0, 1, [1e20, 0.0]), (1, 1, [1e20, 1.0]), (2, 2, [1.0, 0.0])]
    with pytest.raises(Exception, match="64 bits"):
        negatives(spark, rows)


def test_intervals_hold_every_score_and_spare_most_of_them():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 48)) * 40
    x = np.floor(np.repeat(centres, 256, axis=0) + rng.standard_normal((2048, 48)) * 4)
    q = np.floor(centres[:3] + rng.standard_normal((3, 48)) * 4)
    labels = np.arange(2048) % 2
    cell = hn.coded(np.arange(2048), labels, x, 64)
    low, high = hn.intervals(q, cell)
    true = q @ x.T
    assert (low <= true).all() and (true <= high).all()
    ones = np.ones((3, 1), np.int64)
    hits, scored = hn.search_cell(np.full(3, -1), np.zeros(3, np.int64), q, -MOST * ones, MOST * ones, -MOST * ones, cell, 5, True)
    assert 15 <= scored < 0.2 * 3 * 1024
    for a in range(3):
        order = sorted((-true[a, v], v) for v in range(0, 2048, 2))[:5]
        assert [(v, -s) for s, v in order] == [(v, s) for r, v, s in zip(hits[0], hits[2], hits[3]) if r == a]


def test_scores_are_held_at_the_ends_of_a_long():
    assert in_long(np.array([1 << 70, -(1 << 70), 5], object)).tolist() == [MOST, -MOST - 1, 5]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    own = list(usable(rows))
    longest = max((len(v) for _, _, v in own), default=0)
    width = max(1, math.ceil(longest / parts))
    own = [(i, n, v + (0,) * (parts * width - len(v))) for i, n, v in own]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in own]
    first = sorted(range(len(own)), key=lambda r: (own[r][0] is None, own[r][0] or 0, np.array(own[r][2], np.float64).tobytes()))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for row in cut:
                groups[near(row[p], books[p])[1]].append(row[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(row[p], books[p]) for p in range(parts)] for row in cut]
    by_label = Counter()
    for (_, label, _), f in zip(own, found):
        by_label[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[n], digest) for (i, n, _), f in zip(own, found))


def codes(spark, rows):
    return Counter(tuple(r) for r in vc.product_codes(vectors(spark, rows)).collect())


def test_codes_with_ties_nulls_repeats_and_odd_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-4, 5, 20) / 16]) for i in range(300)]
    rows += [(None, 1, rows[3][2]), (900, None, rows[4][2]), (901, None, rows[5][2][:7]), (902, 1, None), (903, 1, [None] * 20)]
    rows += [rows[1], rows[2], (1, 0, rows[9][2]), (904, 2, [float("inf")] * 20), (905, 2, [])]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_few_no_and_large_rows(spark):
    rows = [(i, 1, [float(i % 5), -float(i), 0.5]) for i in range(20)]
    assert codes(spark, rows) == brute_codes(rows)
    assert codes(spark, rows[:0]) == Counter()
    # averages beyond the whole numbers of a double, errors within a long
    large = [(i, 1, [1e25 if i % 2 else -3e7, float(i)]) for i in range(80)]
    assert codes(spark, large) == brute_codes(large)


def test_pivots_spare_distances():
    rng = np.random.default_rng(6)
    entries = np.floor(rng.standard_normal((64, 4)) * 30)
    parts = np.floor(rng.standard_normal((5000, 4)) * 30)
    fixed = vc.pivots(entries)
    chosen, best, computed = vc.nearest(parts, vc.distances(parts, fixed), entries, vc.distances(fixed, entries))
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (chosen == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert computed < 0.25 * exact.size
