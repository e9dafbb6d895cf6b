from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import packing, topk


def itemwise(lengths, capacity):
    """Best fit decreasing, one item after another."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= x]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(x)
        else:
            bins.append([x])
    return sorted(sum(b) for b in bins)


@pytest.mark.parametrize("seed", range(60))
def test_best_fit_in_bulk(seed):
    rnd = random.Random(seed)
    capacity = rnd.randrange(3, 40)
    lengths = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(0, 60))]
    avail = np.bincount(lengths, minlength=capacity + 1).astype(np.int64) if lengths else np.zeros(capacity + 1, np.int64)
    assert sorted(sum(p) for p, m in packing.best_fit(avail, capacity) for _ in range(m)) == itemwise(lengths, capacity)


@pytest.mark.parametrize("seed", range(60))
def test_plan_uses_every_piece_once_and_leaves_no_exact_fill(seed):
    rnd = random.Random(seed)
    capacity = rnd.randrange(3, 30)
    counts = Counter(rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(0, 40)))
    avail = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        avail[x] = n
    exact = packing.exact_fills(avail, capacity)
    assert all(sum(p) == capacity for p, _ in exact)
    left = [x for x in range(capacity + 1) for _ in range(avail[x])]
    sums = {0}
    for size in range(1, 5):  # no fill of one to four pieces is left
        sums = {tuple(sorted((*s, i))) for s in (sums if size > 1 else {()}) for i in range(len(left)) if i not in s}
        assert not any(sum(left[i] for i in s) == capacity for s in sums)
        if len(left) > 14:
            break
    used = Counter()
    for p, m in packing.plan(dict(counts), capacity):
        assert sum(p) <= capacity
        for x in p:
            used[x] += m
    assert used == counts


def test_plan_of_a_long_context_is_quick():
    rng = np.random.default_rng(3)
    capacity = 32768
    natural = Counter(np.minimum(capacity, rng.pareto(1.2, 200000) * 300 + 1).astype(int).tolist())
    for counts, size in ((natural, capacity), (dict.fromkeys(range(2, capacity - 1, 2), 3), capacity - 1), (dict.fromkeys(range(1, capacity), 1), capacity)):
        began = time.process_time()
        patterns = packing.plan(dict(counts), size)
        assert time.process_time() - began < 60
        used = Counter()
        for p, m in patterns:
            assert sum(p) <= size
            for x in p:
                used[x] += m
        assert used == Counter(counts)


def test_index_of_sums():
    rng = np.random.default_rng(5)
    for _ in range(20):
        capacity = int(rng.integers(5, 40))
        avail = rng.integers(0, 2, capacity + 1) * rng.integers(0, 3, capacity + 1)
        avail[0] = 0
        index, have = packing.SumIndex(avail), set(np.flatnonzero(avail).tolist())
        for total in range(1, capacity + 1):
            assert set(index.pairs(total)) == {(a, total - a) for a in have if total - a in have and 2 * a >= total}
            assert set(index.triples(total)) == {(a, b, total - a - b) for a in have for b in have if total - a - b in have and a >= b >= total - a - b}


def test_packing_with_salts(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 20).otherwise(F.col("id") % 31 + 1).alias("size"))
    rows = packing.pack(df, 32, length_col="size", salt_rows=50).collect()
    assert len(rows) == 3000
    assert len({(r.bin_id, r.slot) for r in rows}) == 3000
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.slot, r.offset, r.n_words))
    for b in bins.values():
        at = 0
        for slot, offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 32
    whole = packing.pack(df, 32, length_col="size")
    assert whole.select("bin_id").distinct().count() == len(bins)


def test_packing_of_documents(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(["w"] * rnd.randrange(0, 90))) for i in range(200)]
    docs += [(200, None), (201, " \n "), (None, "a b c"), (202, "x\ty\n z"), (203, "q " * 1000), (5, docs[5][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id bigint, text string, n int, salt string")
    rows = packing.pack(df, 32).collect()
    bins = defaultdict(list)
    words = Counter()
    for r in rows:
        assert r.start == r.piece * 32
        bins[r.bin_id].append((r.slot, r.offset, r.n_words))
        words[r.doc_id] += r.n_words
    want = Counter()
    for d, t in docs:
        if t and t.split():
            want[d] += len(t.split())
    assert words == want
    for b in bins.values():
        at = 0
        for k, (slot, offset, n) in enumerate(sorted(b)):
            assert (slot, offset) == (k, at)
            at += n
        assert at <= 32
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(words.values()) // 32) + 2
    assert packing.pack(df.limit(0)).count() == 0
    sized = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, -1), (5, 70)], "doc_id bigint, size int")
    assert {(r.doc_id, r.n_words) for r in packing.pack(sized, 32, length_col="size").collect()} == {(1, 5), (5, 32), (5, 6)}


def test_words_between_unicode_spaces(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) > 25
    docs = [(i, s.join(["ab"] * 50)) for i, s in enumerate(spaces)] + [(100, "\u3000\u00a0 "), (101, "a\u200bb")]
    got = Counter()
    for r in packing.pieces(spark.createDataFrame(docs, "doc_id bigint, text string"), 32).collect():
        assert r.n <= 32
        got[r.id] += r.n
    assert got == Counter({i: 50 for i in range(len(spaces))} | {101: 1})


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j]) for j in range(len(x)) if ids[j] != ids[i])[:k]
        out += [(ids[i], r + 1, j, round(v, 9)) for r, (v, j) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_against_brute_force(spark, clustered):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((260, 8)) * (0.05 if clustered else 1)
    if clustered:
        x += (rng.standard_normal((7, 8)) * 5)[rng.integers(0, 7, 260)]
    x[10], x[11] = x[12], x[12]
    ids = rng.permutation(260).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    shape = {"k": 7, "pivots": 6, "block_rows": 40}
    small = {"chunk": 3, "block_queries": 9}
    for some, options in ((None, {}),) if clustered else ((F.col("vec_id") % 5 == 0, small),):
        got = sorted((r.vec_id, r.rank, r.neighbour, round(r.distance, 9)) for r in topk.neighbours(df, queries=some, **shape, **options).collect())
        assert got == [r for r in brute(x, ids, 7) if some is None or r[0] % 5 == 0]
    if not clustered:
        return
    spent = {r.vec_id: r.evaluated for r in topk.evaluations(df, **shape).collect()}
    assert sorted(spent) == sorted(ids)
    assert max(spent.values()) <= 259
    assert sum(spent.values()) < 260 * 259 / 4
    text = df.select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding")
    assert sorted((r.vec_id, r.rank, r.neighbour) for r in topk.neighbours(text, **shape).collect()) == sorted((f"k{a}", n, f"k{b}") for a, n, b, _ in brute_text(x, ids, 7))


def brute_text(x, ids, k):
    """Ties by the ids as strings."""
    names = [f"k{i}" for i in ids]
    return [(int(a[1:]), n, int(b[1:]), d) for a, n, b, d in brute(x, names, k)]


def test_search_stops_at_the_next_bound():
    x = np.repeat([100.0, 2.0, 60.0, 5000.0], [64, 20, 100, 9816])[:, None]
    bound = np.repeat([0.0, 1.0, 50.0, 1000.0], [64, 20, 100, 9816])[None]
    near, far, spent = topk.search(np.zeros(1), np.zeros(1), np.zeros(0, int), np.inf, x, bound, 10)
    assert near.tolist() == list(range(64, 74))
    assert far.tolist() == [2.0] * 10
    assert spent == 64 + 20 + 100
    near, far, spent = topk.search(np.zeros(1), np.zeros(1), np.arange(64, 70), 2.0, x, bound, 10)
    assert near.tolist() == list(range(70, 80))
    assert spent == 64 + 14
    assert topk.search(np.zeros(1), np.zeros(1), np.zeros(0, int), 1.5, x, bound, 10)[0].tolist() == []


def test_search_with_a_large_common_offset():
    x = np.random.default_rng(4).standard_normal((500, 16)) + 1e6
    ids = np.arange(500)
    t = np.sqrt(((x[:, None] - x[None, :4]) ** 2).sum(2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[ids, ids] = np.inf
    for i in range(0, 500, 7):
        near, _, _ = topk.search(x[i], t[i], np.array([i]), np.inf, x, np.ascontiguousarray(t.T), 10)
        assert (near == np.argsort(d[i], kind="stable")[:10]).all()


def test_neighbours_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [0.0, 1.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x", 2.0) for r in rows], "vec_id bigint, embedding array<double>, id string, v double")
    got = sorted((r.vec_id, r.rank, r.neighbour, r.distance) for r in topk.neighbours(df).collect())
    assert got == [(1, 1, 2, 5.0), (1, 2, 3, 5.0), (2, 1, 3, 0.0), (2, 2, 1, 5.0), (3, 1, 2, 0.0), (3, 2, 1, 5.0)]
    assert topk.neighbours(df.limit(0)).count() == 0
