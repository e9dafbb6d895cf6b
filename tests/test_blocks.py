"""Joins by blocks of all pairs against those that list collisions, and what is folded in the cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions.families import pack_pool, unpack_pool
from affinis.operators import selfjoin, stats
from affinis.operators.selfjoin import similarity_self_join
from affinis.plans.params import Tensor


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(31)
    x = rng.standard_normal((20, 16))[rng.integers(0, 20, 240)] + rng.standard_normal((240, 16)) * 0.6
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>").cache()


def pairs(df):
    rows = [(r.id_l, r.id_r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("bits", [0, 64])
def test_blocks_find_what_collides(vectors, bits):
    _, df = vectors
    for algorithm in ("local-lsh", "one-level-lsh", "two-level-lsh"):
        options = {"k": 4, "k2": 3, "sketch_bits": bits}
        listed = pairs(similarity_self_join(df, "id", "v", 0.6, algorithm, blocks=False, **options))
        assert listed == pairs(similarity_self_join(df, "id", "v", 0.6, algorithm, blocks=True, groups=3, **options))
        if algorithm != "local-lsh":
            assert listed == pairs(similarity_self_join(df, "id", "v", 0.6, algorithm, blocks=False, hot_rows=9, **options))
        assert len(listed) > 500


def test_few_bits_list_no_collisions(vectors):
    """With 4 bits every pair of rows collides somewhere: no join on hashes, whatever the size of hot buckets."""
    _, df = vectors
    for algorithm in ("local-lsh", "one-level-lsh", "two-level-lsh"):
        plan = similarity_self_join(df, "id", "v", 0.3, algorithm, k=4, k2=4, hot_rows=20)._jdf.queryExecution().toString()
        assert "Join" not in plan
    narrow = selfjoin.make_hasher("cosine", 64, 0.9, 20, None, 0.8, 1, 0)
    assert not selfjoin.blocks_pay(narrow)


def test_counters_by_blocks_equal_those_of_collisions(vectors, monkeypatch):
    _, df = vectors
    for bits in (0, 64):
        got = {tuple(r) for r in stats.join_counters(df, "id", "v", 0.6, k=4, sketch_bits=bits).collect()}
        with monkeypatch.context() as m:
            m.setattr(stats, "blocks_pay", lambda _: False)
            assert got == {tuple(r) for r in stats.join_counters(df, "id", "v", 0.6, k=4, sketch_bits=bits).collect()}
        assert sum(r[-1] for r in got) > 500


def test_counts_folded_in_cells(vectors):
    _, df = vectors
    exact = similarity_self_join(df, "id", "v", 0.6)
    n = exact.count()
    assert stats.near_count(df, "id", "v", 0.6).first()[0] == n
    found = similarity_self_join(df, "id", "v", 0.6, "one-level-lsh", k=4, blocks=False)
    assert stats.recall_of_hashing(df, "id", "v", 0.6, k=4).first() == stats.recall(found, exact).first()
    error = stats.sketch_error(df, "id", "v", 0.6, 128).first()
    assert error.n == n
    assert 0 < error.mean_error < 0.15
    assert abs(error.bias) < 0.05
    for f in (stats.near_count(df.limit(0), "id", "v", 0.6), stats.sketch_error(df.limit(0), "id", "v", 0.6, 64)):
        assert f.first()[0] == 0
    assert stats.recall_of_hashing(df.limit(0), "id", "v", 0.6).first()["recall"] == 1


@pytest.mark.parametrize("most", [50, 10**6])
def test_best_partners_are_kept_cell_by_cell(vectors, most):
    x, df = vectors
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -sim[i]))[:3] if sim[i, j] >= 0.6}
    got = {(r.id_l, r.id_r) for r in selfjoin.first_matches(df, "id", "v", 0.6, 3).collect()}
    assert got == want
    import pyarrow as pa

    ids = pa.chunked_array([pa.array(range(240))])
    found = ((np.minimum(i, j), np.maximum(i, j), sim[i, j]) for i in range(0, 240) for j in [np.arange(i + 1, 240)] for i in [np.full(len(j), i)])
    cell = [t.to_pylist() for t in selfjoin.best_partners(((i, j, s) for i, j, s in found if len(i)), ids, ids, 2, most)][0]
    assert len({(r["id_l"], r["id_r"]) for r in cell}) == len(cell) > 0


def test_expansion_keeps_no_similarities(vectors):
    """Each vector faces all others in one task: what leaves it is one row a vector."""
    x, df = vectors
    plan = stats.expansion(df, [0.2, 0.3])._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert "applyInArrow" not in plan
    sim = x @ x.T
    got = {(r.id, r.range): r.expansion for r in stats.expansion(df, [0.2, 0.95]).collect()}
    for i in range(0, 240, 7):
        for r in (0.2, 0.95):
            s = np.sort(sim[i])[::-1]
            c = int((s >= r).sum())
            assert got[i, r] == pytest.approx(r / s[min(3 * c, len(s) - 1)]) if c < len(s) else got[i, r] == 0
    assert stats.lid(df, [0.2]).where(F.col("lid").isNull()).count() == 0


def test_cells_follow_the_width_of_what_travels(vectors, monkeypatch):
    """Groups, and so the copies of a row, follow its real bytes: floats are half as wide as doubles, and pools of both levels count."""
    _, floats = vectors
    doubles = floats.withColumn("v", F.col("v").cast("array<double>"))
    used = []
    monkeypatch.setattr(selfjoin, "GROUP_BYTES", 1024)
    monkeypatch.setattr(selfjoin, "per_cell", lambda rows, groups, solve, schema: used.append(groups) or rows)
    options = [{"algorithm": "cartesian"}, {"algorithm": "one-level-lsh", "k": 4}, {"algorithm": "local-lsh", "k": 4, "sketch_bits": 64}, {"algorithm": "two-level-lsh", "k": 4, "k2": 4}]
    for df in (floats, doubles):
        for o in options:
            similarity_self_join(df, "id", "v", 0.3, **o)
    wide = [64 + 4 * 16, 64 + 8 * 4 + 4 * 16, 64 + 8 * 5 + 4 * 16, 64 + 8 * (6 + 6) + 4 * 16]  # pools of 6, 6, and 7 and 7 half-hashes, three to a word
    assert used == [-(-240 * (w + more) // 1024) for more in (0, 4 * 16) for w in wide]


def test_half_hashes_of_a_cell_are_narrow():
    pool = np.random.default_rng(4).integers(0, 1 << 15, (50, 17))
    got = unpack_pool(pack_pool(pool), 17)
    assert (got == pool).all()
    assert got.itemsize == 2
    scheme = Tensor(30, 17 * 17, 17)
    for rep in (0, 100, 288):
        assert (selfjoin.hash_of({"left": got, "right": got}, rep, scheme) == pool[:, rep // 17] << 15 | pool[:, rep % 17]).all()
