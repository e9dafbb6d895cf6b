"""The join of sets by rare tokens against all pairs, and its tight cases."""

from __future__ import annotations

import numpy as np
import pytest

from affinis.operators import setjoin
from affinis.operators.selfjoin import similarity_self_join


@pytest.fixture(scope="module")
def sets(spark):
    """Frequent and rare tokens, sizes from 1, copies, near copies, and sets that contain others."""
    rng = np.random.default_rng(41)
    base = [np.unique((rng.pareto(0.7, rng.integers(1, 60)) * 5).astype(np.int64) % 5000) for _ in range(120)]
    rows = base + base[:15] + [b[rng.random(len(b)) < 0.7] for b in base] + [np.append(b, 10**6 + np.arange(len(b))) for b in base[:40]]
    rows = [sorted(set(r.tolist())) for r in rows if len(r)]
    return rows, spark.createDataFrame(list(enumerate(rows)), "id bigint, v array<bigint>").cache()


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9, 1.0])
def test_every_similar_pair_is_found(sets, threshold):
    rows, df = sets
    s = [set(r) for r in rows]
    sim = {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(len(s)) for j in range(i + 1, len(s))}
    want = {k: x for k, x in sim.items() if x >= threshold - 1e-12}
    got = [(r.id_l, r.id_r, r.similarity) for r in similarity_self_join(df, "id", "v", threshold, groups=3).collect()]
    assert len(got) == len(want)
    assert {(a, b): x for a, b, x in got} == pytest.approx(want)


def test_hashing_finds_the_same_by_rare_tokens(sets):
    _, df = sets
    for algorithm in ("local-lsh", "one-level-lsh", "two-level-lsh"):
        for bits in (0, 64):
            found = [{(r.id_l, r.id_r) for r in similarity_self_join(df, "id", "v", 0.5, algorithm, k=6, k2=3, sketch_bits=bits, blocks=b).collect()} for b in (False, True)]
            assert found[0] == found[1]


def test_unrelated_sets_are_not_listed(spark):
    """Pairs whose sizes fit and that share a rare token or two, but not enough of them, don't leave the cell."""
    rng = np.random.default_rng(42)
    rows = [rng.choice(400, n, replace=False) for n in rng.integers(40, 90, 200)]
    place = np.argsort(np.argsort(np.bincount(np.concatenate(rows), minlength=400), kind="stable"))

    def side():
        some = sorted((np.sort(place[r]) for r in rows), key=len)
        size = np.array([len(r) for r in some])
        length = size - np.ceil(0.5 * size - 1e-9).astype(np.int64) + 1
        level = lambda p: p // 8
        last = np.array([(level(r[n - 1]) << 55) + r[n - 1] for r, n in zip(some, length, strict=True)])
        below = np.array([[(level(r) < k).sum() for k in range(setjoin.LEVELS)] for r in some])
        return some, {"code": np.concatenate([r[:n] for r, n in zip(some, length, strict=True)]), "at": np.append(0, np.cumsum(length)), "size": size, "rest": size - length, "last": last, "below": below}

    some, cols = side()
    found = {(i, j) for a, b in setjoin.sharing(cols, cols, 0.5, True) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(np.intersect1d(some[i], some[j])) * 1.5 >= 0.5 * (len(some[i]) + len(some[j]))}
    assert want <= found
    assert len(found) < 2000 < 200 * 199 // 2
