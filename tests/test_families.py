from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from affinis.functions.families import Bits, Hasher, halves, pack_bits
from affinis.plans.params import COSINE, JACCARD, Tensor, tensor


def arrays(rows, kind):
    return pa.array(list(rows), pa.list_(kind))


def test_hyperplane_collision_rate():
    rng = np.random.default_rng(3)
    bits = Bits(COSINE, 10000, 1, 0, 300)
    for _ in range(5):
        a = rng.standard_normal(300)
        b = a + rng.standard_normal(300)
        cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        h = bits.evaluate(arrays([a, b], pa.float64()))
        assert abs((h[0] == h[1]).mean() - (1 - math.acos(cos) / math.pi)) < 0.02


@pytest.mark.parametrize("k", [1, 3])
def test_min_hash_collision_rate(k):
    rng = np.random.default_rng(4)
    bits = Bits(JACCARD, 10000 * k, 2)
    for _ in range(5):
        a, b = (np.unique(rng.exponential(100, 120).astype(int) % 3000) for _ in range(2))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        h = bits.evaluate(arrays([a, b, a], pa.int64())).reshape(3, -1, k)
        assert (h[0] == h[2]).all()
        assert abs((h[0] == h[1]).all(1).mean() - ((j + 1) / 2) ** k) < 0.05


def test_sketch_estimates():
    a, b = (np.array(v) / np.linalg.norm(v) for v in ([1, 0.2, 0.3, 0.7], [4, 0.2, 2.3, 0.7]))
    h = np.concatenate([Bits(COSINE, 6400, s, 2, 4).evaluate(arrays([a, b], pa.float64())) for s in range(10)], 1)
    assert abs(math.cos(math.pi * (1 - (h[0] == h[1]).mean())) - a @ b) < 0.01
    x, y = list(range(0, 90, 10)), [*range(0, 90, 10), 54]
    h = np.concatenate([Bits(JACCARD, 6400, s, 2).evaluate(arrays([x, y], pa.int64())) for s in range(10)], 1)
    assert abs(2 * (h[0] == h[1]).mean() - 1 - 0.9) < 0.02


def test_pools_and_sketches_are_deterministic():
    scheme = tensor(COSINE, 0.5, 5)
    v = arrays(np.random.default_rng(0).standard_normal((4, 8)), pa.float64())
    one, two = (Hasher(COSINE, scheme, 9, 8, None, 128).columns(v) for _ in range(2))
    assert all((one[k] == two[k]).all() for k in one)
    assert one["left"].shape == (4, scheme.hashers)
    assert one["left"].max() < 8
    assert one["right"].max() < 4
    assert one["sketch"].shape == (4, 2)


def test_bit_order():
    assert pack_bits(np.array([[1, 0, 1]])).tolist() == [5]
    left, right = halves(Tensor(3, 1, 1), np.array([[1, 0, 1]]))
    assert (left.tolist(), right.tolist()) == ([[2]], [[1]])


def test_empty_sets():
    assert Bits(JACCARD, 4, 1).evaluate(arrays([[], [1]], pa.int64()))[0].tolist() == [0, 0, 0, 0]
