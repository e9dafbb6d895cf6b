from __future__ import annotations

import math

import pytest

from affinis.plans.params import COSINE, JACCARD, diagonal_order, required_overlap, simple_repetitions, sketch_threshold, tensor, triangle_groups, two_level, worker_grid

KS = (2, 3, 4, 6, 8, 10, 12)


@pytest.mark.parametrize(
    ("measure", "threshold", "want"),
    [
        (COSINE, 0.5, [(5, 3), (8, 3), (15, 4), (41, 7), (105, 11), (254, 16), (599, 25)]),
        (COSINE, 0.7, [(3, 2), (5, 3), (8, 3), (18, 5), (37, 7), (73, 9), (140, 12)]),
        (COSINE, 0.9, [(2, 2), (2, 2), (3, 2), (6, 3), (9, 3), (14, 4), (21, 5)]),
        (JACCARD, 0.5, [(3, 2), (5, 3), (8, 3), (17, 5), (35, 6), (69, 9), (132, 12)]),
        (JACCARD, 0.7, [(2, 2), (3, 2), (4, 2), (6, 3), (10, 4), (15, 4), (23, 5)]),
        (JACCARD, 0.9, [(1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (3, 2), (3, 2)]),
    ],
)
def test_repetitions(measure, threshold, want):
    assert [(t.repetitions, t.hashers) for t in (tensor(measure, threshold, k) for k in KS)] == want


@pytest.mark.parametrize(
    ("measure", "threshold", "want"),
    [(COSINE, 0.5, [31, 56, 104, 197]), (JACCARD, 0.5, [25, 45, 81, 152]), (COSINE, 0.7, [26, 45, 82, 154]), (JACCARD, 0.7, [18, 30, 53, 97]), (COSINE, 0.9, [17, 29, 51, 93]), (JACCARD, 0.9, [9, 14, 23, 39])],
)
def test_sketch_thresholds(measure, threshold, want):
    assert [sketch_threshold(measure, b, threshold) for b in (64, 128, 256, 512)] == want
    assert sketch_threshold(measure, 0, threshold) == 1


def test_two_level():
    assert [t.repetitions for t in two_level(COSINE, 0.5, 4, 6)] == [23, 74]
    assert [t.repetitions for t in two_level(JACCARD, 0.5, 4, 6)] == [12, 30]


def test_geometry():
    assert triangle_groups(1) == 1
    assert triangle_groups(40) == 9
    assert [worker_grid(n) for n in (16, 32, 40)] == [(4, 4), (4, 8), (5, 8)]
    n = 5
    assert [(i, i + d) for d in range(n) for i in range(n - d)] == sorted(((i, j) for i in range(n) for j in range(i, n)), key=lambda c: diagonal_order(*c, n))


def test_small_functions():
    assert simple_repetitions(0.5, 3) == 16
    assert required_overlap(10, 10, 1 / 3) == 5.0
    assert math.isclose(required_overlap(3, 4, 0.5), 7 / 3)
    for bad in (1, 33):
        with pytest.raises(ValueError, match="k must"):
            tensor(COSINE, 0.5, bad)
    with pytest.raises(ValueError, match="recall"):
        tensor(COSINE, 0.5, 4, 1.0)
