"""Parameters of the locality-sensitive-hashing strategies: pure functions of threshold, recall and widths."""

from __future__ import annotations

import math
from dataclasses import dataclass

COSINE, JACCARD = "cosine", "jaccard"


def probability(measure: str, similarity: float) -> float:
    """Chance that one random bit of two items agrees."""
    s = max(-1.0, min(1.0, similarity))
    return 1 - math.acos(s) / math.pi if measure == COSINE else (s + 1) / 2


def simple_repetitions(p: float, k: int) -> int:
    return math.ceil(2 * p**-k)


@dataclass(frozen=True)
class Tensor:
    """k-bit hashes made of two halves, each from a pool of ``hashers`` functions; ``repetitions`` <= hashers squared."""

    k: int
    repetitions: int
    hashers: int

    @property
    def k_left(self) -> int:
        return (self.k + 1) // 2

    @property
    def k_right(self) -> int:
        return self.k // 2


def tensor(measure: str, threshold: float, k: int, recall: float = 0.8) -> Tensor:
    if not 2 <= k <= 30:
        raise ValueError("k must be from 2 to 30")
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    p = probability(measure, threshold)
    if p >= 1:
        return Tensor(k, 1, 1)
    left, right = p ** ((k + 1) // 2), p ** (k // 2)
    reps = max(1, math.ceil(math.log(1 - math.sqrt(recall)) ** 2 / (math.log(1 - left) * math.log(1 - right))))
    return Tensor(k, reps, math.ceil(math.sqrt(reps)))


def two_level(measure: str, threshold: float, k: int, k2: int, recall: float = 0.8) -> tuple[Tensor, Tensor]:
    """Outer and inner scheme whose recalls multiply to the wanted one, with the fewest repetitions in all."""
    splits, eps = [(math.sqrt(recall), math.sqrt(recall))], 0.01
    while eps <= 0.99 - recall:
        splits.append((recall + eps, recall / (recall + eps)))
        eps += 0.001
    pairs = [(tensor(measure, threshold, k, a), tensor(measure, threshold, k2, b)) for a, b in splits]
    return min(pairs, key=lambda t: t[0].repetitions * t[1].repetitions)


def sketch_threshold(measure: str, bits: int, similarity: float, epsilon: float = 0.01) -> int:
    """Most differing bits that a pair of this similarity has with probability 1 - epsilon, counted as the number of terms added."""
    if bits == 0:
        return 1
    p = 1 - probability(measure, similarity)
    total, t = 0.0, 0
    while total < 1 - epsilon and t <= bits:
        total += math.comb(bits, t) * p**t * (1 - p) ** (bits - t)
        t += 1
    return t


def triangle_groups(workers: int) -> int:
    """Least number of groups whose upper triangle of cells has at least one cell a worker."""
    g = 1
    while g * (g + 1) // 2 < workers:
        g += 1
    return g


def diagonal_order(i: int, j: int, groups: int) -> int:
    """Place of cell (i, j), i <= j, when the triangle is read diagonal by diagonal."""
    d = j - i
    return d * groups - d * (d - 1) // 2 + i


def worker_grid(workers: int) -> tuple[int, int]:
    """Rows and columns: the largest divisor up to the square root, and its partner."""
    rows = next(r for r in range(math.isqrt(workers), 0, -1) if workers % r == 0)
    return rows, workers // rows


def required_overlap(size_l: int, size_r: int, threshold: float) -> float:
    t = threshold * (size_l + size_r) / (1 + threshold)
    return float(round(t)) if abs(t - round(t)) < 1e-14 else t


def grid_cell(worker: int, workers: int) -> tuple[int, int]:
    """Row and column of a worker in the grid, row by row."""
    return divmod(worker, worker_grid(workers)[1])


def grid_worker(row: int, column: int, workers: int) -> int:
    return row * worker_grid(workers)[1] + column


def grid_worker_of(left: int, right: int, workers: int) -> int:
    """The worker for a pair of keys."""
    rows, columns = worker_grid(workers)
    return grid_worker(left % rows, right % columns, workers)


@dataclass(frozen=True)
class Shared:
    """Another way to pool bits: ``bits`` one-bit functions for each of k places; a repetition picks one of each place's by a linear rule."""

    k: int
    repetitions: int
    bits: int

    def picks(self, repetition: int, a: list[int], b: list[int]) -> list[int]:
        """Which of its bits each place takes, for multipliers a and offsets b."""
        return [(x * repetition + y) % self.bits for x, y in zip(a, b, strict=True)]


def shared(measure: str, threshold: float, k: int) -> Shared:
    p = probability(measure, threshold)
    return Shared(k, simple_repetitions(p, k), math.ceil(5 * k / p))
