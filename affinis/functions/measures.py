"""Similarity measures as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where body's lambdas would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector; null where the norm is 0."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (arrays without repetition); null where both are empty."""
    return let(overlap(a, b), lambda both: F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")))


def length_filter(size_a: Column, size_b: Column, threshold: float) -> Column:
    """What the sizes of two sets must satisfy for their Jaccard similarity to reach the threshold."""
    return (size_a >= F.lit(threshold - 1e-12) * size_b) & (size_b >= F.lit(threshold - 1e-12) * size_a)


def different_bits(a: Column, b: Column, words: int) -> Column:
    """Of two sketches, arrays of so many 64-bit words."""
    return sum((F.bit_count(a.getItem(i).bitwiseXOR(b.getItem(i))) for i in range(1, words)), F.bit_count(a.getItem(0).bitwiseXOR(b.getItem(0))))


def same_bits(a: Column, b: Column, words: int) -> Column:
    return F.lit(64 * words) - different_bits(a, b, words)


def estimate(same: Column, bits: int, measure: str) -> Column:
    """Similarity estimated from the number of equal sketch bits."""
    share = same / F.lit(float(bits))
    return F.cos(F.lit(3.141592653589793) * (1 - share)) if measure == "cosine" else 2 * share - 1
