"""LSH families: random one-bit functions for vectors (hyperplanes) and for token sets (lowest bit of a min-hash).

Parameters are drawn on the driver from one seed (stream 0 for pools, 1 and 2 for the second level and
sketches) and travel to the workers in the closure, so each worker evaluates the same functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.plans.params import COSINE, JACCARD, Tensor

#: Min-hashes are (a * x + b) mod PRIME, which fits 64 bits for a, b and x below it.
PRIME = 2**31 - 1


def measure_of(df: DataFrame, column: str) -> str:
    """Cosine for arrays of fractions, Jaccard for arrays of whole numbers or strings."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{column} must be an array")
    return COSINE if isinstance(kind.elementType, T.FractionalType) else JACCARD


@dataclass
class Bits:
    """n one-bit functions."""

    measure: str
    n: int
    seed: int
    stream: int = 0
    dim: int = 0
    a: np.ndarray = field(init=False, repr=False)
    b: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng([self.seed, self.stream])
        if self.measure == COSINE:
            self.a, self.b = rng.standard_normal((self.n, self.dim)), np.zeros(0)
        else:
            self.a, self.b = rng.integers(1, PRIME, self.n), rng.integers(0, PRIME, self.n)

    def evaluate(self, values: pa.Array) -> np.ndarray:
        """(rows, n) of 0 and 1. An empty set has all bits 0."""
        size = np.diff(np.asarray(values.offsets))
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if self.measure == COSINE:
            return (flat.astype(np.float64).reshape(-1, self.dim) @ self.a.T >= 0).astype(np.int64)
        out = np.zeros((len(values), self.n), np.int64)
        some = np.flatnonzero(size > 0)
        begin = (np.cumsum(size) - size)[some]
        x = flat.astype(np.int64) % PRIME
        for f in range(self.n if len(some) else 0):
            out[some, f] = np.minimum.reduceat((x * self.a[f] + self.b[f]) % PRIME, begin) & 1
        return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """(rows, k) bits, first highest, to numbers."""
    return bits @ (1 << np.arange(bits.shape[1], dtype=np.int64)[::-1])


def halves(scheme: Tensor, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of left and right half-hashes, each (rows, hashers)."""
    rows = bits.reshape(len(bits), scheme.hashers, scheme.k)
    left = np.stack([pack_bits(rows[:, h, : scheme.k_left]) for h in range(scheme.hashers)], 1)
    right = np.stack([pack_bits(rows[:, h, scheme.k_left :]) for h in range(scheme.hashers)], 1)
    return left, right


#: Half-hashes of a pool are packed LANES to a 64-bit word, LANE bits each; they have at most 15 bits.
LANES, LANE, TOP = 3, 20, 0x8000
ONES, FLAGS = (sum(bit << (LANE * i) for i in range(LANES)) for bit in (0xFFFF, 0x10000))


def words_of(n: int) -> int:
    return -(-n // LANES)


def pack_pool(x: np.ndarray) -> np.ndarray:
    """(rows, hashers) half-hashes to (rows, words)."""
    wide = np.zeros((len(x), words_of(x.shape[1]) * LANES), np.int64)
    wide[:, : x.shape[1]] = x
    return (wide.reshape(len(x), -1, LANES) << (LANE * np.arange(LANES))).sum(2)


def unpack_pool(words: np.ndarray, n: int) -> np.ndarray:
    """(rows, words) to the n half-hashes of each row, in 16 bits each: all rows of a cell are held."""
    out = np.empty((len(words), words.shape[1], LANES), np.int16)
    for lane in range(LANES):
        out[:, :, lane] = words >> (LANE * lane) & 0xFFFF
    return out.reshape(len(words), words.shape[1] * LANES)[:, :n]


def bitmaps(values: pa.Array, words: int) -> np.ndarray:
    """(rows, words) bitmaps of 64-bit words, a power of two of them: each token of a set sets one bit.

    Two bitmaps differ in at most as many bits as the sets have tokens that they don't share.
    """
    bits = 64 * words
    size = np.diff(np.asarray(values.offsets))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    bit = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    on = np.zeros(len(size) * bits, bool)
    on[np.repeat(np.arange(len(size)) * bits, size) + bit] = True
    return np.packbits(on, bitorder="little").view(np.int64).reshape(len(size), words)


def as_lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


@dataclass
class Hasher:
    """Adds pools (left, right; with a second scheme left2, right2), a sketch, and the size and a bitmap of sets to (id, v) rows."""

    measure: str
    scheme: Tensor
    seed: int
    dim: int = 0
    inner: Tensor | None = None
    sketch_bits: int = 0
    bitmap_words: int = 0

    def functions(self) -> tuple[Bits, Bits | None, Bits | None]:
        one = Bits(self.measure, self.scheme.hashers * self.scheme.k, self.seed, 0, self.dim)
        two = Bits(self.measure, self.inner.hashers * self.inner.k, self.seed, 1, self.dim) if self.inner else None
        return one, two, Bits(self.measure, self.sketch_bits, self.seed, 2, self.dim) if self.sketch_bits else None

    def columns(self, v: pa.Array) -> dict[str, np.ndarray]:
        one, two, sketch = self.functions()
        out = dict(zip(("left", "right"), halves(self.scheme, one.evaluate(v)), strict=True))
        if two:
            out |= dict(zip(("left2", "right2"), halves(self.inner, two.evaluate(v)), strict=True))
        words = self.sketch_bits // 64
        bits = sketch.evaluate(v) if sketch else np.zeros((len(v), 0), np.int64)
        out["sketch"] = np.packbits(bits.astype(np.uint8), axis=1).view(">i8").astype(np.int64).reshape(len(v), words) if words else np.zeros((len(v), 0), np.int64)
        out["size"] = np.diff(np.asarray(v.offsets)).astype(np.int32)
        out["bitmap"] = bitmaps(v, self.bitmap_words) if self.bitmap_words else np.zeros((len(v), 0), np.int64)
        return out

    def add(self, df: DataFrame, keep_value: bool = False) -> DataFrame:
        """df: (id, v). v itself stays only if asked for: what is exploded and shuffled should be slim."""
        names = ["left", "right", *(("left2", "right2") if self.inner else ())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = self.columns(b.column(1))
                out = [b.column(0), *([b.column(1)] if keep_value else []), *(as_lists(pack_pool(got[n]), pa.int64()) for n in names), as_lists(got["sketch"], pa.int64()), pa.array(got["size"]), as_lists(got["bitmap"], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["id", *(["v"] if keep_value else []), *names, "sketch", "size", "bitmap"])

        kinds = dict(df.dtypes)
        schema = f"id {kinds['id']}" + (f", v {kinds['v']}" if keep_value else "") + "".join(f", {n} array<bigint>" for n in names) + ", sketch array<bigint>, size int, bitmap array<bigint>"
        return df.select("id", "v").mapInArrow(run, schema)


def at_lane(pool: Column, i: str) -> Column:
    """The half-hash at index i, an SQL expression, of a packed pool."""
    word = F.element_at(pool, F.expr(f"CAST(({i}) DIV {LANES} AS INT) + 1"))
    return F.call_function("shiftrightunsigned", word, F.expr(f"CAST({LANE} * (({i}) % {LANES}) AS INT)")).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def hash_at(left: Column, right: Column, rep: str, scheme: Tensor) -> Column:
    """The k-bit hash at a repetition."""
    return F.shiftleft(at_lane(left, f"{rep} DIV {scheme.hashers}"), scheme.k_right).bitwiseOR(at_lane(right, f"{rep} % {scheme.hashers}"))


def prefix_words(pool: Column, i: Column, n: int) -> list[Column]:
    """The words of a pool of n half-hashes, those from index i on replaced by a value that no half-hash equals."""
    marks = sum(TOP << (LANE * x) for x in range(LANES))
    out = []
    for w in range(words_of(n)):
        lanes = F.least(F.greatest(i - w * LANES, F.lit(0)), F.lit(LANES))
        keep = F.call_function("shiftleft", F.lit(1).cast("bigint"), lanes * LANE) - 1
        out.append(pool.getItem(w).bitwiseAND(keep).bitwiseOR(F.bitwise_not(keep).bitwiseAND(F.lit(marks).cast("bigint"))))
    return out


def none_equal(left: list[Column], right: list[Column]) -> Column:
    """Whether no two half-hashes at one place are equal. Adding ONES carries into a lane's flag unless its difference is 0; each word is used once, so the compiled test is short."""
    zero = [F.bitwise_not(a.bitwiseXOR(b) + F.lit(ONES).cast("bigint")).bitwiseAND(F.lit(FLAGS).cast("bigint")) for a, b in zip(left, right, strict=True)]
    found = zero[0]
    for z in zero[1:]:
        found = found.bitwiseOR(z)
    return found == 0
