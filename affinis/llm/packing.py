"""Best-fit packing with exact-complement hashing.

Documents are measured in words (Unicode white space separates them, as in the other operators; a text of a script
without spaces is one word) or by a given length column. What is longer than the
capacity is cut into full pieces and a rest; nothing is truncated. The plan is made on the counts of
lengths alone, at most ``capacity`` numbers whatever the input: an index holds which sums single lengths, pairs and triples of
available lengths have; for each length from the longest, the gap it leaves is looked up in the three, and combinations that fill it
exactly are consumed in bulk under the availability counts; what remains goes by best fit decreasing, in bulk
too. The plan is a short list of patterns with multiplicities; pieces are ranked within their length
(in salted groups of about SALT_ROWS, so that no length is one task's work) and a rank's place in the plan gives bin and offset.

Defined cases: a null, empty or blank text has no piece and no row; a null or non-positive given length likewise; a null id is carried; equal lengths are
ranked by salt, id and piece, so the result is the same on every run (identical rows may swap places); repeated rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import col, cut, slices, table

CAPACITY = 2048
#: Pieces of one length that one task ranks, about.
SALT_ROWS = 1 << 20

Pattern = tuple[tuple[int, ...], int]


def bit_set(flags: np.ndarray) -> int:
    """Bit i is set where flags[i]."""
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def sums(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether some i of a and j of b have the sum s, for s up to limit."""
    size = 2 * limit + 2
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: limit + 1] > 0.5


class SumIndex:
    """The sums up to ``capacity`` of one, two and three available lengths, as sets of bits.

    Lengths only run out, so an entry is never missing; one whose combinations are all gone is found to be stale
    when it is looked up, and struck out. A look-up is a few operations on sets of capacity bits.
    """

    def __init__(self, avail: np.ndarray):
        self.avail, self.capacity = avail, len(avail) - 1
        one = avail > 0
        two = sums(one, one, self.capacity)
        three = sums(two, one, self.capacity)
        self.one, self.three = bit_set(one), bit_set(three)
        # Mirrored: bit capacity - s.
        self.one_back, self.two_back = bit_set(one[::-1]), bit_set(two[::-1])

    def use(self, length: int, n: int) -> None:
        self.avail[length] -= n
        if not self.avail[length]:
            self.one &= ~(1 << length)
            self.one_back &= ~(1 << self.capacity - length)

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """(larger, smaller) available lengths with this sum, the longest first."""
        if not self.two_back >> self.capacity - total & 1:
            return
        both = self.one & (self.one_back >> self.capacity - total)
        if not both:
            self.two_back &= ~(1 << self.capacity - total)
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return
            yield a, total - a
            both &= (1 << a) - 1

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """Available lengths with this sum, in falling order, the longest first."""
        if not self.three >> total & 1:
            return
        firsts = self.one & (self.two_back >> self.capacity - total)
        stale = True
        while firsts:
            a = firsts.bit_length() - 1
            for b, c in self.pairs(total - a):
                stale = False
                if b <= a:
                    yield a, b, c
            firsts &= (1 << a) - 1
            if 3 * a < total:
                break
        if stale:
            self.three &= ~(1 << total)


def exact_fills(avail: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns of up to four lengths that fill a bin exactly; consumes avail (by length)."""
    out: list[Pattern] = []
    index = SumIndex(avail)

    def take(*lengths: int) -> None:
        times = min(int(avail[x]) // lengths.count(x) for x in lengths)
        if times > 0:
            for x in lengths:
                index.use(x, times)
            out.append((lengths, times))

    def fill(length: int, gap: int, found: Iterator[tuple[int, ...]]) -> bool:
        """Consume combinations; whether one was taken, so that the look-up has to start again."""
        for lengths in found:
            before = len(out)
            take(length, *lengths)
            if len(out) > before:
                return avail[length] > 0
        return False

    if avail[capacity]:
        take(capacity)
    while index.one:
        length = index.one.bit_length() - 1
        gap = capacity - length
        if gap and gap <= length and avail[gap]:
            take(length, gap)
        while avail[length] and gap > 1 and fill(length, gap, index.pairs(gap)):
            pass
        while avail[length] and gap > 2 and fill(length, gap, index.triples(gap)):
            pass
        # What is left of this length takes part in no exact fill any more.
        index.one &= ~(1 << length)
        index.one_back &= ~(1 << capacity - length)
    return out


def best_fit(avail: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing of what is left, equal pieces in bulk; consumes avail."""
    room: dict[int, list[Pattern]] = {}
    rooms = 0  # bit r: bins with r free
    for length in np.flatnonzero(avail)[::-1].tolist():
        n = int(avail[length])
        avail[length] = 0
        seen = length
        while n:
            fits = rooms >> seen
            r = seen + (fits & -fits).bit_length() - 1 if fits else capacity
            pattern, bins = room[r].pop() if r < capacity else ((), n)
            each = min(r // length, n)
            used = min(bins, n // each)
            n -= used * each
            if r < capacity:
                if used < bins:
                    room[r].append((pattern, bins - used))
                if not room[r]:
                    rooms &= ~(1 << r)
            left = r - each * length
            room.setdefault(left, []).append((pattern + (length,) * each, used))
            rooms |= 1 << left
    return [p for r in sorted(room) for p in room[r]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        avail[length] = n
    exact = exact_fills(avail, capacity)
    return exact + best_fit(avail, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first bin, slot and offset of each run of ranks, in order of rank."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for lengths, bins in patterns:
        offset = 0
        for slot, length in enumerate(lengths):
            rank = used.get(length, 0)
            runs.setdefault(length, []).append((rank, first_bin, slot, offset))
            used[length] = rank + bins
            offset += length
        first_bin += bins
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}


def word_counts(text: pa.Array) -> np.ndarray:
    """Words of each text; a null has none."""
    clean = pc.utf8_trim_whitespace(text.fill_null("").cast(pa.large_string()))
    n = pc.list_value_length(pc.utf8_split_whitespace(clean)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0, n, 0)


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """(id, piece, n): the pieces of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_counts(batch.column(1)))], names=["id", "size"])

    if length_col:
        sized = docs.select(col(id_col).alias("id"), col(length_col).cast("bigint").alias("size"))
    else:
        texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
        sized = texts.mapInArrow(count, f"id {dict(texts.dtypes)['id']}, size bigint")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) DIV {capacity}")))
    return sized.where("size > 0").select("id", "size", piece.alias("piece")).select("id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("n"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(bin_id, slot, offset, id, piece, start, n_words): each piece's bin, its place there, and the words of its document that it holds."""
    items = cut(pieces(docs, capacity, id_col, text_col, length_col))
    counts = items.groupBy("n").agg(F.count("*").alias("k"))
    runs = places(plan({r["n"]: r["k"] for r in counts.collect()}, capacity))  # at most capacity rows
    salts = counts.select("n", F.ceil(F.col("k") / salt_rows).cast("bigint").alias("salts"))
    salted = items.join(F.broadcast(salts), "n").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.col("salts")))  # at most capacity rows
    # A row for each length and each salt_rows pieces.
    groups = salted.groupBy("n", "salt").agg(F.count("*").alias("k"))
    before = groups.select("n", "salt", (F.sum("k").over(Window.partitionBy("n").orderBy("salt")) - F.col("k")).alias("before"))
    kind = dict(items.dtypes)["id"]
    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("id", "piece"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r, piece = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            out = np.empty((3, len(n)), np.int64)
            for length in np.unique(n).tolist():
                rows = np.flatnonzero(n == length)
                first, bins, slot, offset = runs[length]
                k = np.searchsorted(first, r[rows], side="right") - 1
                out[:, rows] = bins[k] + r[rows] - first[k], slot[k], offset[k]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), batch.column(0), batch.column(3), pa.array(piece * capacity), batch.column(1)], names=["bin_id", "slot", "offset", id_col, "piece", "start", "n_words"])

    ranked = salted.withColumn("r", rank).join(before, ["n", "salt"]).select("id", "n", (F.col("before") + F.col("r") - 1).alias("r"), "piece")
    return ranked.mapInArrow(assign, f"bin_id bigint, slot bigint, offset bigint, `{id_col}` {kind}, piece bigint, start bigint, n_words bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
