"""Byte-level BPE encoding and decoding, with two tiers of lookup.

Text is cut into pre-tokens (contractions, words, numbers and other signs with an optional leading
space, white space) by class boundaries that are found for a whole Arrow batch at once. The
distinct pre-tokens of the batch go through two tiers: a minimal perfect hash (displacement
buckets over exactly as many slots as the vocabulary has entries) resolves those that are
vocabulary entries as they stand, confirmed byte by byte; the others are merged by a heap of
ranked pairs over a doubly linked list of bytes. A two-generation memo of bounded size keeps the
merges of recent pre-tokens; it changes speed only.

Defined cases: a null text gives null ids and a null count and round trip; an empty text gives no
ids; repeated rows are each encoded; of equal pairs in one pre-token the leftmost merges first; an
empty table gives no rows; ids come back as ``array<int>``; other columns are not read. The path of the
vocabulary is a parameter.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from affinis.llm.common import col, slices, table, utf8

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    found[SPACES] = SPACE
    return found


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens of many texts, and the number of pre-tokens of each text."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    kind = char_classes()[cp]
    text_start = np.zeros(n + 1, bool)
    text_start[np.searchsorted(at, offsets[:-1])] = True
    run_start = text_start[:n].copy()
    run_start[0] = True
    run_start[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run_start)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    begin = run_start.copy()
    followed = np.append(~text_start[starts[1:]], False)
    space = (kinds == SPACE) & followed
    last = ends[space] - 1
    begin[last] = True
    begin[ends[space][cp[last] == 32]] = False
    quote = np.flatnonzero((kinds == OTHER) & (ends - starts == 1) & followed & (cp[starts] == 39) & begin[starts])
    quote = quote[kinds[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        p = starts[quote]
        a = cp[p + 1]
        b = np.where(ends[quote + 1] - p > 2, cp[np.minimum(p + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        p, size = p[size > 0], size[size > 0]
        begin[p + 1] = False
        after = p + 1 + size
        begin[after[after < n]] = True
    cuts = np.append(at[begin], len(data)).astype(np.int64)
    where = np.searchsorted(cuts, offsets)
    return cuts, np.diff(where)


def byte_hash(data: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """64-bit hashes of byte strings; of those longer than limit, only of their first limit bytes."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = offsets[:-1][order], sizes[order]
    h = np.full(len(order), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(min(limit, int(sizes[0]) if len(sizes) else 0)):
        m = int(np.searchsorted(-sizes, -j, side="left"))
        h[:m] = (h[:m] ^ data[begin[:m] + j]) * np.uint64(0x100000001B3)
    h ^= sizes.astype(np.uint64)
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class PerfectHash:
    """A minimal perfect hash over the given distinct 64-bit key hashes: n keys, n slots."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have one hash")
        self.buckets = max(1, n // 3)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_of = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[edges[b] : edges[b + 1]]
            if len(keys) < 2:
                break
            d, step = 0, 8
            while True:  # blocks of shifts, tried all at once
                slots = np.sort(self._slot(hashes[keys][:, None], np.arange(d, d + step, dtype=np.uint64)), axis=0)
                good = np.flatnonzero(~taken[slots].any(0) & (slots[1:] != slots[:-1]).all(0))
                if len(good):
                    d += int(good[0])
                    break
                d, step = d + step, min(4096, step * 8)
            slot = self._slot(hashes[keys], np.full(len(keys), d, np.uint64))
            taken[slot], self.shift[b], self.key_of[slot] = True, d, keys
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        self.key_of[free] = order[edges[single]]

    def _slot(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(hashes + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The only key that each hash can belong to."""
        d = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slot(hashes, np.maximum(d, 0).astype(np.uint64)))
        return self.key_of[slot]


class ByteBPE:
    MEMO = 300_000

    def __init__(self, path: str = VOCABULARY):
        pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
        words = {base64.b64decode(a): int(b) for a, b in pairs}
        if sorted(words.values()) != list(range(len(words))):
            raise ValueError("ids must run from 0 without a gap")
        self.words = sorted(words, key=words.get)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        self.entries = binary(self.data, self.offsets)
        self.longest = int(np.diff(self.offsets).max())
        self.table = PerfectHash(byte_hash(self.data, self.offsets, self.longest))
        self.single = [words[bytes([i])] for i in range(256)]
        self.merged: dict[int, int] = {}
        for w, i in words.items():
            for k in range(1, len(w)):
                if (a := words.get(w[:k])) is not None and (b := words.get(w[k:])) is not None:
                    self.merged[a << 32 | b] = i
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Merge by a heap of (rank, place) over linked bytes."""
        ids = [self.single[b] for b in word]
        n, get = len(ids), self.merged.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _miss(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = np.array(self.merge(word), np.int32).tobytes()
        if len(word) <= 256:
            if len(self.young) >= self.MEMO:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many texts, and the number of ids of each."""
        cuts, per_text = pretokens(data, offsets)
        coded = binary(data, cuts).dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(len(per_text), np.int64)
        raw, off = utf8(distinct)
        key = self.table.find(byte_hash(raw, off, self.longest))
        hit = pc.equal(distinct, self.entries.take(pa.array(key))).to_numpy(zero_copy_only=False)
        missed = np.flatnonzero(~hit)
        young = self.young
        parts = [young.get(w) or self._miss(w) for w in distinct.take(pa.array(missed)).to_pylist()]
        sizes = np.ones(len(distinct), np.int64)
        sizes[missed] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        flat[begin[hit]] = key[hit]
        inside = np.ones(len(flat), bool)
        inside[begin[hit]] = False
        flat[inside] = np.frombuffer(b"".join(parts), np.int32)
        n = sizes[code]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[code] - total[:-1], n) + np.arange(total[-1])]
        edges = total[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(edges)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many id lists one after another, and their n + 1 offsets."""
        sizes = np.diff(self.offsets)[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.data[np.repeat(self.offsets[:-1][ids] - total[:-1], sizes) + np.arange(total[-1])]
        return data, total[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(2)
def tokenizer(path: str) -> ByteBPE:
    """One for each Python process."""
    return ByteBPE(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids, n_tokens, round_trip); round_trip says whether decoding the ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                data, offsets = utf8(batch.column(1))
                ids, counts = bpe.encode_batch(data, offsets)
                back, edges = bpe.decode_batch(ids, counts)
                same = np.diff(edges) == np.diff(offsets)
                if not (len(back) == len(data) and same.all() and np.array_equal(back, data)):
                    same &= [np.array_equal(back[edges[i] : edges[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(same))]
                null = pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(counts, mask=null), pa.array(same, mask=null)], names=[id_col, "ids", "n_tokens", "round_trip"])

    ids = df.select(col(id_col), col(text_col).cast("string"))
    return ids.mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text) of the lists of ids; null ids give a null text; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, edges = bpe.decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            text = [None if null else data[a:b].tobytes().decode("utf-8", "replace") for a, b, null in zip(edges[:-1], edges[1:], pc.is_null(lists).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=[id_col, "text"])

    ids = df.select(col(id_col), col(ids_col))
    return ids.mapInArrow(run, f"`{id_col}` {dict(ids.dtypes)[id_col]}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
