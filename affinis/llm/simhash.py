"""SimHash near-duplicate removal with bit-sliced comparison.

Each text gets a 256-bit SimHash of its set of distinct words (lower case, outer punctuation
removed). Equal hashes collapse to one representative. Representatives meet in hash tables keyed by
``bits`` sampled positions; the number of bits follows the number of representatives (so that
buckets stay small at any size) and the number of tables from the wanted recall, at SHARE and, for pairs that differ
in as many bits as the radius allows, at the radius itself. Within the buckets of a
partition the hashes are stored as vertical bit planes; a row is compared with its s-th successor
for all rows at once: the planes are XORed with themselves shifted by s lanes, counted by
carry-save adders into bit-sliced counters, and a block of 64 lanes is abandoned as soon as all of its
lanes exceed the radius. A bucket of more than HOT_ROWS rows is cut into groups, and each two groups are a task's work, so
that every pair of it is compared however large it is. Pairs become groups by connected components, first within a partition, then over
all by alternating star contraction. A pair counts as a link in the first table that joins it, which its two hashes tell, so pairs
are counted where they are found and never written out.

Defined cases: a null text, or one without a word, belongs to no group and stays; rows with a null id belong
to no group and stay; rows that repeat an id are one document, with the smallest of their hashes, and the one of them with the least text stays; of a group the
smallest id stays; ids may be numbers or strings; texts are hashed whole, however long; an empty table gives an empty result;
other columns are carried through by the filter and not read otherwise.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.bpe import byte_hash, mix
from affinis.llm.common import col, cut, slices, table, utf8

BITS, RADIUS, RECALL = 256, 52, 0.98
#: Share of differing bits for which the tables must reach the recall.
SHARE = 0.14
#: Recall of pairs right at the radius; nearer ones are found more often.
EDGE_RECALL = 0.9
#: Rows of a bucket, on average, beyond which keys get wider.
BUCKET_ROWS = 128
#: Rows of a bucket beyond which it is cut into groups of about this size; keyed rows of a task, about.
HOT_ROWS, TASK_ROWS = 8192, 1 << 17
PUNCTUATION = string.punctuation + "¡¿«»„“”‘’…–—·"


def word_hashes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(n, 32) bytes: 256-bit hashes of byte strings."""
    h = byte_hash(raw, off, 1 << 30)
    return np.stack([mix(h + np.uint64(c)) for c in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)], 1).view(np.uint8).reshape(-1, 32)


def simhashes(text: pa.Array) -> list[bytes | None]:
    """The hash of each text; None where there is no word."""
    lists = pc.utf8_split_whitespace(text.fill_null("").cast(pa.large_string()))
    n = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return [None] * len(text)
    clean = pc.utf8_trim(pc.utf8_lower(words.dictionary), PUNCTUATION).dictionary_encode()
    code = clean.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    raw, off = utf8(clean.dictionary)
    rows = np.repeat(np.arange(len(n)), n)
    real = (np.diff(off) > 0)[code]
    size = len(off) - 1
    pairs = np.unique(rows[real] * size + code[real])
    row, code = pairs // size, pairs % size
    edges = np.searchsorted(row, np.arange(len(n) + 1))
    bits = np.unpackbits(word_hashes(raw, off), axis=1)
    out: list[bytes | None] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            out.append(None)
            continue
        ones = np.zeros(BITS, np.int64)
        for k in range(a, b, 4096):
            ones += bits[code[k : min(b, k + 4096)]].sum(0, dtype=np.uint32)
        out.append(np.packbits(2 * ones > b - a).tobytes())
    return out


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sim)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhashes(batch.column(1)), pa.binary())], names=["id", "sim"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.where("id IS NOT NULL").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, sim binary")


def plan(n: int, recall: float = RECALL, share: float = SHARE, radius: int = RADIUS, edge_recall: float = EDGE_RECALL) -> tuple[int, int]:
    """Bits of a table's key, and number of tables, for n hashes: recall at share, and edge_recall at radius differing bits."""
    bits = min(40, max(16, math.ceil(math.log2(max(n, 2) / BUCKET_ROWS))))
    edge = math.comb(BITS - radius, bits) / math.comb(BITS, bits)
    if not edge:
        raise ValueError(f"radius {radius} leaves no {bits} equal bits")
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** bits))
    return bits, max(tables, math.ceil(math.log(1 - edge_recall) / math.log1p(-edge)) if edge < 1 else 1)


def positions(bits: int, tables: int) -> np.ndarray:
    """(tables, bits) sampled positions; the positions of a table differ."""
    rng = np.random.default_rng(20)
    per = BITS // bits
    return np.concatenate([rng.permutation(BITS)[: per * bits].reshape(per, bits) for _ in range(-(-tables // per))])[:tables]


def add_planes(planes: np.ndarray) -> list[np.ndarray]:
    """Vertical counters (lowest bit first) of how many of the planes have a lane set, by carry-save adders."""
    level, out = planes, []
    while len(level):
        carries = []
        while len(level) > 1:
            t = len(level) // 3
            if t:
                a, b, c = level[:t], level[t : 2 * t], level[2 * t : 3 * t]
                x = a ^ b
                carries.append((a & b) | (c & x))
                level = np.concatenate([x ^ c, level[3 * t :]])
            else:
                carries.append((level[:1] & level[1:]))
                level = level[:1] ^ level[1:]
        out.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    return out


def add_counters(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Ripple-carry sum of two vertical counters."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        terms = [x for x in (a[k] if k < len(a) else None, b[k] if k < len(b) else None, carry) if x is not None]
        if len(terms) == 1:
            s, carry = terms[0], None
        elif len(terms) == 2:
            s, carry = terms[0] ^ terms[1], terms[0] & terms[1]
        else:
            x = terms[0] ^ terms[1]
            s, carry = x ^ terms[2], (terms[0] & terms[1]) | (terms[2] & x)
        out.append(s)
    return [*out, carry] if carry is not None else out


def at_most(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter is at most limit."""
    if limit >= 1 << len(counter):
        return np.full_like(counter[0], np.iinfo(np.uint64).max)
    greater, equal = np.zeros_like(counter[0]), np.full_like(counter[0], np.iinfo(np.uint64).max)
    for k in reversed(range(len(counter))):
        if limit >> k & 1:
            equal = equal & counter[k]
        else:
            greater, equal = greater | (equal & counter[k]), equal & ~counter[k]
    return ~greater


def near_pairs(sims: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, block: int = 2048, step: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, of rows that are sorted by bucket and share one. sims: (n, 32) bytes."""
    n = len(sims)
    width = n // 64 + 1
    planes = np.zeros((BITS, (width + 1) * 8), np.uint8)
    for lo in range(0, n, 32768):
        some = np.packbits(np.unpackbits(sims[lo : lo + 32768], axis=1).T, axis=1, bitorder="little")
        planes[:, lo // 8 : lo // 8 + some.shape[1]] = some
    planes = planes.view(np.uint64)
    ends = np.searchsorted(bucket, bucket, side="right")
    rest = np.zeros(width * 64, np.int64)
    rest[:n] = ends - 1 - np.arange(n)
    most = rest.reshape(width, 64).max(1)
    planes = np.concatenate([planes, np.zeros((BITS, max(1, int(most.max(initial=0)) // 64 + 2)), np.uint64)], 1)
    left = rest.reshape(width, 64)

    def compare(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        far, near = s // 64, (s % 64).astype(np.uint64)
        alive = np.packbits(left[w] >= s[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        counter: list[np.ndarray] = []
        for k in range(0, BITS, step):
            p = planes[k : k + step]
            other = (p[:, w + far] >> near) | (p[:, w + far + 1] << np.uint64(1) << (np.uint64(63) - near))
            counter = add_counters(counter, add_planes(p[:, w] ^ other))
            if k + step > radius:
                alive = alive & at_most(counter, radius)
                on = alive != 0
                if not on.all():
                    w, s, alive, counter = w[on], s[on], alive[on], [c[on] for c in counter]
                    far, near = far[on], near[on]
                    if not len(w):
                        return None
        hit, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = w[hit] * 64 + lane
        return i, i + s[hit]

    some: list[tuple[np.ndarray, np.ndarray]] = []
    held, last = 0, int(most.max(initial=0))
    for s in range(1, last + 1):
        words = np.flatnonzero(most >= s)
        for lo in range(0, len(words), block):
            w = words[lo : lo + block]
            some.append((w, np.full(len(w), s)))
            held += len(w)
            if held >= block or (s == last and lo + block >= len(words)):
                found = compare(*(np.concatenate(x) for x in zip(*some, strict=True)))
                some, held = [], 0
                if found:
                    yield found


def components(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of the component of each of n rows."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        new = parent[a] != parent[b]
        if new.any():
            for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            up = parent[parent]
            while not np.array_equal(up, parent):
                parent[:] = up
                up = parent[parent]
    return parent


def first_tables(where: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """What ``first_table`` looks up, for runs of tables with different positions: (32, 256) sets of the tables that a byte of differing bits hits; the first table, and how many."""
    per = BITS // where.shape[1]
    out = []
    for lo in range(0, len(where), per):
        some = where[lo : lo + per]
        hit = np.zeros((BITS // 8, 256), np.uint64)
        for t, at in enumerate(some):
            for p in at.tolist():
                hit[p // 8, (np.arange(256) >> (7 - p % 8) & 1) == 1] |= np.uint64(1 << t)
        out.append((hit, lo, len(some)))
    return out


def first_table(differ: np.ndarray, looked: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """The first table in whose positions no bit differs; -1: none. differ: (n, 32) bytes."""
    out = np.full(len(differ), -1)
    open_ = np.arange(len(differ))
    for hit, lo, n in looked:
        if not len(open_):
            break
        reached = np.zeros(len(open_), np.uint64)
        for k in range(BITS // 8):
            reached |= hit[k][differ[open_, k]]
        free = ~reached & np.uint64((1 << n) - 1)
        low = free & (~free + np.uint64(1))
        some = free != 0
        out[open_[some]] = lo + np.round(np.log2(low[some].astype(np.float64))).astype(np.int64)
        open_ = open_[~some]
    return out


def links(reps: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(u, v, n): v, if there, is a node that u is linked to, so that near representatives that share a bucket end up connected; n: links of u that were counted."""
    where = positions(*plan(n, recall, radius=radius))
    tables, looked = len(where), first_tables(where)
    kind = dict(reps.dtypes)["id"]
    slots = reps.sparkSession.sparkContext.defaultParallelism

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = utf8(batch.column(1))
            bits = np.unpackbits(raw.reshape(-1, BITS // 8), axis=1).astype(np.int64)
            for t, at in enumerate(where):
                key = bits[:, at] @ (1 << np.arange(len(at)))
                yield pa.RecordBatch.from_arrays([pa.array(key * tables + t), batch.column(0), batch.column(1)], names=["bucket", "id", "sim"])

    def solve(rows: pa.Table, bucket: np.ndarray, side: np.ndarray | None = None) -> pa.RecordBatch:
        """rows: (.., id, sim), sorted by bucket. side: only pairs of two sides count, and those of equal sides where it is negative."""
        table = bucket % tables
        known, node = np.unique(rows["id"].to_numpy(), return_inverse=True)
        sims = utf8(rows["sim"])[0].reshape(-1, BITS // 8)
        count = np.zeros(len(known), np.int64)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in near_pairs(sims, bucket, radius):
                if side is not None:
                    keep = (side[a] != side[b]) | (side[a] < 0)
                    a, b = a[keep], b[keep]
                for lo in range(0, len(a), 1 << 18):
                    i, j = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
                    new = first_table(sims[i] ^ sims[j], looked) == table[i]
                    count[:] += np.bincount(node[i[new]], minlength=len(known)) + np.bincount(node[j[new]], minlength=len(known))
                yield node[a], node[b]

        top = components(len(known), found())
        u = np.flatnonzero((top != np.arange(len(top))) | (count > 0))
        names = pa.array(known, rows.schema.field("id").type)
        return pa.RecordBatch.from_arrays([names.take(pa.array(u)), names.take(pa.array(top[u], mask=top[u] == u)), pa.array(count[u])], names=["u", "v", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Small buckets are solved, a task's worth at once; the rows of large ones are handed on."""
        held: list[pa.RecordBatch] = []  # whole small buckets
        last: list[pa.RecordBatch] = []  # the bucket that has begun
        here, size, done = None, 0, 0

        def small() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                got = solve(rows, rows["bucket"].to_numpy())
                none = pa.nulls(len(got), pa.int64()), pa.nulls(len(got), pa.binary())
                yield pa.RecordBatch.from_arrays([*got.columns, *none], names=["u", "v", "n", "bucket", "sim"])

        def hot(rows: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows.column(1), pa.nulls(len(rows), rows.column(1).type), pa.nulls(len(rows), pa.int64()), rows.column(0), rows.column(2)], names=["u", "v", "n", "bucket", "sim"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            if not len(bucket):
                continue
            cuts = np.append(np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket))
            ends = np.diff(cuts)
            for first, end in ((0, 1), (1, len(ends) - 1), (max(1, len(ends) - 1), len(ends))):  # what may go on from before, what lies within, what may go on
                if first >= end:
                    continue
                lo, hi = int(cuts[first]), int(cuts[end])
                if bucket[lo] != here:
                    if 1 < size <= hot_rows:
                        held += last
                        done += size
                    here, last, size = None, [], 0
                if end - first == 1 and first != 1 or end == len(ends):
                    here = bucket[lo]
                    size += hi - lo
                    last.append(batch.slice(lo, hi - lo))
                    if size > hot_rows:
                        yield from map(hot, last)
                        last = []
                    continue
                each = np.repeat(ends[first:end], ends[first:end])
                fit = np.flatnonzero((each > 1) & (each <= hot_rows))
                if len(fit):
                    held.append(batch.slice(lo, hi - lo).take(pa.array(fit)))
                    done += len(fit)
                if (each > hot_rows).any():
                    yield hot(batch.slice(lo, hi - lo).filter(pa.array(each > hot_rows)))
            if done > TASK_ROWS:
                yield from small()
                done = 0
        if 1 < size <= hot_rows:
            held += last
        yield from small()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell."""
        held: list[pa.RecordBatch] = []
        here = None

        def cell() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                i, j, group = (rows[name].to_numpy() for name in ("i", "j", "g"))
                yield solve(rows, rows["bucket"].to_numpy(), np.where(i == j, -1, group))

        for batch in batches:
            if batch.num_rows:
                key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
                cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
                for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                    if tuple(key[lo].tolist()) != here:
                        yield from cell()
                        here = tuple(key[lo].tolist())
                    held.append(batch.slice(lo, hi - lo))
        yield from cell()

    keyed = reps.select("id", "sim").mapInArrow(keys, f"bucket bigint, id {kind}, sim binary")
    tasks = max(2 * slots, -(-n * tables // TASK_ROWS))
    first = cut(keyed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, f"u {kind}, v {kind}, n bigint, bucket bigint, sim binary"))
    found = first.where("bucket IS NULL").select("u", "v", "n")
    hot = first.where("bucket IS NOT NULL").select("bucket", F.col("u").alias("id"), "sim")
    groups = hot.groupBy("bucket").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("groups"))
    parts = hot.join(groups, "bucket").withColumn("g", F.pmod(F.xxhash64("id"), "groups").cast("int"))
    place = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda o: F.struct(F.least(o, "g").alias("i"), F.greatest(o, "g").alias("j")))
    spread = parts.select("bucket", F.explode(place).alias("c"), "g", "id", "sim").select("bucket", "c.i", "c.j", "g", "id", "sim")
    return found.unionByName(spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(cells, f"u {kind}, v {kind}, n bigint"))


def roots(links: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each u that isn't; by alternating stars.

    Least neighbours are aggregated and joined, so that a node with very many neighbours is split like any hot key of a join.
    """
    links = cut(links)
    while True:
        # Each node's larger neighbours go to the least of its neighbours and itself,
        pairs = links.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u"))
        low = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u"))).groupBy("u").agg(F.min("v").alias("m"))
        large = cut(pairs.join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # then its smaller neighbours and itself go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        links = cut(large.join(low.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())
        inner = links.select("v").distinct().join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = links.groupBy("u").count().where("count > 1").select(F.col("u").alias("v"))
        if inner.union(twice).isEmpty():
            return links


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, keep_id, n_links, n): every document with words, the one of its group that stays, the number of other hashes near its own, and its number of rows."""
    sims = cut(hashes(docs, id_col, text_col).groupBy("id").agg(F.min("sim").alias("sim"), F.count("*").alias("n")))
    reps = cut(sims.where("sim IS NOT NULL").groupBy("sim").agg(F.min("id").alias("id")))
    found = cut(links(reps, reps.count(), radius, recall, hot_rows))
    top = roots(found.where("v IS NOT NULL").select("u", "v").distinct())
    counted = found.groupBy("u").agg(F.sum("n").alias("n_links"))
    rooted = reps.select("sim", F.col("id").alias("u")).join(top, "u", "left").join(counted, "u", "left").select("sim", F.coalesce("v", "u").alias("keep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return sims.join(rooted, "sim", "left").select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, keep_id, n_links): each document of a group of two or more, the id of its group that stays, and the number of other hashes near its own."""
    found = cut(members(docs, id_col, text_col, radius, recall, hot_rows))
    shared = found.where("id <> keep_id").select("keep_id").distinct()
    return found.join(shared, "keep_id", "left_semi").select(F.col("id").alias(id_col), "keep_id", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """The rows of docs without those of all but one document of each group."""
    found = cut(members(docs, id_col, text_col, radius, recall))
    gone = found.where("id <> keep_id").select("id")
    gone = gone.withColumnRenamed("id", "\x00id")
    kept = docs.join(gone, docs[f"`{id_col}`"] == F.col("`\x00id`"), "left_anti")
    again = found.where("n > 1 AND id = keep_id").select(F.col("id").alias("\x00id"))
    if again.isEmpty():
        return kept
    same = kept[f"`{id_col}`"] == F.col("`\x00id`")
    order = Window.partitionBy(col(id_col)).orderBy(col(text_col), F.to_json(F.struct(*map(col, docs.columns))))
    one = kept.join(again, same, "left_semi").withColumn("\x00n", F.row_number().over(order)).where("`\x00n` = 1").drop("\x00n")
    return kept.join(again, same, "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
