"""Passages of at least LENGTH words that repeat, found by sorting suffixes.

A passage repeats where the same LENGTH words (separated by white space, compared as they are) start at
two places of the corpus. Only suffixes that can be part of one are sorted: every run of LENGTH words has
one anchor, the leftmost of its GRAM-word runs with the least hash, and equal runs have equal anchors, so a run whose anchor's
hash occurs once in the corpus cannot repeat. The suffixes of the remaining anchors are
range-partitioned by their anchors' leading tokens and, among equal ones, by a hash of document and place. The splitters are
quantiles of a sample of these keys; because they may fall between equal leading tokens, a popular passage is the work of as many tasks
as it is long. Each bucket sorts its suffixes with multikey quicksort, level by level over numpy arrays, down to
LENGTH tokens. Runs of the leading tokens that a bucket begins or ends with may go on beyond the boundary: of
each of their local groups the least occurrence is compared, token by token, with those of the other buckets.

The occurrence with the least (id, place) is the first; the others are later ones.

Defined cases: null, empty and short texts (under LENGTH words) have no passage; rows with a null
id take no part and stay as they are; ids may be numbers or strings; rows that repeat an id are occurrences at the same places, which count
once; passages may overlap and may repeat within one document; texts are read whole, however long; an
empty table gives an empty result; other columns are carried through by the filter and not read
otherwise, except that ``n_chars``, if there, is set for texts that lose words. A document whose words all go is dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.bpe import byte_hash, mix
from affinis.llm.common import col, cut, slices, table, utf8

LENGTH, GRAM = 50, 26
#: Anchors of a bucket, on average, and keys that are sampled for each.
BUCKET_ROWS, SAMPLE = 65536, 16
#: Beyond this number buckets grow instead; it bounds the sample of keys, which affects the buckets' sizes only.
MOST_BUCKETS = 1 << 17
BASE = 0x9E3779B97F4A7C15


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the n + 1 offsets of the texts' words."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text.fill_null("").cast(pa.large_string())))
    words = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(text) + 1, np.int64)
    h = byte_hash(*utf8(words.dictionary), 1 << 30)
    return h[words.indices.to_numpy(zero_copy_only=False)], offsets.astype(np.int64)


def grams(t: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size tokens, by doubling."""
    n = len(t) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, have = [t], 1
    while 2 * have <= size:
        h = power[-1]
        power.append(h[: len(h) - have] * np.uint64(pow(BASE, have, 1 << 64)) + h[have:])
        have *= 2
    out, at = np.zeros(n, np.uint64), 0
    for k in reversed(range(len(power))):
        if size >> k & 1:
            out = out * np.uint64(pow(BASE, 1 << k, 1 << 64)) + power[k][at : at + n]
            at += 1 << k
    return mix(out)


def anchors(t: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, first, last): each anchor with the range of run starts that it stands for."""
    h = grams(t, gram)
    window = length - gram + 1
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none, none
    best, have = np.arange(len(h)), 1
    left = lambda a, b: np.where(h[b] < h[a], b, a)
    while 2 * have <= window:
        best = left(best[: len(best) - have], best[have:])
        have *= 2
    best = left(best[:n], best[window - have : window - have + n])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(offsets[text + 1] - np.arange(n) >= length)
    if not len(start):
        return none, none, np.zeros(0, np.uint64), none, none
    at, text = best[start], text[start]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    end = np.append(new[1:], len(at)) - 1
    at, first, last, text = at[new], start[new], start[end], text[new]
    base = offsets[text]
    return text, at - base, h[at], first - base, last - base


def equal_runs(flat: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at start, down to length tokens: those that are equal to another, and their groups.

    Each round splits every open segment at once by the token pair at its depth, below, at and above
    a pivot from its middle; the middle part goes one pair deeper.
    """
    deep = -(-length // 2)
    order, seg = np.arange(len(start)), np.zeros(len(start), np.int64)
    depth = np.zeros(1, np.int64)
    done, group, groups = [], [], 0
    while len(order):
        size = np.bincount(seg, minlength=len(depth))
        head = np.cumsum(size) - size
        full = (depth == deep) & (size > 1)
        if full.any():
            out = full[seg]
            done.append(order[out])
            group.append((np.cumsum(full) - 1 + groups)[seg[out]])
            groups += int(full.sum())
        keep = (size > 1) & (depth < deep)
        if not keep.all():
            on = keep[seg]
            order, seg = order[on], (np.cumsum(keep) - 1)[seg[on]]
            size, depth = size[keep], depth[keep]
            head = np.cumsum(size) - size
            if not len(order):
                break
        at = start[order] + 2 * depth[seg]
        key = flat[at].astype(np.uint64) << np.uint64(32)
        second = 2 * depth[seg] + 1 < length
        key |= np.where(second, flat[np.minimum(at + 1, len(flat) - 1)], 0).astype(np.uint64)
        pivot = key[head + size // 2][seg]
        part = (key > pivot) * 2 + (key == pivot)
        count = np.bincount(seg * 3 + part, minlength=3 * len(size))
        base = np.cumsum(count) - count
        to = np.empty(len(order), np.int64)
        for p in range(3):
            m = np.flatnonzero(part == p)
            s = seg[m] * 3 + p
            before = np.cumsum(np.append(0, count[p::3]))[:-1]
            to[m] = base[s] + np.arange(len(m)) - before[seg[m]]
        moved = np.empty_like(order)
        moved[to] = order
        order = moved
        live = count > 0
        new_id = np.cumsum(live) - 1
        seg = np.repeat(new_id[live], count[live])
        depth = (np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth)))[live]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(done), np.concatenate(group)) if done else (empty, empty)


def leading(short: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two tokens at each place as one number."""
    return (short[at].astype(np.int64) << 31) ^ (short[at + 1].astype(np.int64) >> 1)


def tie(salt: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What orders suffixes with equal leading tokens among the buckets."""
    return (mix(salt.view(np.uint64) + at.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(33)).astype(np.int64)


def bucket_of(splitters: np.ndarray, lead: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The number of splitters, sorted (lead, tie) pairs, that are not above each key."""
    low, high = np.searchsorted(splitters["lead"], lead, "left"), np.searchsorted(splitters["lead"], lead, "right")
    out = low.copy()
    split = np.flatnonzero(low < high)
    split = split[np.argsort(low[split], kind="stable")]
    for rows in np.split(split, np.flatnonzero(np.diff(low[split])) + 1) if len(split) else []:  # those of one splitter's leading tokens
        lo, hi = low[rows[0]], high[rows[0]]
        out[rows] = lo + np.searchsorted(splitters["tie"][lo:hi], ties[rows], "right")
    return out


def rows_of_groups(group: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sorts groups of occurrences by (group, doc, place) and leaves out repeated ones; the rows that stay, in order."""
    order = np.lexsort((place, doc, group))
    g, d, p = group[order], doc[order], place[order]
    return order[np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1]))[: len(order)]]


def solve_bucket(bucket: pa.Table, length: int, whole: bool = False) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Of one bucket: (id, first, last, later), what it can tell alone, and (run, id, place, alone), what needs the other buckets.

    bucket: (lead, id, first, context). whole: there are no other buckets.
    """
    raw, off = utf8(bucket["context"])
    flat, off = raw.view(np.uint32) if raw.flags.aligned else np.frombuffer(raw.tobytes(), np.uint32), off // 4
    ids, first, lead = bucket["id"].combine_chunks(), bucket["first"].to_numpy().astype(np.int64), bucket["lead"].to_numpy()
    known, code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    n = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[row] + step
    doc, place = code[row], first[row] + step
    which, group = equal_runs(flat, start, length)
    lonely = np.ones(len(row), bool)
    lonely[which] = False
    edge = np.zeros(len(row), bool) if whole else ((lead == lead.min()) | (lead == lead.max()))[row]
    stay = rows_of_groups(group, doc[which], place[which])
    which, group = which[stay], group[stay]
    head = np.append(True, group[1:] != group[:-1])[: len(group)]
    alone = head & np.append(head[1:], True)[: len(group)]
    # Of a group at the edge all but the least occurrence are later ones whatever the other buckets hold.
    at_edge = edge[which]
    least, lonely = which[at_edge & head], np.flatnonzero(lonely & edge)
    open_ = np.append(least, lonely)
    single = np.append(alone[at_edge & head], np.ones(len(lonely), bool))
    body = flat[(start[open_][:, None] + np.arange(length)).ravel()]
    runs = pa.Array.from_buffers(pa.binary(), len(open_), [None, pa.py_buffer((np.arange(len(open_) + 1) * 4 * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
    names = pa.array(known, ids.type)
    asked = pa.RecordBatch.from_arrays([runs, names.take(pa.array(doc[open_])), pa.array(place[open_]), pa.array(single)], names=["run", "id", "place", "alone"])
    told = ~alone & ~(at_edge & head)
    which, later = which[told], ~head[told]
    doc, place = doc[which], place[which]
    order = np.lexsort((place, later, doc))
    doc, place, later = doc[order], place[order], later[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (later[1:] != later[:-1]) | (place[1:] > place[:-1] + 1))[: len(doc)]
    at = np.flatnonzero(new)
    last = place[np.append(at[1:], len(place)) - 1] if len(at) else place
    return pa.RecordBatch.from_arrays([names.take(pa.array(doc[at])), pa.array(place[at]), pa.array(last), pa.array(later[at])], names=["id", "first", "last", "later"]), asked


def seen_here(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur more than once, and which of their places are not the first."""
    _, first, at, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    sure = count[at] > 1
    return sure, sure & (first[at] != np.arange(len(h)))


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, id, lead, tie) of the rows whose h occurs more than once, among those that aren't ``again`` or by ``sure``. Rows come sorted by h, but for those that are ``again``; only one is held."""
    held, last = None, None
    for batch in batches:
        again = batch.column(5).to_numpy(zero_copy_only=False)
        if again.any():
            yield batch.filter(pa.array(again)).select([0, 1, 2, 3])
            batch = batch.filter(pa.array(~again))
        if not batch.num_rows:
            continue
        h, sure = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
        before = np.append(h[0] == last, h[1:] == h[:-1])
        if held is not None and before[0]:
            yield held
        keep = before | np.append(before[1:], False) | sure
        yield batch.filter(pa.array(keep)).select([0, 1, 2, 3])
        last, held = h[-1], None if keep[-1] else batch.slice(batch.num_rows - 1).select([0, 1, 2, 3])


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, first, last, later): ranges of the places where repeated runs of length words start; later: not the first occurrence."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), F.xxhash64(col(id_col)).alias("salt")).where("id IS NOT NULL AND text IS NOT NULL")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                t, offsets = tokens(batch.column(1))
                text, at, h, _, _ = anchors(t, offsets, length, gram)
                salt = batch.column(2).to_numpy()[text]
                lead, ties = leading((t >> np.uint64(32)).astype(np.uint32), offsets[text] + at), tie(salt, at)
                sure, again = seen_here(h)
                h = h.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(again, mix((salt + at).view(np.uint64)).view(np.int64), h)), pa.array(h), batch.column(0).take(pa.array(text)), pa.array(lead), pa.array(ties), pa.array(sure), pa.array(again)], names=["route", *names, "sure", "again"])

    names = ["h", "id", "lead", "tie"]
    schema = f"h bigint, id {kind}, lead bigint, tie bigint"
    # Of an anchor that a batch has several times one row decides with those of other batches, so that a popular one is no task's work.
    anchored = rows.mapInArrow(find, f"route bigint, {schema}, sure boolean, again boolean")
    shared = cut(anchored.repartition("route").sortWithinPartitions("route").select(*names, "sure", "again").mapInArrow(repeated, schema))
    total = shared.count()
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_rows)))
    # About SAMPLE keys a bucket.
    sample = shared.where(F.pmod(F.xxhash64("tie", "lead", "h"), F.lit(max(1, total // (SAMPLE * buckets)))) == 0).select("lead", "tie").orderBy("lead", "tie").toArrow() if buckets > 1 else None
    edges = np.unique(np.arange(1, buckets) * len(sample) // buckets) if sample else np.zeros(0, np.int64)
    splitters = {name: sample[name].to_numpy()[edges] if sample else np.zeros(0, np.int64) for name in ("lead", "tie")}

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                t, offsets = tokens(batch.column(1))
                text, at, h, first, last = anchors(t, offsets, length, gram)
                wanted = batch.column(3)
                edges = np.cumsum(np.append(0, pc.list_value_length(wanted).to_numpy(zero_copy_only=False)))
                owner = np.repeat(np.arange(len(wanted)), np.diff(edges))
                list_h = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                key = lambda o, x: mix(x + o.astype(np.uint64) * np.uint64(BASE))
                keep = np.flatnonzero(np.isin(key(text, h), key(owner, list_h)))
                text, at, first, last = text[keep], at[keep], first[keep], last[keep]
                short = (t >> np.uint64(32)).astype(np.uint32)
                base = offsets[text]
                lead = leading(short, base + at)
                bucket = bucket_of(splitters, lead, tie(batch.column(2).to_numpy()[text], at))
                size = last - first + length
                cum = np.cumsum(np.append(0, size))
                body = short[np.repeat(base + first - cum[:-1], size) + np.arange(cum[-1])]
                context = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cum * 4).astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(lead), batch.column(0).take(pa.array(text)), pa.array(first.astype(np.int32)), context], names=["bucket", "lead", "id", "first", "context"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        told, asked = solve_bucket(pa.Table.from_batches(got), length, buckets == 1)
        empty = lambda n, *types: [pa.nulls(n, x) for x in types]
        names = ["id", "first", "last", "later", "run", "alone"]
        yield pa.RecordBatch.from_arrays([*told.columns, *empty(len(told), pa.binary(), pa.bool_())], names=names)
        yield pa.RecordBatch.from_arrays([asked.column(1), asked.column(2), *empty(len(asked), pa.int64(), pa.bool_()), asked.column(0), asked.column(3)], names=names)

    wanted = shared.groupBy("id").agg(F.collect_set("h").alias("hashes"))
    chosen = rows.join(wanted, "id").select("id", "text", "salt", "hashes").mapInArrow(suffixes, f"bucket int, lead bigint, id {kind}, first int, context binary")
    solved = chosen.repartitionById(buckets, "bucket").mapInArrow(sort, f"id {kind}, first bigint, last bigint, later boolean, run binary, alone boolean")
    if buckets == 1:
        return solved.select("id", "first", "last", "later")
    solved = cut(solved)
    # Few rows: a bucket has at most one of each run at its edges.
    run = Window.partitionBy("run")
    met = solved.where("run IS NOT NULL").groupBy("run", "id", "first").agg(F.min("alone").alias("alone"))
    met = met.withColumn("n", F.count("*").over(run)).withColumn("rank", F.row_number().over(run.orderBy("id", "first"))).where("n > 1 OR NOT alone")
    return solved.where("run IS NULL").select("id", "first", "last", "later").unionByName(met.select("id", "first", F.col("first").alias("last"), (F.col("rank") > 1).alias("later")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, start, end, n_words, later): the words (from start, before end) of each document in repeated passages; first and later occurrences apart."""
    found = occurrences(docs, id_col, text_col, length, gram, bucket_rows).select("id", "later", "first", (F.col("last") + length).alias("end"))
    at = Window.partitionBy("id", "later").orderBy("first", "end")
    before = F.max("end").over(at.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce((F.col("first") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("id", "later", "island").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    return merged.select("id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "later")


def cut_words(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of these sorted, disjoint spans; line breaks and spacing elsewhere stay."""
    out, at, k = [], 0, 0
    places = iter(_words(text))
    for start, end in gone:
        first = next(itertools.islice(places, start - k, None))
        last = next(itertools.islice(places, end - start - 2, None)) if end - start > 1 else first
        k = end
        out.append(text[at : first[0]])
        at = last[1]
    out.append(text[at:])
    kept = [p.strip() for p in out]
    return " ".join(p for p in kept if p)


def _words(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for word in text.split():
        at = text.index(word, at)
        yield at, at + len(word)
        at += len(word)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs without the words of later occurrences; documents left without a word are dropped."""
    later = spans(docs, id_col, text_col, length, gram, bucket_rows).where("later").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("\x00gone"))
    later = later.withColumnRenamed("id", "\x00id")
    at = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    width = len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(width)]
            gone = batch.column(width)
            hit = pc.is_valid(gone).to_numpy(zero_copy_only=False)
            if hit.any():
                text, spans_ = columns[at].to_pylist(), gone.to_pylist()
                for i in np.flatnonzero(hit).tolist():
                    text[i] = cut_words(text[i], [(s["start"], s["end"]) for s in spans_[i]])
                columns[at] = pa.array(text, columns[at].type)
                if chars is not None:
                    n = columns[chars].to_pylist()
                    for i in np.flatnonzero(hit).tolist():
                        n[i] = len(text[i])
                    columns[chars] = pa.array(n, columns[chars].type)
                stays = np.array([not h or text[i] != "" for i, h in enumerate(hit.tolist())])
                yield pa.RecordBatch.from_arrays(columns, names=docs_names).filter(pa.array(stays))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    joined = docs.join(later, docs[f"`{id_col}`"] == F.col("`\x00id`"), "left").drop("\x00id")
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
