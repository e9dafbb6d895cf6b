from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from affinis.llm import suffix_dedup as sd


def test_multikey_quicksort_finds_equal_runs():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 3, 4000).astype(np.uint32)
    start = rng.permutation(3990)[:2500]
    which, group = sd.equal_runs(flat, start, 7)
    want = defaultdict(set)
    for i, s in enumerate(start.tolist()):
        want[tuple(flat[s : s + 7].tolist())].add(i)
    got = defaultdict(set)
    for i, g in zip(which.tolist(), group.tolist(), strict=True):
        got[g].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute(docs, length):
    places = defaultdict(set)
    for d, text in docs:
        if d is not None and text:
            w = text.split()
            for i in range(len(w) - length + 1):
                places[tuple(w[i : i + length])].add((d, i))
    out = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for n, (d, i) in enumerate(sorted(found)):
                out[d, n > 0] |= set(range(i, i + length))
    return out


def corpus():
    rnd = random.Random(4)
    word = lambda: "w" + str(rnd.randrange(500))
    passages = [[word() for _ in range(rnd.choice((49, 50, 51, 80, 200)))] for _ in range(12)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p if rnd.random() < 0.7 else p[rnd.randrange(10) :]
        docs.append((d, " ".join(w)))
    return [*docs, (60, docs[0][1]), (61, "tick tock " * 90), (62, "tick tock " * 70), (63, None), (64, ""), (65, "short"), (None, docs[1][1]), (66, "z " * 400), (5, docs[5][1])]


def test_repeated_rows_of_any_batches():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 300, 500)
    parts = np.split(np.arange(500), sorted(rng.integers(0, 500, 6).tolist()))
    rows = []
    for part in parts:
        sure, again = sd.seen_here(h[part])
        rows += [(int(h[i]), int(i), 0, 0, bool(s), bool(a)) for i, s, a in zip(part, sure, again, strict=True)]
    rows.sort(key=lambda r: rng.integers(0, 300) if r[5] else r[0])
    for size in (1, 2, 7, 500):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("h", "id", "lead", "tie", "sure", "again"), r, strict=True)) for r in rows[k : k + size]]) for k in range(0, 500, size)]
        got = [i for b in sd.repeated(iter(batches)) for i in b.column(1).to_pylist()]
        assert sorted(got) == [i for i in range(500) if (h == h[i]).sum() > 1]


def test_spans_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id bigint, text string, h string, lead int, id int")
    for length, gram, bucket_rows in ((50, 26, 65536), (12, 5, 65536), (50, 26, 9), (12, 5, 40)):
        got = defaultdict(set)
        for r in sd.spans(df, length=length, gram=gram, bucket_rows=bucket_rows).collect():
            assert not got[r.id, r.later] & set(range(r.start, r.end))
            assert r.n_words == r.end - r.start
            got[r.id, r.later] |= set(range(r.start, r.end))
        assert got == brute(docs, length)
    assert sd.spans(df.limit(0)).count() == 0


def test_equal_run_on_every_boundary(spark):
    """One passage in two thirds of the documents, with buckets of a few anchors: all of its runs cross boundaries."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    docs = [(f"d{d:03}", " ".join([f"a{rnd.randrange(9999)}" for _ in range(30)] + (passage if d % 3 else [f"b{d}.{i}" for i in range(60)]))) for d in range(90)]
    docs += [("d200", docs[0][1]), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    for bucket_rows in (2, 5, 17):
        got = defaultdict(set)
        for r in sd.spans(df, bucket_rows=bucket_rows).collect():
            got[r.id, r.later] |= set(range(r.start, r.end))
        assert got == brute(docs, 50)


def test_buckets():
    rng = np.random.default_rng(1)
    keys = np.sort(np.rec.fromarrays([rng.integers(0, 4, 60), rng.integers(0, 50, 60)], names=["lead", "tie"]))
    lead, ties = rng.integers(-1, 6, 500), rng.integers(0, 50, 500)
    want = [sum((a, b) <= (x, y) for a, b in keys.tolist()) for x, y in zip(lead.tolist(), ties.tolist(), strict=True)]
    assert sd.bucket_of({"lead": keys["lead"], "tie": keys["tie"]}, lead, ties).tolist() == want


def test_drop_repeats(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, len(t or ""), "x") for d, t in docs], "doc_id bigint, text string, n_chars bigint, id string")
    gone = brute(docs, 50)
    want = []
    for d, t in docs:
        if t is None or d is None or not gone.get((d, True)):
            want.append((d, t))
        else:
            left = [w for i, w in enumerate(t.split()) if i not in gone[d, True]]
            if left:
                want.append((d, " ".join(left)))
    out = sd.drop_repeats(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert sorted(((r.doc_id, None if r.text is None else " ".join(r.text.split())) for r in rows), key=str) == sorted(((d, None if t is None else " ".join(t.split())) for d, t in want), key=str)
    assert sd.drop_repeats(df.limit(0)).count() == 0


def test_cut_words():
    assert sd.cut_words("a  b\nc d", [(1, 3)]) == "a d"
    assert sd.cut_words(" a b c", [(0, 1), (2, 3)]) == "b"
    assert sd.cut_words("a b", [(0, 2)]) == ""
    assert sd.cut_words("a\nb\nc d\ne", [(2, 4)]) == "a\nb e"
