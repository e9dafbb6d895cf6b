from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa

import __spark_entry__
from affinis.llm import language_id, packing, quality, simhash

SF = "/root/testdata/sf0.001"


def plain_languages(docs, model):
    """Text by text and window by window."""
    out = {}
    for d, text, lang in docs:
        data = (text or "").encode()
        windows = [data[k : k + 256] for k in range(0, max(1, len(data) - 3), 253)]
        windows = [w if len(w) == 256 or len(data) < 256 else data[-256:] for w in windows]
        if data and any(c.isalpha() for c in text):
            x = np.stack([np.frombuffer(w.ljust(256, b"\0"), np.uint8) for w in windows])
            if model.probabilities(x).mean(0).max() >= language_id.MIN_PROBABILITY:
                out[d] = (text, lang)
    return out


def plain_groups(docs):
    """The least id of the group of each text, by the distances of all pairs."""
    ids, hashes = [], []
    for d, text in sorted(docs.items()):
        words = {w.lower().strip(simhash.PUNCTUATION) for w in text.split()} - {""}
        if words:
            raw = [w.encode() for w in sorted(words)]
            bits = np.unpackbits(simhash.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])), axis=1)
            ids.append(d)
            hashes.append(2 * bits.sum(0, dtype=int) > len(words))
    least = dict(zip(ids, ids, strict=True))
    x = np.array(hashes)
    near = (x[:, None] != x[None]).sum(2) <= simhash.RADIUS
    for _ in ids:
        new = {d: min(least[ids[j]] for j in np.flatnonzero(near[i])) for i, d in enumerate(ids)}
        if new == least:
            break
        least = new
    return least


def plain_repeats(docs, length=50):
    """The words left when each place of a run that has a lesser (id, place) is taken out."""
    seen, gone = set(), {}
    for d, text in sorted(docs.items()):
        words = text.split()
        for i in range(len(words) - length + 1):
            run = tuple(words[i : i + length])
            if run in seen:
                gone.setdefault(d, set()).update(range(i, i + length))
            seen.add(run)
    left = {d: [w for i, w in enumerate(text.split()) if i not in gone.get(d, ())] for d, text in docs.items()}
    return {d: w for d, w in left.items() if w or d not in gone}


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = language_id.train(docs)

    def after(k):
        name, stage = corpus_pipeline.STAGES[k]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns == columns or k == 4
        return out

    docs = after(0)
    want = plain_languages(texts, model)
    assert {r.doc_id: (r.text, r.lang) for r in docs.collect()} == want
    docs = after(1)
    # One text at a time, so that nothing depends on its neighbours in a batch.
    want = {d: t for d, (t, lang) in want.items() if quality.judge(pa.array([t]), pa.array([lang]))[1][0] == ""}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == want
    docs = after(2)
    least, kept = plain_groups(want), {r.doc_id: r.text for r in docs.collect()}
    must = {d for d in want if least.get(d, d) == d}
    assert must <= set(kept)  # no document goes without a near one of a lesser id
    assert len(set(kept) - must) <= 0.02 * len(want) < len(want) - len(kept)
    docs = after(3)
    want = plain_repeats(kept)
    got = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text.split() for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in got.items() if r.text != kept[d])
    last = after(4).collect()
    bins, pieces = {}, {}
    for r in last:
        bins.setdefault(r.bin_id, []).append((r.offset, r.n_words))
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_words))
    for held in (*bins.values(), *pieces.values()):
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(w) for d, w in want.items() if w}
    assert max(sum(n for _, n in b) for b in bins.values()) <= packing.CAPACITY
    # Best fit decreasing, piece by piece, is what the plan is to match.
    room = []
    for n in sorted((n for p in pieces.values() for _, n in p), reverse=True):
        fits = [i for i, free in enumerate(room) if free >= n]
        at = min(fits, key=lambda i: room[i]) if fits else len(room)
        room[at:at + 1] = [(room[at] if fits else packing.CAPACITY) - n]
    assert len(bins) <= len(room)
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_words").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.piece, r.n_words) for r in last)


def test_stages_take_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, sim string, size int, u int"
    rows = [(1, None, None, None, None, "i", "s", 1, 1), (None, "", "en", "s", 0, "i", "s", 1, 1), (2, "the of and " * 3, "en", "s", 33, None, None, None, None), (2, "the of and " * 3, "en", "s", 33, None, None, None, None)]
    for some in (rows, []):
        df = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns


def test_registered():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1
    assert "pipeline" in found
