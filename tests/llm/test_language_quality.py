from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from affinis.llm import language_id, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    model = language_id.train(half)
    rest = docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang").toPandas()
    got, p, kept = language_id.judge(model, pa.array(rest["text"]))
    assert np.mean(np.array(got) == rest["lang"].to_numpy()) > 0.97
    assert kept.mean() > 0.98
    assert all(0 <= x <= 1 for x in p)


def test_windows_cover_whole_texts():
    texts = ["", "a", "b" * 256, "c" * 257, "d" * 1000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    begin, end, n = language_id.cut_windows(data, off)
    assert n.tolist() == [0, 1, 1, 2, 4]
    for i in range(len(texts)):
        seen = set()
        for k in range(n[:i].sum(), n[: i + 1].sum()):
            assert off[i] <= begin[k] < end[k] <= off[i + 1]
            seen |= set(range(begin[k], end[k]))
        assert seen == set(range(off[i], off[i + 1]))
        # Every run of bytes as wide as the widest filter lies within a window.
        assert all(any(begin[k] <= at and at + 4 <= end[k] for k in range(n[:i].sum(), n[: i + 1].sum())) for at in range(off[i], off[i + 1] - 3))


def test_training_reads_whole_texts():
    texts = [bytes(np.random.default_rng(k).integers(97, 123, size).astype(np.uint8)) for k, size in enumerate((5, 256, 700, 4000))]
    x, y = language_id.training_windows(texts, np.array([0, 1, 0, 2]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, end, n = language_id.cut_windows(data, np.cumsum([0, *map(len, texts)]))
    assert (x[: len(begin)] == language_id.gather(data, begin, end)).all()
    assert y[: len(begin)].tolist() == np.repeat([0, 1, 0, 2], n).tolist()
    assert len(x) == len(y) == len(begin) + -(-len(begin) // 2)


def test_network_equals_plain_convolution():
    model = language_id.ByteCNN(["a", "b", "c"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (70, language_id.WINDOW)).astype(np.uint8)
    pooled = []
    for w in language_id.WIDTHS:
        t, last = model.params[f"w{w}"], language_id.WINDOW - w + 1
        pooled.append(sum(t[o][x[:, o : o + last]] for o in range(w)).max(1))
    h = np.maximum(np.concatenate(pooled, 1) + model.params["b"], 0)
    np.testing.assert_allclose(model.probabilities(x), language_id.softmax(h @ model.params["v"] + model.params["c"]), rtol=1e-4)


ROWS = [(1, "the thing of and the end", "en"), (1, "the thing of and the end", "en"), (2, None, "en"), (3, "", "de"), (4, "  \n", None), (5, "12 34", "xx"), (None, "und der die", "de"), (6, "und das " * 30000, None)]
SCHEMA = "doc_id bigint, text string, lang string, kept boolean, language string, reason string"


def odd(spark):
    return spark.createDataFrame([(*r, True, "l", "r") for r in ROWS], SCHEMA)


def test_language_odd_rows(spark):
    df = odd(spark)
    model = language_id.train(df)
    got = language_id.identify(df, model).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id for r in got if r.language == "und"} == {2, 3, 4, 5}
    assert all(r.kept == (r.language != "und" and r.probability >= language_id.MIN_PROBABILITY) for r in got)
    out = language_id.keep_identified(df, model)
    assert out.columns == df.columns
    assert out.count() == sum(r.kept for r in got)
    named = {(r.doc_id, r.text): r.lang for r in language_id.keep_identified(df, model, lang_col="lang").collect()}
    assert named[1, ROWS[0][1]] == "en"
    assert named[6, ROWS[-1][1]] in ("de", "en", "xx")
    blank = df.withColumn("lang", F.lit(" "))
    found = {r.doc_id: r.language for r in got}
    assert all(r.lang == found[r.doc_id] for r in language_id.keep_identified(blank, model, lang_col="lang").collect())
    empty = df.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r.language for r in language_id.identify(df, language_id.train(empty)).collect()} == {"und"}


def test_quality_follows_labels():
    docs = pq.read_table(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    _, reason = quality.judge(docs["text"].combine_chunks(), docs["lang"].combine_chunks())
    good = [r for d, r in zip(docs["doc_id"].to_pylist(), reason, strict=True) if labels.get(d) == 1]
    bad = [r for d, r in zip(docs["doc_id"].to_pylist(), reason, strict=True) if labels.get(d) == 0]
    assert np.mean([r != "" for r in good]) < 0.005
    assert np.mean([r != "" for r in bad]) > 0.85


def test_measures_equal_whole_text_tokenising():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "straße", "it's", "日本", "😀", "a1b2", "don't"]) for _ in range(n)) for n in (1, 5, 200)]
    m = quality.measure(pa.array(texts))
    model, is_byte = quality.piece_vocabulary(quality.PIECES)
    bpe, _ = quality.byte_vocabulary(quality.BYTES)
    for i, t in enumerate(texts):
        ids = model.encode(t)
        counts = np.unique(ids, return_counts=True)[1] / len(ids)
        chars = len(t.replace(" ", ""))
        assert m["n_tokens"][i] == len(ids)
        assert np.isclose(m["byte_share"][i], is_byte[ids].mean())
        assert np.isclose(m["entropy"][i], -(counts * np.log2(counts)).sum())
        assert np.isclose(m["bpe_chars_per_token"][i], chars / len(bpe.encode_ordinary(" " + t)))


def test_quality_odd_rows(spark):
    df = odd(spark)
    got = {(r.doc_id, r.reason) for r in quality.score(df).collect()}
    assert {(2, "empty"), (3, "empty"), (4, "empty"), (6, "evenness")} <= got
    assert quality.score(df).count() == len(ROWS)
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert not {r.doc_id for r in out.collect()} & {2, 3, 4, 6}
    assert quality.keep_good(df.limit(0)).count() == 0
    assert quality.script("αβγ") == "GREEK"
    assert quality.script("") == "OTHER"


def test_training_sample_skips_empty_texts_before_ranking(spark):
    df = spark.createDataFrame([(i, "" if i % 2 else None if i % 3 else "some text", "en") for i in range(60)], "doc_id bigint, text string, lang string")
    assert language_id.training_sample(df, 8).count() == 8
