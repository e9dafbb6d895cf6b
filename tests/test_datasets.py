from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import measures
from affinis.operators import datasets as ds
from affinis.operators import stats
from affinis.sources import io


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokenisers(spark):
    t = F.lit("Ab c")
    assert first(spark, ds.qgrams(t, 2)) == ["#A", "Ab", "b ", " c", "c#"]
    assert first(spark, ds.qgrams(F.lit(""), 1)) == []
    assert first(spark, ds.shingles(ds.whitespace_tokens(F.lit("a b")), 2)) == ["# a", "a b", "b #"]
    assert first(spark, ds.shingles(ds.whitespace_tokens(F.lit("a b")), 1)) == ["a", "b"]
    assert first(spark, ds.alphanumeric_tokens(F.lit(" a-b,C1 "), upper=True)) == ["A", "B", "C1"]


def test_measures(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert first(spark, measures.dot(a, a)) == 25.0
    assert first(spark, measures.normalize(a)) == [0.6, 0.8]
    assert first(spark, measures.normalize(b)) is None
    x, y = F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(2), F.lit(3), F.lit(4))
    assert first(spark, measures.jaccard(x, y)) == 0.5
    assert first(spark, measures.different_bits(F.array(F.lit(7).cast("bigint")), F.array(F.lit(-1).cast("bigint")), 1)) == 61


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b")], "id bigint, text string")
    words = ds.whitespace_tokens(F.col("text"))
    got = {r.id: r.words for r in ds.encode_sets(df, "id", words).collect()}
    # By frequency, then token and occurrence: (a, 1), (a, 2), (c, 1), then (b, 1).
    assert got == {1: [1, 2, 4], 2: [3, 4], 3: [4]}
    known = ds.dictionary(ds.encode_multisets(df, "id", words, drop_repeats=True))
    other = spark.createDataFrame([(9, "b z")], "id bigint, text string")
    assert ds.foreign_encode(other, "id", words, known).first()["words"] == [0, 3]
    vocab = ds.top_vocabulary(df, "id", words, 2)
    assert [(r.token, r.code) for r in vocab.orderBy("code").collect()] == [("b", 0), ("a", 1)]
    assert {(r.id, tuple(r.words), r.universe) for r in ds.bag_of_words(df, "id", words, vocab).collect()} == {(1, (0, 1), 2), (2, (0,), 2), (3, (0,), 2)}


def test_sets(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [5])], "id bigint, words array<bigint>")
    assert {(r.id, r.size) for r in ds.dedup_sets(df).collect()} == {(1, 2), (3, 1)}
    mapping = spark.createDataFrame([(1, 10), (2, 3)], "token bigint, code bigint")
    assert {r.id: r.words for r in ds.remap_tokens(df, mapping).collect()} == {1: [3, 10], 2: [3, 10], 3: None}
    big = ds.inflate_sets(df.withColumn("universe", F.lit(2)), 3)
    assert {(r.id, tuple(r.words)) for r in big.where("id < 6").collect()} == {(3, (1, 2)), (4, (2, 3)), (5, (1, 2))}
    assert [r.words for r in ds.shuffle_by_length(df).collect()][0] == [5]
    edges = spark.createDataFrame([(1, 5), (1, 5), (1, 2), (2, None)], "k bigint, x bigint")
    assert {r.id: r.words for r in ds.adjacency(edges, "k", "x").collect()} == {1: [2, 5]}


def test_renumber_and_samples(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "old")
    rows = ds.renumber(df, ["old"]).orderBy("old").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert 350 < ds.sample_dataset(df, 500).count() < 650
    assert 350 < ds.hash_sample(df, "old", 0.3).count() < 650


def test_vectors(spark):
    v = ds.random_vectors(spark, 50, 8)
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in v.collect())
    big = ds.inflate_vectors(v, 2, 8).collect()
    assert len(big) == 100
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in big)
    f = ds.fourier_features(v, 8, 32).collect()
    assert all(abs(np.linalg.norm(r.v) - 1) < 1e-9 for r in f)
    assert ds.random_blobs(spark, 20, 3, 4).count() == 20
    assert ds.perturb_vectors(v).count() == 50
    s = ds.random_sets(spark, 50, 100, 6).collect()
    assert all(r.words == sorted(r.words) and max(r.words) < 100 for r in s)


def test_diversity(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 4.0), (4, 0.0), (5, float("inf"))], "id bigint, value double")
    w = {r.id: r.weight for r in ds.diversity_weights(d.where("value < 9")).collect()}
    assert w == pytest.approx({1: 0.125, 2: 0.125, 3: 0.75, 4: 0.0})
    assert ds.diversify_random(d.where("value < 9 AND value > 0"), 200).groupBy("id").count().count() == 3
    got = {(r.id, r["count"]) for r in ds.diversify_extreme(d, 1.0, 5, 3.0, 2).groupBy("id").count().collect()}
    assert got == {(1, 3), (2, 2), (3, 2)}


def test_difficulty(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    sim = np.minimum(x @ x.T, 1)
    got = {r.id: r.lid for r in stats.lid(df, [0.4]).collect()}
    for i in range(60):
        d = 1 - sim[i][sim[i] >= 0.4]
        d = d[d > 1e-15]
        if len(d):
            assert got[i] == pytest.approx(-1 / np.log(d / 0.6).mean(), rel=1e-3) or len(d) < 2 or 1 - sim[i, i] > 0
    ex = {r.id: r.expansion for r in stats.expansion(df, [0.4]).collect()}
    for i in range(60):
        s = np.sort(sim[i])[::-1]
        c, below = int((s >= 0.4).sum()), s[s < 0.4]
        assert ex[i] == pytest.approx(0.4 / below[min(2 * c, len(below) - 1)])
    assert stats.peek(df, [3]).count() == 60
    info = stats.dataset_info(df, "id", "v").first()
    assert (info.kind, info.n, info.least, info.largest) == ("cosine", 60, 4, 4)
    assert [stats.byte_size(n) for n in (12, 2048, 3 * 2**20, 2**31)] == ["12 bytes", "2.00 Kb", "3.00 Mb", "2.00 Gb"]


def test_text_and_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("w 3 4\nbad x\nlone\nz 0 1\n")
    rows = {r.row: r.v for r in io.from_text(spark, str(tmp_path / "v.txt"), "vector").collect()}
    assert rows == {0: [3.0, 4.0], 3: [0.0, 1.0]}
    assert io.from_text(spark, str(tmp_path / "v.txt"), "vector-normalized").where("row = 0").first()["v"] == pytest.approx([0.6, 0.8])
    (tmp_path / "s.txt").write_text("a 10 3 1\nb 10\n")
    s = io.from_text(spark, str(tmp_path / "s.txt"), "bag-of-words")
    assert [(r.universe, r.words) for r in s.collect()] == [(10, [1, 3])]
    assert io.content_type(s) == "bag-of-words"
    with pytest.raises(ValueError, match="content type"):
        io.from_text(spark, str(tmp_path / "s.txt"), "other")
    path = str(tmp_path / "out")
    io.write_dataset(spark.range(10).select(F.col("id").alias("old"), F.array(F.lit(1.5)).alias("v"), F.lit(0).alias("id")), path, 3, ["old"])
    back = io.read_dataset(spark, path)
    assert (io.num_elements(back), io.num_chunks(back), io.content_type(back)) == (10, 3, "vector")
    assert all(r.id == r.old for r in back.collect())
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in x))
    assert [r.v for r in io.read_fvecs(spark, str(tmp_path / "x.fvecs")).orderBy("row").collect()] == x.tolist()
