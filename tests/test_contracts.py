"""Odd input of the joins, hot buckets, and difficulty measures with a base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.functions.families import bitmaps, pack_pool, unpack_pool
from affinis.operators import selfjoin, stats
from affinis.operators.selfjoin import similarity_self_join

ALGORITHMS = ("cartesian", "local-lsh", "one-level-lsh", "two-level-lsh")


def pairs(df):
    rows = df.collect()
    out = {(r.id_l, r.id_r) for r in rows}
    assert len(out) == len(rows)
    assert all(a < b for a, b in out)
    return out


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_repeated_ids_and_mixed_dimensions(spark, algorithm):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []), (7, None), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    assert pairs(similarity_self_join(df, "id", "v", 0.9, algorithm, k=2, k2=2, recall=0.99)) == {(1, 2)}


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_sets_of_strings_with_ids_of_strings(spark, algorithm):
    words = [f"w{i}" for i in range(40)]
    rows = [("b", words), ("a", [*words[:38], "x", None]), ("c", ["other"] * 3), ("d", ["other"]), ("e", [])]
    df = spark.createDataFrame(rows, "id string, v array<string>")
    got = {(r.id_l, r.id_r): r.similarity for r in similarity_self_join(df, "id", "v", 0.8, algorithm, k=4, k2=2, recall=0.99).collect()}
    assert got == pytest.approx({("a", "b"): 38 / 41, ("c", "d"): 1.0})


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [30.0, 40.0]), (3, [0.0, 0.0]), (4, [4.0, -3.0])], "id bigint, v array<double>")
    assert [(r.id_l, r.id_r, round(r.similarity, 9)) for r in similarity_self_join(df, "id", "v", 0.9, unit=True).collect()] == [(1, 2, 1.0)]


def test_dry_run_needs_candidates(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>")
    with pytest.raises(ValueError, match="dry run"):
        similarity_self_join(df, "id", "v", 0.9, "cartesian", dry_run=True)


@pytest.mark.parametrize("bits", [0, 64])
def test_one_bucket_with_half_of_the_rows(spark, bits):
    """Half of the vectors are nearly the same, so that each repetition has a bucket with half of the rows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((160, 8))
    x[::2] = x[0] + 0.05 * rng.standard_normal((80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    for algorithm in ("one-level-lsh", "two-level-lsh"):
        options = {"k": 4, "k2": 3, "sketch_bits": bits}
        whole = pairs(similarity_self_join(df, "id", "v", 0.8, algorithm, **options))
        assert whole == pairs(similarity_self_join(df, "id", "v", 0.8, algorithm, hot_rows=9, **options))
        assert len(whole) > 2500
    assert pairs(similarity_self_join(df, "id", "v", 0.8, "one-level-lsh", k=4, sketch_bits=bits)) == pairs(similarity_self_join(df, "id", "v", 0.8, "local-lsh", k=4, sketch_bits=bits, groups=3))


def test_bitmaps_never_rule_out_a_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200))) for _ in range(120)]
    arr = pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))
    for words in (1, 2, 16):
        b = bitmaps(arr, words).view(np.uint64)
        for i in range(0, 120, 5):
            for j in range(120):
                differ = int(np.bitwise_count(b[i] ^ b[j]).sum())
                apart = len(np.setxor1d(sets[i], sets[j]))
                assert differ <= apart
                sim = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
                assert apart <= selfjoin.apart_most(np.array(len(sets[i])), np.array(len(sets[j])), sim)


def test_pools_and_bucket_pairs():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 15, (50, 7))
    assert (unpack_pool(pack_pool(pool), 7) == pool).all()
    a, b = rng.integers(0, 9, 70), rng.integers(0, 9, 60)
    for most in (1, 17, 10**6):
        got = [(i, j) for x, y in selfjoin.bucket_pairs(a, b, False, most) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in range(70) for j in range(60) if a[i] == b[j]]
        own = [(i, j) for x, y in selfjoin.bucket_pairs(a, a, True, most) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(own) == [(i, j) for i in range(70) for j in range(i + 1, 70) if a[i] == a[j]]


def test_sequential_counts_what_the_exact_join_finds(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    assert selfjoin.sequential(df, "id", "v", 0.5) == similarity_self_join(df, "id", "v", 0.5).count() > 0
    sets = spark.createDataFrame([(i, np.unique(rng.integers(0, 12, 8)).tolist()) for i in range(60)], "id bigint, v array<bigint>")
    assert selfjoin.sequential(sets, "id", "v", 0.5) == similarity_self_join(sets, "id", "v", 0.5, groups=3).count() > 0


def test_difficulty_against_a_base_and_with_string_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{i:02}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    some = df.where("id < 'k05'")
    sim = np.minimum(x[:5] @ x.T, 1)
    got = {r.id: r.expansion for r in stats.expansion(some, [0.3], base=df).collect()}
    for i in range(5):
        s = np.sort(sim[i])[::-1]
        c, below = int((s >= 0.3).sum()), s[s < 0.3]
        assert got[f"k{i:02}"] == pytest.approx(0.3 / below[min(2 * c, len(below) - 1)])
    every = {r.id: r.lid for r in stats.lid(df, [0.3]).collect()}
    assert {r.id: r.lid for r in stats.lid(some, [0.3], base=df).collect()} == pytest.approx({k: v for k, v in every.items() if k < "k05"})
    assert stats.lid_at(df, "k03", 0.3).first()["lid"] == pytest.approx(every["k03"])
    assert {r.dst for r in stats.peek(df, ["k01"]).collect()} == {f"k{i:02}" for i in range(50)}


def test_counters_of_runs(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    for algorithm in ("cartesian", "local-lsh"):
        c = {(r.kind, r.step): r["count"] for r in stats.counters_of(df, "id", "v", 0.6, algorithm, 7, **({} if algorithm == "cartesian" else {"k": 4})).collect()}
        total = lambda kind: sum(n for (k, _), n in c.items() if k == kind)  # noqa: B023, E731
        assert total("CandidatePairs") == sum(total(k) for k in ("SelfPairsDiscarded", "SketchDiscarded", "DuplicatesDiscarded", "SimilarityDiscarded", "OutputPairs"))
        assert total("OutputPairs") == similarity_self_join(df, "id", "v", 0.6, algorithm, k=4).count()
        assert total("Load") > 0
    assert df.where(F.col("id") < 0).count() == 0
