from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import selfjoin, stats
from affinis.operators.cells import triangle_cells
from affinis.operators.selfjoin import similarity_self_join


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((25, 16))
    x = centre[rng.integers(0, 25, 300)] + rng.standard_normal((300, 16)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").cache()


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 2000, 40).tolist() for _ in range(40)]
    rows = [sorted({w if rng.random() < 0.85 else int(rng.integers(0, 2000)) for w in base[i % 40]}) for i in range(200)]
    return rows, spark.createDataFrame(list(enumerate(rows)), "id bigint, v array<bigint>").cache()


def found(df):
    rows = df.collect()
    out = {(r.id_l, r.id_r): r.similarity for r in rows}
    assert len(out) == len(rows)
    assert all(a < b for a, b in out)
    return out


def exact_sets(rows, r):
    s = [set(x) for x in rows]
    return {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) / len(s[i] | s[j]) >= r}


def test_cartesian_vectors(vectors):
    x, df = vectors
    sim = x @ x.T
    want = {(i, j): sim[i, j] for i in range(300) for j in range(i + 1, 300) if sim[i, j] >= 0.7}
    for groups in (1, 4):
        got = found(similarity_self_join(df, "id", "v", 0.7, groups=groups))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cartesian_sets(sets):
    rows, df = sets
    want = exact_sets(rows, 0.5)
    for groups in (1, 3):
        got = found(similarity_self_join(df, "id", "v", 0.5, groups=groups))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("bits", [0, 128])
@pytest.mark.parametrize("which", ["vectors", "sets"])
def test_local_equals_one_level_and_is_contained_in_the_exact_result(request, which, bits):
    _, df = request.getfixturevalue(which)
    r = 0.7 if which == "vectors" else 0.5
    exact = found(similarity_self_join(df, "id", "v", r))
    one = found(similarity_self_join(df, "id", "v", r, "one-level-lsh", k=6, sketch_bits=bits))
    local = found(similarity_self_join(df, "id", "v", r, "local-lsh", k=6, sketch_bits=bits))
    assert one.keys() == local.keys()
    assert one.keys() <= exact.keys()
    two = found(similarity_self_join(df, "id", "v", r, "two-level-lsh", k=4, k2=3, sketch_bits=bits))
    assert two.keys() <= exact.keys()
    assert min(len(one), len(two)) >= 0.7 * len(exact)


def test_recall_over_seeds(vectors):
    _, df = vectors
    exact = similarity_self_join(df, "id", "v", 0.7).cache()
    shares = [stats.recall(similarity_self_join(df, "id", "v", 0.7, "one-level-lsh", k=5, seed=s), exact).first()["recall"] for s in range(4)]
    assert np.mean(shares) >= 0.8


def test_counters_add_up(vectors):
    _, df = vectors
    for options in ({}, {"sketch_bits": 64}, {"k2": 3}):
        rows = stats.join_counters(df, "id", "v", 0.7, k=4, **options).collect()
        for r in rows:
            assert r.candidate_pairs == r.self_pairs_discarded + r.sketch_discarded + r.duplicates_discarded + r.similarity_discarded + r.output_pairs
        got = similarity_self_join(df, "id", "v", 0.7, "two-level-lsh" if "k2" in options else "one-level-lsh", **{"k": 4, **options}).count()
        assert sum(r.output_pairs for r in rows) == got


def test_every_pair_meets_in_one_cell(spark):
    cells = triangle_cells(spark.range(60), 4).collect()
    met = {}
    for c in cells:
        met.setdefault((c.cell_i, c.cell_j), []).append((c.id, c.side))
    seen = []
    for rows in met.values():
        both = [i for i, s in rows if s == 2]
        seen += [(min(a, b), max(a, b)) for k, a in enumerate(both) for b in both[:k]]
        seen += [(min(a, b), max(a, b)) for a, s in rows if s == 0 for b, t in rows if t == 1]
    assert len(seen) == len(set(seen)) == 60 * 59 // 2


def test_input_rows(spark):
    df = spark.createDataFrame([(1, [1, 2, 2]), (2, [2, 1]), (3, []), (4, None), (None, [1])], "id bigint, v array<bigint>")
    assert found(similarity_self_join(df, "id", "v", 0.9)) == {(1, 2): 1.0}
    for algorithm in ("cartesian", "local-lsh", "one-level-lsh", "two-level-lsh"):
        assert similarity_self_join(df.limit(0), "id", "v", 0.9, algorithm).count() == 0
    with pytest.raises(ValueError, match="no algorithm"):
        similarity_self_join(df, "id", "v", 0.9, "other")
    with pytest.raises(TypeError):
        similarity_self_join(df.withColumn("v", F.lit(1)), "id", "v", 0.9)


def test_dry_run_and_buckets(vectors):
    _, df = vectors
    met = similarity_self_join(df, "id", "v", 0.7, "one-level-lsh", k=6, dry_run=True)
    h = stats.bucket_histogram(df, "id", "v", 0.7, k=6)
    assert met.count() == h.agg(F.sum("pairs")).first()[0]
    assert all(r.parts >= 1 for r in stats.balance(h, 8).collect())
    top = selfjoin.first_matches(df, "id", "v", 0.7, 2).groupBy("id_l").count().agg(F.max("count")).first()[0]
    assert top <= 2
