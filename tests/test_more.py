from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from affinis.functions import markup
from affinis.operators.rsjoin import similarity_join
from affinis.operators.selfjoin import similarity_self_join
from affinis.plans import experiments, results
from affinis.streaming import lookup


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_markup(spark):
    text = "'''Bold''' [[Page|link]] and [[other]]{{tpl|{{in}}}} <ref>x</ref>&amp; [http://x.y site]\n{|\n|a\n|}\n== Head ==\n* item"
    assert first(spark, markup.plain_text(F.lit(text))) == "Bold link and other & site\n\nHead\nitem"
    assert first(spark, markup.plain_text(F.lit(None).cast("string"))) is None
    assert markup.remove_nested("a{{b", "{{", "}}") == "a{{b"
    assert [first(spark, markup.roman(F.lit(n))) for n in (1, 4, 1994, 4999, 5000)] == ["I", "IV", "MCMXCIV", "MMMMCMXCIX", "5000"]
    assert first(spark, markup.normal_title(F.lit(" ab__c "))) == "Ab c"
    assert first(spark, markup.first_lower(F.lit("Ab"))) == "ab"
    assert first(spark, markup.find(F.lit("abc"), F.lit("c"))) == 3
    assert first(spark, markup.find(F.lit("abc"), F.lit("z"))) == -1


def data(spark, n=80):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8, 8))[rng.integers(0, 8, n)] + 0.3 * rng.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def test_join_of_two_and_of_a_stream(spark, tmp_path):
    x, df = data(spark)
    base, new = df.where("id >= 30"), df.where("id < 30")
    sim = x[:30] @ x[30:].T
    want = {(i, j + 30) for i, j in zip(*np.nonzero(sim >= 0.8), strict=True)}
    got = [(r.id_l, r.id_r) for r in similarity_join(new, base, "id", "v", 0.8, k=4, recall=0.95, sketch_bits=64).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(got) >= 0.8 * len(want)
    new.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    query = lookup.write(lookup.lookup(stream, base, "id", "v", 0.8, k=4, recall=0.95, sketch_bits=64), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert {(r.id_l, r.id_r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(got)


def test_experiments(spark, tmp_path):
    _, df = data(spark)
    path, store = str(tmp_path / "d"), str(tmp_path / "store")
    df.write.parquet(path)
    configs = list(experiments.grid(path=[path], threshold=[0.8], algorithm=["cartesian", "local-lsh"], k=[4]))
    sizes = [experiments.run(spark, c, store) for c in configs]
    assert sizes[0] == similarity_self_join(df, "id", "v", 0.8).count() >= sizes[1]
    assert [experiments.run(spark, c, store) for c in configs] == [None, None]
    row = experiments.stored(spark, store).where("algorithm = 'local-lsh'").first()
    assert row.recall == sizes[1] / sizes[0]
    assert experiments.run(spark, configs[0], store, rerun=True, timeout=0.001) is None
    assert experiments.stored(spark, store).where("output_size IS NULL").count() == 1


def test_results(spark):
    runs = spark.createDataFrame([(1, "a", 1, 10, "h:1,h:2", 2), (2, "a", 2, 30, "h:1", 2), (3, "b", 1, 5, "h:1", 1), (4, "b", 1, 5, "h:1,h:2", 1)], "id bigint, algorithm string, algorithm_version int, total_time_ms bigint, hosts string, threads int")
    assert {r.id for r in results.recent(runs).collect()} == {2, 3, 4}
    assert {r.id for r in results.best_runs(runs, ["algorithm"], "total_time_ms").collect()} == {1, 3, 4}
    w = {(r.algorithm, r.workers): r.gain for r in results.scalability(results.workers(runs)).collect()}
    assert w == {("a", 2): None, ("a", 4): 3.0, ("b", 1): None, ("b", 2): 1.0}
    c = spark.createDataFrame([(1, "Load", 0, 0, 5), (1, "Load", 0, 1, 9), (1, "Load", 1, 0, 1), (1, "CandidatePairs", 0, 0, 4), (1, "CandidatePairs", 2, 0, 3)], results.COUNTERS)
    assert results.max_load(c).first()["max_load"] == 9
    assert tuple(results.step_totals(c).first()) == (1, 0, 4, 7)
    assert results.candidate_fraction(c, spark.createDataFrame([(1, 8)], "id bigint, n bigint")).first()["fraction"] == 0.25
    net = spark.createDataFrame([(1, "h", "e", 1048576, 0)], results.NETWORK)
    assert tuple(results.load_range(c, net).first()) == (1, 6, 9, 1.0, 0.0)
    p = spark.createDataFrame([(1, "h", "t", "x::sketch", 3), (1, "h", "t", "other", 2)], results.PROFILE)
    assert {(r.category, r.frames) for r in results.profile_categories(p).collect()} == {("sketch", 3), ("other", 2)}
    assert results.pairs_per_frame(p, spark.createDataFrame([(1, "sketch", 6)], "id bigint, category string, pairs bigint")).first()["pairs_per_frame"] == 2.0
    m = spark.createDataFrame([(1, "h", 600)], results.DATA_BYTES)
    assert results.memory_per_repetition(m, spark.createDataFrame([(1, 3, 2)], "id bigint, repetitions int, threads int")).first()["bytes_per_repetition"] == 100.0
    assert results.message_bytes(100, 4, 3, 64) == 128
    s = spark.createDataFrame([(1, float(t), "h", 0.0, 0.0, tx, 0, 0, 0) for t, tx in enumerate((0, 100, 3, 50, 0))], results.SYSTEM)
    assert tuple(results.communication_phases(s).first()) == (1, 1.0, 3.0)
    assert results.usage_of_fastest(runs, s, ["algorithm"]).count() == 5
