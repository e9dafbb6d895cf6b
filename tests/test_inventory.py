"""Sources, preparation and text functions that no registered query reaches."""

from __future__ import annotations

import io as files
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import markup
from affinis.operators import datasets as ds
from affinis.plans import params
from affinis.sources import io


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_random_vectors_do_not_repeat_across_partitions(spark):
    rows = np.array([r.v for r in ds.random_vectors(spark, 64, 8, seed=3).orderBy("id").collect()])
    raw = np.stack([np.random.default_rng([3, i]).standard_normal(8) for i in range(64)])
    assert np.allclose(rows, raw / np.linalg.norm(raw, axis=1, keepdims=True))
    assert len(np.unique(np.round(raw, 6))) == raw.size  # no number twice: no row is a shift of another


def test_ranks_sums_and_carried_values(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 40, 500).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, x bigint").repartition(5)
    order = sorted(range(500), key=lambda i: (values[i], i))
    assert [r.id for r in ds.renumber(df, ["x", "id"], "n").orderBy("n").collect()] == order
    sums = {r.id: r.s for r in ds.running(df, ["x", "id"], F.col("x"), "s").collect()}
    assert [sums[i] for i in order] == np.cumsum([values[i] for i in order]).tolist()
    odd = df.withColumn("y", F.when(F.col("id") % 7 == 0, F.col("id")))
    for include in (True, False):
        got = {r.id: r.z for r in ds.carried(odd, ["x", "id"], "y", "z", include).collect()}
        last, want = None, []
        for i in order:
            own = i if i % 7 == 0 else last
            want.append(own if include else last)
            last = own
        assert [got[i] for i in order] == want
    assert ds.renumber(df.limit(0), ["x"], "n").count() == 0


def test_weighted_draws_follow_the_weights(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 4.0), (4, 0.0), (5, 2.0)], "id bigint, value double")
    edges = {r.id: (r.lo, r.hi) for r in ds.diversity_intervals(d).collect()}
    assert edges == {1: pytest.approx((0, 0.125)), 2: pytest.approx((0.125, 0.25)), 5: pytest.approx((0.25, 0.5)), 3: pytest.approx((0.5, 1))}
    got = ds.diversify_random(d, 4000, seed=2).collect()
    assert sorted(r.draw for r in got) == list(range(4000))
    share = np.bincount([r.id for r in got], minlength=6) / 4000
    assert share[1:] == pytest.approx([0.125, 0.125, 0.5, 0, 0.25], abs=0.03)


def test_perturbed_sets_and_unique_columns(spark):
    df = spark.createDataFrame([(i, 50, [1, 2]) for i in range(200)], "id bigint, universe bigint, words array<bigint>")
    rows = ds.perturb_sets(df, 0.5).collect()
    assert all({1, 2} <= set(r.words) and r.words == sorted(set(r.words)) and max(r.words) < 50 for r in rows)
    assert 0.5 < np.mean([len(r.words) - 2 for r in rows]) < 2.5
    t = spark.createDataFrame([("a", 1), ("a", 1), (" ", 2), (None, 3), ("b", 1)], "q string, n int")
    assert sorted(map(tuple, ds.unique_columns(t, ["q", "n"]).collect())) == [("a", 1), ("b", 1)]


def test_rescaling_by_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {r.id: r.v for r in ds.rescale_by_neighbours(df, 4).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(40):
        assert got[i] == pytest.approx((x[i] / np.sort(d[i])[:4].mean()).tolist(), rel=1e-5)


def test_derived_datasets(spark, tmp_path):
    df = spark.createDataFrame([(i, 10, [i % 3, 5]) for i in range(20)], "id bigint, universe bigint, words array<bigint>")
    df.write.parquet(str(tmp_path / "base"))
    path = ds.derive(spark, str(tmp_path), "base-inflated-2", chunks=2)
    assert spark.read.parquet(path).count() == 40
    assert spark.read.parquet(ds.derive(spark, str(tmp_path), "base-sample-200000", chunks=2)).count() == 20
    assert ds.derive(spark, str(tmp_path), "base-inflated-2") == path
    with pytest.raises(FileNotFoundError):
        ds.derive(spark, str(tmp_path), "other")


def test_lines_files_and_archives(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("".join(f"w {i}\n" for i in range(3000)))
    (tmp_path / "t/b.txt").write_text("w 7 7\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = {r.row: r.v for r in io.from_text(spark, str(tmp_path / "t/a.txt"), "vector").collect()}
        assert rows == {i: [float(i)] for i in range(3000)}
        assert io.from_text(spark, str(tmp_path / "t/a.txt"), "vector", F.col("row") % 100 == 5).count() == 30
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert io.some_files(spark.read.text(str(tmp_path / "t")), ["b.txt"]).count() == 1
    assert io.peek_one(spark.read.text(str(tmp_path / "t/b.txt")))["value"] == "w 7 7"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.bin", b"2")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("three.txt")
        info.size = 1
        t.addfile(info, files.BytesIO(b"3"))
    got = io.read_archives(spark, str(tmp_path / "x.*"), ".txt").collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == [("d/one.txt", b"1"), ("three.txt", b"3")]


def test_dump_to_text(spark, tmp_path):
    page = lambda n, title, ns, text, more="": f"<page><title>{title}</title><ns>{ns}</ns><id>{n}</id>{more}<revision><id>{n}0</id><text>{text}</text></revision></page>"
    (tmp_path / "d.xml").write_text(
        "<mediawiki>" + page(1, "One", 0, "'''Bold''' [[a|b]] text") + page(1, "One", 0, "'''Bold''' [[a|b]] text") + page(2, "Talk", 1, "x") + page(3, "Moved", 0, "y", '<redirect title="z"/>')
        + page(4, "Many", 0, "{{disambig}} may mean") + page(5, "Last (disambiguation)", 0, "list") + page(6, "Six", 0, "s") + "</mediawiki>"
    )
    pages = io.read_wiki_pages(spark, str(tmp_path / "d.xml"))
    assert sorted((r.id, r.title, r.revision) for r in pages.collect()) == [(1, "One", 10), (4, "Many", 40), (5, "Last (disambiguation)", 50), (6, "Six", 60)]
    some = io.read_wiki_pages(spark, str(tmp_path / "d.xml"), disambiguation=False)
    assert {r.id for r in some.collect()} == {1, 6}
    io.write_wiki_text(some, str(tmp_path / "json"), least=2)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()] == [{"id": 1, "title": "One", "text": "Bold b text"}]
    io.write_wiki_text(some, str(tmp_path / "text"), json=False, rows_a_file=1, compression="bzip2")
    assert len(list((tmp_path / "text").glob("*.bz2"))) == 2


def test_text_functions(spark):
    text = "Intro\nline\n\n== Empty ==\n\n== Full ==\n* one\n* two\n\n=== Deep ===\n"
    assert first(spark, markup.compact(F.lit(text))) == "Intro line\nFull.\none two"
    assert first(spark, markup.plain_text(F.lit("a <x " + "y" * 500 + ">b"))) == "a b"
    assert first(spark, markup.base_name(F.lit("/a/b.parquet/"))) == "b.parquet"
    assert first(spark, markup.substring(F.lit("abcdef"), F.lit(2), F.lit(3))) == "bcd"
    assert first(spark, markup.replace_some(F.lit("a.b.c.d"), ".", "-", 2)) == "a-b-c.d"
    assert first(spark, markup.replace_some(F.lit("a.b"), ".", "-")) == "a-b"
    assert first(spark, markup.replace_some(F.lit("ab"), ".", "-", 5)) == "ab"


def test_grid_and_shared_pools():
    assert [params.worker_grid(n) for n in (16, 32, 40)] == [(4, 4), (4, 8), (5, 8)]
    assert all(params.grid_worker(*params.grid_cell(w, 40), 40) == w for w in range(40))
    assert {params.grid_worker_of(a, b, 40) for a in range(9) for b in range(17)} == set(range(40))
    s = params.shared(params.JACCARD, 0.5, 4)
    assert (s.repetitions, s.bits) == (params.simple_repetitions(0.75, 4), 27)
    assert all(0 <= p < s.bits for r in range(s.repetitions) for p in s.picks(r, [3, 5, 7, 11], [1, 2, 3, 4]))
