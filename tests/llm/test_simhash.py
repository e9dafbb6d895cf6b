from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.llm import simhash


def test_bit_sliced_pairs_equal_brute_force():
    rng = np.random.default_rng(0)
    bits = np.repeat(rng.integers(0, 2, (120, 256)), 5, axis=0) ^ (rng.random((600, 256)) < 0.1)
    sims = np.packbits(bits.astype(np.uint8), axis=1)
    bucket = np.sort(rng.integers(0, 7, 600))
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(sims, bucket, simhash.RADIUS, block=64) for i, j in zip(a, b, strict=True)}
    d = (bits[:, None] != bits[None]).sum(2)
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if bucket[i] == bucket[j] and d[i, j] <= simhash.RADIUS}
    assert len(got) > 500


def test_counters():
    rng = np.random.default_rng(1)
    planes = rng.integers(0, 2, (23, 128))
    words = np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    lanes = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")
    total = simhash.add_counters(simhash.add_planes(words[:10]), simhash.add_planes(words[10:]))
    assert (sum(lanes(c).astype(int) << k for k, c in enumerate(total)) == planes.sum(0)).all()
    for limit in (0, 5, 11, 23, 200):
        assert (lanes(simhash.at_most(total, limit)) == (planes.sum(0) <= limit)).all()


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(3000)]
    docs = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 200))] for _ in range(120)]
    for i in range(0, 60, 2):
        for _ in range(rnd.randrange(1, 4)):
            docs.append([rnd.choice(vocabulary) if rnd.random() < 0.04 else w for w in docs[i]])
    return [" ".join(d) for d in docs]


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.keep_id, set()).add(r.doc_id)
    return out


def test_classes_and_links_against_brute_force(spark, corpus):
    texts = [*corpus, *corpus[:40]]  # with exact copies
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = simhash.classes(df).collect()
    got = grouped(rows)
    sims = simhash.simhashes(pa.array(texts))
    bits = np.unpackbits(np.frombuffer(b"".join(sims), np.uint8).reshape(-1, 32), axis=1)
    apart = (bits[:, None] != bits[None]).sum(2)
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if apart[i, j] <= simhash.RADIUS}
    found = {(i, j) for g in got.values() for i in g for j in g if i < j}
    assert len(near) > 40
    assert len(found & near) >= 0.95 * len(near)
    assert all(min(g) == keep and len(g) > 1 for keep, g in got.items())
    top = simhash.components(len(texts), iter([(np.array([i for i, _ in near]), np.array([j for _, j in near]))]))
    assert all(len({top[i] for i in g}) == 1 for g in got.values())
    want = [len({sims[j] for j in range(len(texts)) if apart[i, j] <= simhash.RADIUS and sims[j] != sims[i]}) for i in range(len(texts))]
    links = {r.doc_id: r.n_links for r in rows}
    assert all(n <= want[i] for i, n in links.items())
    assert sum(links.values()) >= 0.95 * sum(want)
    # Buckets that are cut into groups give the same links.
    assert sorted(map(tuple, simhash.classes(df, hot_rows=2).collect())) == sorted(map(tuple, rows))
    text_ids = df.select(F.format_string("k%04d", "doc_id").alias("doc_id"), "text")
    assert sorted((int(r.doc_id[1:]), int(r.keep_id[1:]), r.n_links) for r in simhash.classes(text_ids).collect()) == sorted(map(tuple, rows))


def test_first_table():
    rng = np.random.default_rng(6)
    where = simhash.positions(17, 40)
    bits = (rng.random((3000, 256)) < rng.choice([0.01, 0.05, 0.12, 0.3], 3000)[:, None]).astype(np.uint8)
    want = [next((t for t, at in enumerate(where) if not b[at].any()), -1) for b in bits]
    assert simhash.first_table(np.packbits(bits, axis=1), simhash.first_tables(where)).tolist() == want
    assert {-1, 0} < set(want)


def test_odd_rows(spark):
    rows = [(1, "same words here"), (2, "Same, words here!"), (3, None), (4, ""), (5, " \n"), (None, "same words here"), (6, "other text entirely"), (6, "other text entirely"), (7, "x " * 50000), (8, "!!! ...")]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id bigint, text string, id string, sim string, n int")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [(0, "same words here"), (1, "same words here"), (3, kept[2][1]), (4, ""), (5, " \n"), (6, "other text entirely"), (7, "x " * 50000), (8, "!!! ...")]
    assert simhash.drop_near_duplicates(df).columns == df.columns
    assert sorted(map(tuple, simhash.classes(df).collect())) == [(1, 1, 0), (2, 1, 0)]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    assert simhash.classes(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(6, "z text"), (6, "a text of its own"), (7, "y")], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(twice).collect())) == [(6, "a text of its own"), (7, "y")]


def test_plan_keeps_its_recall():
    for n in (1, 10**5, 10**7, 10**10):
        bits, tables = simhash.plan(n)
        assert 1 - (1 - (1 - simhash.SHARE) ** bits) ** tables >= simhash.RECALL
        assert simhash.positions(bits, tables).shape == (tables, bits)
        assert all(len(set(p)) == bits for p in simhash.positions(bits, tables).tolist())


def test_plan_keeps_its_recall_at_the_radius():
    for n in (1, 10**5, 10**7, 10**10):
        bits, tables = simhash.plan(n)
        one = math.comb(simhash.BITS - simhash.RADIUS, bits) / math.comb(simhash.BITS, bits)
        assert 1 - (1 - one) ** tables >= 0.9
    far = np.random.default_rng(2).random((2000, simhash.BITS)).argsort(1)[:, : simhash.RADIUS]
    where = simhash.positions(*simhash.plan(236_000))
    assert np.mean([not all(np.isin(t, d).any() for t in where) for d in far[:300]]) >= 0.85


def test_stars(spark):
    rnd = random.Random(5)
    edges = {(max(e), min(e)) for e in ((rnd.randrange(80), rnd.randrange(80)) for _ in range(60)) if e[0] != e[1]} | {(i + 1, i) for i in range(100, 130)}
    df = spark.createDataFrame(sorted(edges), "u bigint, v bigint")
    got = {r.u: r.v for r in simhash.roots(df).collect()}
    e = np.array(sorted(edges))
    top = simhash.components(131, iter([(e[:, 0], e[:, 1])]))
    assert got == {u: int(top[u]) for u in range(131) if top[u] != u}
