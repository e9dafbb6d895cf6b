from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affinis.llm import bpe
from affinis.llm.common import utf8

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    import tiktoken

    pairs = [line.split() for line in Path(bpe.VOCABULARY).read_bytes().splitlines() if line.strip()]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return bpe.tokenizer(bpe.VOCABULARY), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(own, texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, counts = own.encode_batch(data, offsets)
    back, edges = own.decode_batch(ids, counts)
    at = np.cumsum(np.append(0, counts))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], [back[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]


EDGE = ["", " ", "  \n\n x", "don't 'still we'll '' 's !'s I'm\n're 'r 'l 'lls x'd", "  a", "12 4.5e6", "日本語 😀‍👩", "a" * 3000, "'", "x'", "it's", "ab  c", "<|endoftext|>", "ßÇñ"]


def test_equals_the_public_library(both):
    own, other = both
    ids, back = run(own, EDGE)
    assert ids == [other.encode_ordinary(t) for t in EDGE]
    assert back == EDGE


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn"), max_codepoint=0x2FFF), max_size=40) | st.text(alphabet="ab' \n1!re'sltvmd", max_size=40), max_size=5))
def test_any_text(both, texts):
    own, other = both
    ids, back = run(own, texts)
    assert back == texts
    assert ids == [other.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal():
    h = bpe.mix(np.arange(5000, dtype=np.uint64))
    table = bpe.PerfectHash(h)
    assert sorted(table.key_of.tolist()) == list(range(5000))
    assert table.find(h).tolist() == list(range(5000))


def test_query_form(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (2, None, 1), (3, "", 1), (None, "x", 1)], "doc_id bigint, text string, ids int")
    got = bpe.encode(df)
    rows = {(r.doc_id, r.n_tokens, r.round_trip) for r in got.collect()}
    assert rows == {(1, 2, True), (2, None, None), (3, 0, True), (None, 1, True)}
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode(got).collect() if r.text is not None) == [(0, "x"), (1, "a b"), (1, "a b"), (3, "")]
    assert bpe.encode(df.limit(0)).count() == 0
