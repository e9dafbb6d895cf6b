"""Quality rules from tokeniser fertility.

Two public vocabularies measure each text, word by word (white space separates words; no token of
either vocabulary crosses it): a piece vocabulary with byte fallback gives characters per token, the share of byte-fallback tokens
and the entropy of the token distribution; a byte-level BPE vocabulary gives characters per token once more. Only
the distinct words of a batch are tokenised; counts are over the whole text.

A band belongs to a language, or, where the language is unknown, to the script of most letters. It
rejects a text when

- ``chars_per_token`` is further from the band's centre than ``slack + spread / sqrt(n_tokens)``,
- ``byte_share`` is above the band's limit,
- ``evenness``, the entropy over log2 of min(n_tokens, 256), is below the band's floor (times a curve in n_tokens), or
- ``bpe_chars_per_token`` is outside fixed limits.

The bands of the four languages were set on the ``labels`` of the sf0.1 tables.

Defined cases: a text that is null, empty or only white space has no tokens, null measures and the reason
``empty``, and is rejected; a null or unknown language falls to the script's band; the first rule
broken is the reason; repeated rows each get their result; an empty table gives no rows; other
columns are carried through by the filter and not read otherwise. The vocabularies' paths are parameters.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from affinis.llm.bpe import TOKENIZERS
from affinis.llm.common import col, slices, table

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTES = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Band:
    centre: float
    slack: float = 0.05
    spread: float = 8.0
    byte_share: float = 0.05
    floor: float = 1.0
    bpe_low: float = 0.5
    bpe_high: float = 12.0


BANDS = {"de": Band(2.24), "en": Band(2.22), "es": Band(1.94), "fr": Band(1.98)}
SCRIPTS = {
    "LATIN": Band(3.0, 1.8, floor=0.8, byte_share=0.2), "CYRILLIC": Band(2.5, 1.8, floor=0.8, byte_share=0.2), "GREEK": Band(1.8, 1.4, floor=0.8, byte_share=0.6),
    "CJK": Band(1.0, 0.9, floor=0.6, byte_share=0.8, bpe_low=0.2), "OTHER": Band(1.5, 1.4, floor=0.6, byte_share=0.95, bpe_low=0.1),
}
#: Least evenness by number of tokens, log-linear in between; times a band's floor.
CURVE = ((32, 0.72), (100, 0.75), (250, 0.735), (400, 0.755), (1000, 0.785), (3000, 0.81))


@lru_cache(4)
def piece_vocabulary(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


@lru_cache(4)
def byte_vocabulary(path: str):
    import tiktoken

    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(w) for w in ranks]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def measure(text: pa.Array, pieces: str = PIECES, byte_pairs: str = BYTES) -> dict[str, np.ndarray]:
    """n_chars (without white space), n_tokens, chars_per_token, byte_share, entropy, evenness, bpe_chars_per_token."""
    model, is_byte = piece_vocabulary(pieces)
    bpe, bpe_bytes = byte_vocabulary(byte_pairs)
    trimmed = pc.utf8_trim_whitespace(text.fill_null("").cast(pa.large_string()))
    lists = pc.utf8_split_whitespace(trimmed)
    n = len(text)
    count = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), count)
    if not distinct:
        distinct, code, row = ["x"], code[:0], row[:0]
    found = model.encode(distinct, num_threads=1)
    size = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    by_bytes = np.bincount(np.repeat(np.arange(len(size)), size), is_byte[flat], len(size))
    chars = pc.utf8_length(pa.array(distinct, pa.large_string())).to_numpy(zero_copy_only=False)
    # A leading space starts a pre-token, so all words are encoded as one text and its tokens counted by word.
    ends = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in distinct])
    token_ends = np.cumsum(bpe_bytes[bpe.encode_to_numpy(" " + " ".join(distinct), disallowed_special=())])
    bpe_size = np.diff(np.searchsorted(token_ends, ends, side="right"), prepend=0)
    total = lambda per_word: np.bincount(row, per_word[code], n)
    n_chars, n_tokens, n_bytes, n_bpe = total(chars), total(size), total(by_bytes), total(bpe_size)
    each = size[code]
    cum = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(begin[code] - cum[:-1], each) + np.arange(cum[-1])]
    key, times = np.unique(np.repeat(row, each) * len(is_byte) + ids, return_counts=True)
    some = np.maximum(n_tokens, 1)
    entropy = np.log2(some) - np.bincount(key // len(is_byte), times * np.log2(times), n) / some
    return {
        "n_chars": n_chars.astype(np.int64), "n_tokens": n_tokens.astype(np.int64), "chars_per_token": n_chars / some, "byte_share": n_bytes / some, "entropy": entropy,
        "evenness": np.where(n_tokens > 1, entropy / np.log2(np.clip(n_tokens, 2, 256)), 1.0), "bpe_chars_per_token": n_chars / np.maximum(n_bpe, 1),
    }


def script(text: str) -> str:
    """The script of most letters of a text."""
    count: dict[str, int] = {}
    letters: dict[str, int] = {}
    for c in text:
        letters[c] = letters.get(c, 0) + 1
    for c, k in letters.items():
        if c.isalpha():
            first = unicodedata.name(c, "OTHER").split()[0]
            name = "CJK" if first in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else first if first in SCRIPTS else "OTHER"
            count[name] = count.get(name, 0) + k
    return max(sorted(count), key=lambda s: count[s]) if count else "OTHER"


def judge(text: pa.Array, lang: pa.Array, bands: dict[str, Band] | None = None, pieces: str = PIECES, byte_pairs: str = BYTES) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The measures, and the rule that each text breaks ('' if none)."""
    bands = BANDS if bands is None else bands
    m = measure(text, pieces, byte_pairs)
    names = [x if x in bands else None for x in lang.to_pylist()]
    own = [bands[x] if x else SCRIPTS[script(text[i].as_py() or "")] for i, x in enumerate(names)]
    limit = lambda field: np.array([getattr(b, field) for b in own], float)
    n = np.maximum(m["n_tokens"], 1)
    at, least = zip(*CURVE, strict=True)
    rules = (
        ("empty", m["n_tokens"] == 0),
        ("chars_per_token", np.abs(m["chars_per_token"] - limit("centre")) > limit("slack") + limit("spread") / np.sqrt(n)),
        ("byte_share", m["byte_share"] > limit("byte_share")),
        ("evenness", m["evenness"] < limit("floor") * np.interp(np.log(n), np.log(at), least)),
        ("bpe_chars_per_token", (m["bpe_chars_per_token"] < limit("bpe_low")) | (m["bpe_chars_per_token"] > limit("bpe_high"))),
    )
    reason = np.full(len(text), "", object)
    for name, broken in reversed(rules):
        reason[broken] = name
    return m, reason


SLICE = 8 << 20


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] | None = None, pieces: str = PIECES, byte_pairs: str = BYTES) -> DataFrame:
    """The measures of each row, the ``reason`` for its rejection (null if none) and ``kept``."""
    fields = ("n_tokens", "chars_per_token", "byte_share", "entropy", "evenness", "bpe_chars_per_token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1), SLICE):
                m, reason = judge(batch.column(1), batch.column(2), bands, pieces, byte_pairs)
                none = (m["n_tokens"] == 0) | (reason == "empty")
                out = [pa.array(m["n_tokens"]), *(pa.array(m[f], mask=none) for f in fields[1:]), pa.array([r or None for r in reason], pa.string()), pa.array(reason == "")]
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[id_col, *fields, "reason", "kept"])

    rows = docs.select(col(id_col), col(text_col).cast("string"), col(lang_col).cast("string"))
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens bigint, " + ", ".join(f"{f} double" for f in fields[1:]) + ", reason string, kept boolean"
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] | None = None, pieces: str = PIECES, byte_pairs: str = BYTES) -> DataFrame:
    """The rows of docs that break no rule, all columns as they are."""
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(at), SLICE):
                yield batch.filter(pa.array(judge(batch.column(at), batch.column(lang_at), bands, pieces, byte_pairs)[1] == ""))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
