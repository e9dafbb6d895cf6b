"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of fixed-length windows; ReLU and max pooling give one number for each
filter, and a softmax layer gives the languages' probabilities. A text of any length is
cut into windows of WINDOW bytes that overlap by OVERLAP, so that every run of bytes that a filter can see lies within one, the last one flush
with its end (shorter texts are padded with zero bytes); its probabilities are the mean over its windows. Because the input is one-hot bytes, a filter is a table
of weights by byte, and tables of two bytes make the convolution a few look-ups.

The network is trained on labelled text of the corpus: at most PER_LANGUAGE documents of each label,
those with text and the smallest hashes of their ids, so the sample is the same on every run; the bound is a parameter of ``train``. Of each of
them the network sees the whole text, window by window, and of every second window also a shorter piece.

Defined cases: a text that is null, empty or without a letter gets the language ``und`` with
probability 0 and is rejected, as is one whose best probability is below MIN_PROBABILITY; equal probabilities
go to the language that sorts first; null labels don't train; without labelled text all texts are
``und``; repeated rows each get their result; an empty table gives no rows; other columns are
carried through by the filter and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import col, slices, table, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
OVERLAP = max(WIDTHS) - 1
#: Bound of the training sample: documents of each label.
PER_LANGUAGE = 250
MIN_PROBABILITY = 0.4
UNKNOWN = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every window, and the number of windows of each text (none of an empty one)."""
    sizes, step = np.diff(offsets), WINDOW - OVERLAP
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - OVERLAP) // step)), 0)
    first = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    begin = offsets[:-1][text] + (np.arange(int(n.sum())) - first[text]) * step
    end = offsets[1:][text]
    begin = np.where((begin + WINDOW > end) & (sizes[text] > WINDOW), end - WINDOW, begin)
    return begin, np.minimum(begin + WINDOW, end), n


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = begin[:, None] + np.arange(WINDOW)
    short = at >= end[:, None]
    x = data[np.minimum(at, max(0, len(data) - 1))]
    x[short] = 0
    return x


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.languages = languages
        self.params = {f"w{w}": rng.normal(0, 1 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.params |= {"b": np.zeros(n, np.float32), "v": rng.normal(0, 0.3, (n, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter and where it is; for training."""
        top, where = [], []
        for w in WIDTHS:
            table, last = self.params[f"w{w}"], WINDOW - w + 1
            r = table[0][x[:, :last]]
            for o in range(1, w):
                r += table[o][x[:, o : o + last]]
            where.append(r.argmax(1))
            top.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
        return np.concatenate(top, 1), np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in self.params.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                xs, ys = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                top, where = self.pooled(xs)
                h = np.maximum(top + self.params["b"], 0)
                p = softmax(h @ self.params["v"] + self.params["c"])
                p[np.arange(len(ys)), ys] -= 1
                p /= len(ys)
                back = (p @ self.params["v"].T) * (h > 0)
                grads = {"v": h.T @ p, "c": p.sum(0), "b": back.sum(0)}
                rows = np.arange(len(xs))[:, None]
                for k, w in enumerate(WIDTHS):
                    g, at, part = np.zeros_like(self.params[f"w{w}"]), slice(k * FILTERS, (k + 1) * FILTERS), np.arange(FILTERS)[None]
                    for o in range(w):
                        np.add.at(g[o], (xs[rows, where[:, at] + o], part), back[:, at])
                    grads[f"w{w}"] = g
                step += 1
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.params[name] -= (speed * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        self._tables = None

    def tables(self) -> list[np.ndarray]:
        if self._tables is None:
            two, three, four = (self.params[f"w{w}"] for w in WIDTHS)
            pair = lambda t: (t[0][:, None] + t[1][None]).reshape(65536, FILTERS)
            self._tables = [np.concatenate([pair(two), pair(three), pair(four)], 1), three[2], pair(four[2:])]
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows (n, WINDOW)."""
        first, third, rest = self.tables()
        out = np.empty((len(x), len(self.languages)), np.float32)
        for lo in range(0, len(x), 64):
            xs = x[lo : lo + 64].astype(np.int64)
            two = (xs[:, :-1] << 8) | xs[:, 1:]
            r = first.take(two, axis=0)
            # A filter of three or four bytes has one or two places less.
            r[:, :-1, FILTERS : 2 * FILTERS] += third.take(xs[:, 2:], axis=0)
            r[:, :-2, 2 * FILTERS :] += rest.take(two[:, 2:], axis=0)
            r[:, -1:, FILTERS:] = r[:, -2:-1, 2 * FILTERS :] = -np.inf
            h = np.maximum(r.max(1) + self.params["b"], 0)
            out[lo : lo + 64] = softmax(h @ self.params["v"] + self.params["c"])
        return out

    def classify(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text; zeros where there are none."""
        begin, end, n = cut_windows(data, offsets)
        total = np.zeros((len(n), len(self.languages)))
        if len(begin) and self.languages:
            first = np.cumsum(n) - n
            p = np.concatenate([self.probabilities(gather(data, begin[k : k + 4096], end[k : k + 4096])) for k in range(0, len(begin), 4096)])
            some = n > 0
            total[some] = np.add.reduceat(p.astype(np.float64), first[some], axis=0) / n[some, None]
        return total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text, and a shorter piece of every second one, so that short texts are learnt too."""
    rng = np.random.default_rng(seed)
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, end, n = cut_windows(data, np.append(0, np.cumsum(size)))
    y = np.repeat(labels, n)
    half = np.arange(0, len(begin), 2)
    low, span = begin[half], end[half] - begin[half]
    piece = np.minimum(rng.integers(12, WINDOW, len(half)), span)
    low = low + (rng.random(len(half)) * (span - piece + 1)).astype(np.int64)
    return gather(data, np.append(begin, low), np.append(end, low + piece)), np.append(y, y[half])


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, text, lang) of at most per_language labelled documents with text of each language."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    usable = F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)
    ids = rows.where(usable).select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id").distinct()
    return rows.where(usable).join(F.broadcast(ids), "id", "left_semi")  # at most per_language ids a language


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN:
    got = training_sample(docs, per_language, id_col, text_col, lang_col).toArrow().to_pandas().sort_values(["lang", "id", "text"])
    languages = sorted(set(got["lang"]))
    model = ByteCNN(languages)
    if languages:
        x, y = training_windows([t.encode("utf-8", "surrogatepass") for t in got["text"]], np.array([languages.index(v) for v in got["lang"]]))
        model.fit(x, y)
    return model


def judge(model: ByteCNN, text: pa.Array, min_probability: float = MIN_PROBABILITY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and whether it is kept, for each text."""
    p = model.classify(*utf8(text))
    letters = pc.match_substring_regex(text.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    known = letters & (p.sum(1) > 0)
    best = p.argmax(1) if model.languages else np.zeros(len(p), int)
    top = np.where(known, p.max(1, initial=0), 0.0)
    kept = known & (top >= min_probability)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], top, kept


def identify(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """(id, language, probability, kept) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                language, p, kept = judge(model, batch.column(1), min_probability)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(p), pa.array(kept)], names=[id_col, "language", "probability", "kept"])

    rows = docs.select(col(id_col), col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, language string, probability double, kept boolean")


def keep_identified(docs: DataFrame, model: ByteCNN, text_col: str = "text", min_probability: float = MIN_PROBABILITY, lang_col: str | None = None) -> DataFrame:
    """The rows of docs whose text has a language, all columns as they are; a null or blank value of lang_col, if it is given, becomes the language found."""
    at = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(at)):
                language, _, kept = judge(model, batch.column(at), min_probability)
                if lang is not None:
                    own = batch.column(lang)
                    known = pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(own), ""), False)
                    batch = batch.set_column(lang, batch.schema.field(lang), pc.if_else(known, own, pa.array(language, own.type)))
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
