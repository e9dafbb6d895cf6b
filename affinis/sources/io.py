"""Sources and sinks: datasets as Parquet folders, text lines, fvecs files."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS, SETS = "vector", "bag-of-words"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: that of spark.checkpoint.dir, or, where it is unset and all runs on one machine, one of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="affinis-"))
    return df.checkpoint()


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def some_files(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the files of these names; the scan skips the others."""
    return df.where(F.col("_metadata.file_name").isin(wanted))


def write_dataset(df: DataFrame, path: str, chunks: int, order: list[str] | None = None) -> None:
    """A new folder of so many files; with an order, ids from 0 in it."""
    from affinis.operators.datasets import renumber

    if order:
        names = [f"\x00{c}" if c == "id" else c for c in order]
        df = renumber(df.withColumnRenamed("id", "\x00id"), names).drop("\x00id")
    df.repartition(chunks).write.mode("error").parquet(path)


def peek_one(df: DataFrame):
    return df.first()


def num_elements(df: DataFrame) -> int:
    return df.count()


def num_chunks(df: DataFrame) -> int:
    return len(df.inputFiles())


def content_type(df: DataFrame) -> str:
    """vector for an array of fractions named v, bag-of-words for an array of whole numbers named words."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            return VECTORS if isinstance(field.dataType.elementType, T.FractionalType) else SETS
    raise TypeError("no array column")


def numbered_lines(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(row, value): lines with their number from 0 within each file, in file order; with wanted, a condition on ``row``, only those.

    Lines are counted by block of a file first, so that a large file is the work of as many tasks as it has blocks.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    base = blocks.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("base"))  # one row a block
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    out = lines.withColumn("own", own).join(base, ["file", "block"]).select((F.col("base") + F.col("own")).alias("row"), "value")
    return out if wanted is None else out.where(wanted)


def vectors_of_lines(lines: DataFrame, normalized: bool = False) -> DataFrame:
    """(row, v): the first token of a line is a label and is skipped; lines without numbers are dropped."""
    from affinis.functions.measures import normalize

    parts = F.split(F.trim("value"), "[ \\t]+")
    v = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float"))
    rows = lines.select("row", v.alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    return rows.withColumn("v", normalize(F.col("v")).cast("array<float>")) if normalized else rows


def sets_of_lines(lines: DataFrame) -> DataFrame:
    """(row, universe, words): label, universe, tokens; empty sets are dropped."""
    parts = F.split(F.trim("value"), "[ \\t]+")
    words = F.array_sort(F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.try_cast("bigint")))
    return lines.select("row", F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("universe"), words.alias("words")).where((F.size("words") > 0) & F.col("universe").isNotNull() & ~F.exists("words", lambda x: x.isNull()))


def from_text(spark: SparkSession, path: str, kind: str, wanted: Column | None = None) -> DataFrame:
    """kind: vector, vector-normalized or bag-of-words; wanted: a condition on ``row``."""
    lines = numbered_lines(spark, path, wanted)
    if kind == SETS:
        return sets_of_lines(lines)
    if kind not in (VECTORS, "vector-normalized"):
        raise ValueError(f"no content type {kind}")
    return vectors_of_lines(lines, kind != VECTORS)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, v) of files of records (int32 dimension, float32 values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content:
                    raw = np.frombuffer(content, np.int32)
                    x = raw.reshape(-1, raw[0] + 1)[:, 1:].copy().view(np.float32)
                    for lo in range(0, len(x), 10000):
                        part = x[lo : lo + 10000]
                        v = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(lo, lo + len(part))), v], names=["file", "row", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row bigint, v array<float>")


def read_archives(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """(archive, name, content) of the members, with this ending, of zip and tar archives (tar.gz too); one archive is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io as files
        import tarfile
        import zipfile

        def members(content: bytes) -> Iterator[tuple[str, bytes]]:
            raw = files.BytesIO(content)
            if zipfile.is_zipfile(raw):
                with zipfile.ZipFile(raw) as z:
                    yield from ((n, z.read(n)) for n in z.namelist() if not n.endswith("/"))
            else:
                raw.seek(0)
                with tarfile.open(fileobj=raw) as t:
                    yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for name, data in members(content):
                    if name.endswith(ending):
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([data], pa.binary())], names=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def read_wiki_pages(spark: SparkSession, path: str, row_tag: str = "page", namespaces: tuple[int, ...] = (0,), disambiguation: bool = True) -> DataFrame:
    """(id, title, revision, text) of pages of an XML dump in these namespaces: no redirects, each id once; without disambiguation, no pages that only list meanings."""
    schema = "title string, ns bigint, id bigint, redirect struct<_title: string>, revision struct<id: bigint, text: string>"
    pages = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    pages = pages.where(F.col("ns").isin(*namespaces) & F.col("redirect").isNull()).select("id", "title", F.col("revision.id").alias("revision"), F.col("revision.text").alias("text"))
    if not disambiguation:
        listing = F.col("text").rlike(r"(?i)\{\{\s*(disambig(uation)?|dab|hndis|geodis)\s*(\|[^{}]*)?\}\}") | F.col("title").rlike(r"(?i)\(disambiguation\)\s*$")
        pages = pages.where(~F.coalesce(listing, F.lit(False)))
    return pages.groupBy("id").agg(F.max_by(F.struct("title", "revision", "text"), F.coalesce("revision", F.lit(-1))).alias("p")).select("id", "p.title", "p.revision", "p.text")


def write_wiki_text(pages: DataFrame, path: str, json: bool = True, least: int = 0, rows_a_file: int = 0, compression: str = "none") -> None:
    """Plain text of pages, in the order of their ids within files: a JSON object a line (id, title, text), or text with a heading and a blank line after each; pages shorter than least are left out."""
    from affinis.functions.markup import plain_text

    done = pages.select("id", "title", plain_text(F.col("text")).alias("text")).where(F.length("text") >= max(1, least))
    line = F.to_json(F.struct("id", "title", "text")) if json else F.concat_ws("\n", F.col("title"), F.lit(""), F.col("text"), F.lit(""))
    rows = done.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value"))
    out = rows.write.mode("error").option("compression", compression)
    (out.option("maxRecordsPerFile", rows_a_file) if rows_a_file else out).text(path)


def append(df: DataFrame, path: str) -> None:
    """Append results of runs to a table of the store."""
    df.write.mode("append").parquet(path)
