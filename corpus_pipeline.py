"""The corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
the columns of documents; the last returns the packing, a row for each piece of a document. Stages
keep to the defined cases of their operators: language ID and quality rules drop null, empty and
blank texts; the later two leave rows with a null id as they are; packing leaves no kept word out;
empty tables and extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinis.llm import language_id, packing, quality, simhash, suffix_dedup
from affinis.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the network, trained on their labels, is sure enough of; it becomes the label of those without one."""
    return language_id.keep_identified(docs, language_id.train(docs), lang_col="lang")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokeniser fertility is in the band of their language."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier place has."""
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words: (bin_id, slot, offset, doc_id, piece, start, n_words)."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: The network, the tokenisers and the plan of the bins are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, one after another; what several jobs read is cut with checkpoints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
