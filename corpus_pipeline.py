"""From raw documents to packed sequences: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulift.llm import language_id, line_dedup, packing, simhash, substring_dedup
from tabulift.llm.common import free_name, quoted, stored

#: Share of a document's words that one language must hold.
MOST = 0.5


def _same_columns(after: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of the documents, with the number of characters of the text as it is now."""
    chosen = [F.length("text").cast(before.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in before.columns]
    return after.select(*chosen)


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in which one language holds at least ``MOST`` of the words; without labels to learn from, all stay."""
    model = language_id.learn(docs)
    if model is None:
        return docs
    name = free_name(docs, "found")
    found = docs.withColumn(name, language_id.predicted(model, F.col("text")))
    return found.where((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= MOST)).drop(name)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that are not within one edit of an earlier line."""
    return _same_columns(line_dedup.dedup_lines(docs), docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of at most three differing bits connect."""
    return simhash.one_of_each(docs, width=3, distance=3).select(*map(quoted, docs.columns))


def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words that a window of 50 words repeated from an earlier document covers."""
    return _same_columns(substring_dedup.dedup_substrings(docs, window=50), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of at most 4096 tokens."""
    return packing.tokenize_and_pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [
    ("language ID", one_language),
    ("line dedup", new_lines),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("substring dedup", new_passages),
    ("packing", packed),
]

#: No SQL runs a random field, XXH64 fingerprints or a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
