"""From raw documents to tokens: quality rules, exact and near deduplication, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import bpe, exact, mixing, neardup, quality
from rangeloom.shared import new_path, remove, scratch, stored

# What holds for all stages: they read ``doc_id``, ``text`` and, in the mix, ``source`` and ``n_chars``; all other columns pass
# through under whatever names. An empty table gives an empty one. Long texts are processed whole.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go.

    Null, empty and white texts go. Repeated rows are judged alike, each by its own text.
    """
    return quality.keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (less white space) stays, by a digest index.

    Of equal texts the longest stays, of ties the smallest doc_id; a null doc_id only where there is no other. Null texts
    count as empty, and all empty texts are one. Repeated rows become one.
    """
    return exact.keep_rows(docs, exact.new_index(spark, exact.buckets_for(docs.count())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays: five-word shingles, similarity 0.8.

    Texts without words and rows with a null doc_id stay. A doc_id with several texts is one document: all its rows stay or go.
    """
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights by packed blocks; a document comes once for each epoch that takes it.

    Documents without words are in no block and go. A null source is a source. Rows that repeat a doc_id, source and text
    count once. The stage returns the columns of documents, so the copies of a document are told apart by nothing but their text.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix, a row per row; a null text has no tokens."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("tokens", tokens),
]

#: Compression ratios and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    When a stage is written, the tables that it made on the way and its predecessor's result are removed.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark, keep=[path]):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
