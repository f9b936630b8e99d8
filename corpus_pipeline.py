"""A corpus from raw documents to packed sequences: each stage is one operator, written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm._spark import shared_folder
from cadenza.llm.jaccard import keep_first
from cadenza.llm.mixing import mixed
from cadenza.llm.packing import packed
from cadenza.llm.repeats import without_repeats
from cadenza.llm.rules import accepted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy accepts. Null, empty and blank texts have too few words and go; long texts are measured
    whole; repeated rows are each decided, alike; an empty table gives an empty one. Columns stay as they are, whatever their names."""
    return accepted(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id (null ids last; ties, as repeated rows, by the text's
    checksum). Texts without words, null ones too, are near copies of nothing and all stay; long texts are compared whole; an empty table
    gives an empty one. Columns stay as they are."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 13 words or more that a document with a smaller doc_id holds; n_chars follows the
    text. Rows of one doc_id keep what they share, and a null doc_id comes after all others. A document that loses all its words goes; one
    that had none stays, null text too. Long texts are read whole; an empty table gives an empty one. Other columns stay as they are."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one document a source a part. Rows without words, null texts too, add nothing
    and go. Null is a source of its own, the last. Repeated rows are drawn for together and come as copies of one of them. An empty table
    gives an empty one. Columns stay, n_chars follows a text taken in part."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences they lie in. A null or empty text is its closing id alone; a long text has many
    pieces; repeated rows, as the mix's copies are, each have their own, told apart by where they lie. Ties in length go by doc_id, start and
    checksum. An empty table gives an empty one. Columns of the documents other than doc_id aren't kept."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("packing", packing)]
#: Shingle classes, dependent rounding and tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written below the checkpoint folder of the session and read again. The stages' tables
    stay there, for whoever wants to look at them."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
