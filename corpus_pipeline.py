"""Corpus pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join, mixing of sources, best-fit packing.

Each stage is one operator of lodestock.llm, works on all that the one before it kept, and is written as Parquet and read again.
All stages but the last return the columns of `documents`, with n_chars as the text then has it.

Nulls, empty texts, repeated rows and empty tables are treated as each operator's module says. Line dedup drops a document that
had words and has none left; the n-gram join keeps the smallest id of a group and every row with a null id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestock.llm.common import table, written
from lodestock.llm.line_dedup import dedup_lines
from lodestock.llm.mixing import mix_sources
from lodestock.llm.ngram_join import ngram_components
from lodestock.llm.packing import pack_documents
from lodestock.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier line matches; those with nothing left go."""
    left = dedup_lines(docs.select(*COLUMNS))
    return left.where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8)."""
    gone = ngram_components(docs).where("component_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in the order of a hash."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]
#: A forest grown from random numbers has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
