"""A training corpus from documents: five of the operators, one behind the other.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the
last one the tokens.  Stages are apart: what one returns is written as Parquet
and read again as the next one's docs.

Behaviour of every stage: rows with null or empty texts and rows without an id
stay unless the stage's operator decides about them by what they have; of equal
rows the third stage keeps one if they have words, the others decide alike for
each; empty tables pass through; columns beyond those of documents stay as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import decontam, jaccard, lines, quality, spm
from tallyfield.llm.queries import PIECES, table
from tallyfield.llm.session import fresh_path, ready, unused


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go.  n_chars follows the text."""
    dropped = unused("n_dropped", docs)
    out = lines.line_dedup(docs, lines_col=unused("n_lines", docs), dropped_col=dropped).where((F.col(dropped) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return jaccard.near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with whether they decode to its text."""
    return spm.encode(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: SQL expresses neither the classifier nor the transducer; tests/llm holds run() against its parts and against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
