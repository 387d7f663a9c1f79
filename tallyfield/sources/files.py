"""Readers of text and token files, and writers of count tables.

Readers leave listing, splitting and decompression to Spark (.gz, .zst and plain
files alike; plain lines belong to the split that they start in).  Writers go
through Spark's committers, so that a failed job leaves no half-written table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_texts(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """(text) of every line that is JSON and has one; bad lines, lines without text and null texts go."""
    lines = spark.read.schema(f"`{text_col}` string").option("mode", "DROPMALFORMED").json(path)
    return lines.select(F.col(text_col).alias("text")).where("text IS NOT NULL")


def read_tokens(spark: SparkSession, path: str, chunk: int = 2048, piece: int = 64) -> DataFrame:
    """(path, chunk, tokens) of little-endian uint16 files, in chunks; a short last chunk stays, an odd last byte fails the read.

    A file is read whole by one task, as binaryFile does: files must be under 2 GB.
    """

    def cut(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                if len(content) % 2:
                    raise ValueError(f"{name}: {len(content)} bytes aren't whole tokens")
                ids = np.frombuffer(content, "<u2")
                starts = range(0, len(ids), chunk)
                for at in range(0, len(starts), piece):
                    some = starts[at : at + piece]
                    yield pd.DataFrame({"path": name, "chunk": [s // chunk for s in some], "tokens": [ids[s : s + chunk].astype("int32") for s in some]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, chunk long, tokens array<int>")


def write_dense_csv(counts: DataFrame, path: str, most: int = 10000) -> None:
    """counts(n, c) as one CSV number,count of 0..most, missing numbers as 0, rising.  Its size is fixed by most."""
    grid = counts.sparkSession.range(0, most + 1).select(F.col("id").cast("int").alias("number"))
    c = counts.groupBy(F.col("n").cast("int").alias("number")).agg(F.sum("c").alias("count"))
    grid.join(c, "number", "left").select("number", F.coalesce("count", F.lit(0)).cast("long").alias("count")).coalesce(1).sortWithinPartitions("number").write.option("header", True).csv(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are written, so that each row has all keys."""
    summary.write.option("ignoreNullFields", False).json(path)


def write_long_csv(table: DataFrame, path: str) -> None:
    """A long table as gzipped CSV files with headers."""
    table.write.option("header", True).option("compression", "gzip").csv(path)
