"""The registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import count_integers, describe, mle
from ..operators.neighbours import nearest
from ..streaming.counts import streamed_counts, windowed_events
from .further import FURTHER
from .kernels import KERNELS
from .more import MORE
from .sql import QUERIES, spell
from .whole import ORACLE, WHOLE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages: extract, count, fill, fit - one row a corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("documents").alias("corpus"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("corpus"), F.col("html").alias("text"))
    out = describe(count_integers(docs.unionByName(pages), "corpus"), "corpus")
    return out.withColumn("alpha_mle", F.round(mle(F.col("_c"), F.col("_l")), 6)).drop("_c", "_l")


def _describe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey between 0 and 10000").groupBy(F.col("l_returnflag").alias("corpus"), F.col("l_partkey").cast("int").alias("n")).agg(F.count("*").alias("c"))
    return describe(counts, "corpus").drop("_c", "_l")


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k)


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 5).select(F.col("id").alias("vec_id"), "k", "other", F.round("d", 6).alias("d"))


def _knn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of neighbours that have the label of their query."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    near = _neighbours(spark, sf_dir, 10).join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id").join(labels.select(F.col("vec_id").alias("other"), "label"), "other")
    return near.agg(F.round(F.avg(F.when(F.col("own") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("same"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_run, spell(v, 0)) for k, v in (QUERIES | MORE | FURTHER | WHOLE).items()}
    return out | KERNELS | {"J11_knn": _knn, "G12_knn_labels": _knn_labels, "F03_flagship": flagship, "F07_describe": _describe_parts, "L01_streamed_counts": streamed_counts, "L07_windowed_events": windowed_events}


_DESCRIBE = """SELECT corpus, round(regr_slope(CASE WHEN n >= 1 AND c > 0 THEN ln(c) END, CASE WHEN n >= 1 AND c > 0 THEN ln(n) END), 6) AS alpha_ols,
  round(regr_r2(CASE WHEN n >= 1 AND c > 0 THEN ln(c) END, CASE WHEN n >= 1 AND c > 0 THEN ln(n) END), 6) AS r2, CAST(sum(c) AS BIGINT) AS integer_matches,
  round(count_if(n >= 1 AND c > 0) / 10000.0, 6) AS support, count_if(n BETWEEN 10 AND 9999 AND c < 4000) AS rare,
  round(sum(CASE WHEN n BETWEEN 10 AND 9999 THEN c / (c + 4000.0) END), 6) AS saturation"""
_GRID = "den AS (SELECT k.corpus, z.n, coalesce(cnt.c, 0) AS c FROM (SELECT DISTINCT corpus FROM cnt) k CROSS JOIN {ZERO} z LEFT JOIN cnt ON cnt.corpus = k.corpus AND cnt.n = z.n)"


def oracle_sql() -> dict[str, str]:
    out = {k: spell(v, 1) for k, v in (QUERIES | MORE | FURTHER).items()} | ORACLE
    out["F07_describe"] = spell(f"WITH cnt AS (SELECT l_returnflag AS corpus, CAST(l_partkey AS INT) AS n, count(*) AS c FROM lineitem WHERE l_partkey BETWEEN 0 AND 10000 GROUP BY 1, 2), {_GRID} {_DESCRIBE} FROM den GROUP BY corpus", 1)
    out["L01_streamed_counts"] = "SELECT event_type, CAST(floor(value) AS INT) AS n, count(*) AS c FROM events GROUP BY 1, 2"
    out["L07_windowed_events"] = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS k, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    return out
