"""Queries of the matrix and topology kernels; tests/test_clouds.py holds the kernels against brute force.

Clouds: the labels' mean vectors, cut into four blocks of components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clouds


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cloud, label, vec) with mean vectors summed where the rows are."""
    each = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("p", "x")).where("label IS NOT NULL")
    mean = each.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x")).withColumn("cloud", F.floor(F.col("p") / 16).cast("int"))
    return mean.groupBy("cloud", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("vec"))


def _each_cloud(make, schema: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("label")
            out = make(np.stack(pdf["vec"].to_numpy()))
            out.insert(0, "cloud", int(pdf["cloud"].iloc[0]))
            return out

        return _points(spark, sf_dir).groupBy("cloud").applyInPandas(run, "cloud int, " + schema)

    return query


def _tree(x):
    deaths = np.sort(clouds.rips(clouds.distances(x))[0])
    return pd.DataFrame({"place": np.arange(len(deaths), dtype=np.int32), "death": np.round(deaths, 6)})


def _diagram(x):
    deaths, loops = clouds.rips(clouds.distances(x))
    rows = [(0, 0.0, v) for v in deaths] + [(1, a, b) for a, b in loops]
    return pd.DataFrame(rows, columns=["dim", "birth", "death"]).round(6).astype({"dim": "int32"})


def _bars(x):
    deaths, loops = clouds.rips(clouds.distances(x))
    out = []
    for dim, life in ((0, np.array(deaths)), (1, np.array([b - a for a, b in loops]))):
        p = life / life.sum() if len(life) and life.sum() > 0 else np.zeros(0)
        p = p[p > 0]
        out.append((dim, len(life), float(life.max(initial=0)), float(life.sum()), float(-(p * np.log(p)).sum())))
    return pd.DataFrame(out, columns=["dim", "bars", "longest", "total", "entropy"]).round(6).astype({"dim": "int32", "bars": "int32"})


def _loop(x):
    d = clouds.distances(x)
    life = sorted((b - a for a, b in clouds.rips(d)[1]), reverse=True) + [0.0, 0.0]
    scale = float(np.median(d[np.triu_indices(len(d), 1)])) if len(d) > 1 else 0.0
    return pd.DataFrame({"longest": [round(life[0], 6)], "second": [round(life[1], 6)], "by_scale": [round(life[0] / scale, 6) if scale else 0.0]})


def _isomap(x):
    axis = clouds.isomap(clouds.distances(x))
    return pd.DataFrame({"place": np.arange(len(axis), dtype=np.int32), "at": np.round(axis, 6)})


def _robust(x):
    low, sparse = clouds.low_rank_and_sparse(x)
    return pd.DataFrame({"rank": [int(np.linalg.matrix_rank(low, tol=1e-5))], "sparse_share": [round(float((np.abs(sparse) > 1e-6).mean()), 6)]}).astype({"rank": "int32"})


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wasserstein-1 between the loop diagrams of each cloud and the next one."""
    cloud = _points(spark, sf_dir)
    steps = cloud.select(F.explode(F.array(F.col("cloud"), F.col("cloud") - 1)).alias("step"), "cloud", "label", "vec").where("step >= 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [clouds.rips(clouds.distances(np.stack(g.sort_values("label")["vec"].to_numpy())))[1] for _, g in pdf.groupby("cloud")]
        return pd.DataFrame({"step": [int(pdf["step"].iloc[0])], "moved": [round(clouds.wasserstein(*found), 6)]} if len(found) == 2 else {"step": [], "moved": []})

    return steps.groupBy("step").applyInPandas(run, "step int, moved double")


def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, var = clouds.pca(_vectors(spark, sf_dir), "vec_id", "embedding")
    return scores.select(F.col("id").alias("vec_id"), F.round("pc1", 6).alias("pc1"), F.lit(round(float(var[0] / var.sum()), 6) if var.sum() else 0.0).alias("ev"))


def _participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    var = clouds.pca(_vectors(spark, sf_dir), "vec_id", "embedding")[1]
    rows = [(round(float(var.sum() ** 2 / (var**2).sum()), 6), round(float(var[:10].sum() / var.sum()), 6))] if var.sum() else []
    return spark.createDataFrame(rows, "participation double, share_10 double")


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = clouds.pca(_vectors(spark, sf_dir), "vec_id", "embedding")[0].where("id >= 1")
    out = scores.groupBy(F.floor(F.log10("id") + 1e-12).cast("int").alias("regime"))
    return out.agg(F.count("*").alias("k"), F.round(F.expr("regr_r2(pc1, id)"), 6).alias("r2_line"), F.round(F.expr("regr_r2(pc1, ln(id))"), 6).alias("r2_log"))


def _spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the means of pc1 in bands of ids by powers of two: fitted directly and through logarithms."""
    means = clouds.pca(_vectors(spark, sf_dir), "vec_id", "embedding")[0].where("id >= 1").groupBy(F.floor(F.log2("id") + 1e-12).cast("int").alias("band")).agg(F.avg("pc1").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gaps = np.abs(np.diff(pdf.sort_values("band")["m"].to_numpy()))
        i = np.arange(len(gaps))
        some = gaps > 0
        log = float(np.exp(np.polyfit(i[some], np.log(gaps[some]), 1)[0])) if some.sum() > 1 else float("nan")
        return pd.DataFrame({"gaps": [len(gaps)], "beta_direct": [round(clouds.direct_spacing(gaps)[0], 6)], "beta_log": [round(log, 6)]})

    return means.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "gaps long, beta_direct double, beta_log double")


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded minimisers on a series a return flag: mean price by quantity."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("series"), F.col("l_quantity").alias("u")).agg(F.avg("l_extendedprice").alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        u, y = pdf["u"].to_numpy() / 50, pdf["y"].to_numpy() / 1000
        a, b = clouds.falling_exponential(u, y[::-1])
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "beta_direct": [round(clouds.direct_spacing(y)[0], 4)], "beta_continuous": [round(clouds.continuous_spacing(u, y), 4)], "falls_from": [round(a, 4)], "rate": [round(b, 4)]})

    return rows.groupBy("series").applyInPandas(run, "series string, beta_direct double, beta_continuous double, falls_from double, rate double")


KERNELS = {
    "F20_F23_F25_curves": _curves,
    "G01_pca": _pca,
    "G04_pc1_spacing": _spacing,
    "G08_participation": _participation,
    "G09_isomap": _each_cloud(_isomap, "place int, at double"),
    "G10_robust_pca": _each_cloud(_robust, "rank int, sparse_share double"),
    "G11_regime_probe": _regimes,
    "T01_spanning_tree": _each_cloud(_tree, "place int, death double"),
    "T02_rips": _each_cloud(_diagram, "dim int, birth double, death double"),
    "T03_bars": _each_cloud(_bars, "dim int, bars int, longest double, total double, entropy double"),
    "T04_loop": _each_cloud(_loop, "longest double, second double, by_scale double"),
    "T06_velocity": _velocity,
}
