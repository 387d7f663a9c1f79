"""Session settings that the operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where there is no other machine."""
    sc = spark.sparkContext
    set_by = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if set_by:
        return set_by
    if not sc.master.startswith("local"):
        raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return "file:///tmp/tallyfield-shared"


def ready(spark: SparkSession) -> None:
    """Have checkpoint() write to the shared folder, drop the shuffle files of finished jobs, and keep Arrow batches small."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def ranges_for(entries: int, each: int, least: int = 5) -> int:
    """log2 of the number of key ranges that hold about `each` of so many entries."""
    return max(least, math.ceil(math.log2(max(1.0, entries / each))))


def keep(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage there."""
    return df.checkpoint(eager=True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
