"""Exact nearest neighbours of a stated set of queries among all points, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points in a packed block of candidates, and of queries: at 64 dimensions 4 MB and half of one.
BLOCK, ASKED = 8192, 1024


def _packed(size: int):
    """(id, vec) rows to (ids, flat) rows of at most `size` points."""

    def run(batches):
        ids, flat, n = [], [], 0

        def out():
            i, f = np.concatenate(ids), np.concatenate(flat)
            return pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([f.tobytes()]), pa.array([len(i)], pa.int64())], names=["ids", "flat", "n"])

        for whole in batches:
            for at in range(0, len(whole), size):
                b = whole.slice(at, size)
                if n and n + len(b) > size:
                    yield out()
                    ids, flat, n = [], [], 0
                ids.append(b.column(0).to_numpy())
                flat.append(b.column(1).flatten().to_numpy(zero_copy_only=False))
                n += len(b)
        if n:
            yield out()

    return run


def _nearest(k: int):
    """Pairs of a packed block of queries and one of candidates to each query's k nearest in it."""

    def run(batches):
        for b in batches:
            for asked_ids, asked, n, ids, flat, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q_id, c_id = np.frombuffer(asked_ids, np.int64), np.frombuffer(ids, np.int64)
                q, c = np.frombuffer(asked).reshape(n, -1), np.frombuffer(flat).reshape(m, -1)
                rough = (q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1)
                rough[q_id[:, None] == c_id] = np.inf
                out = []
                for i in range(n):
                    # all that rounding could put among the first k, then by the differences themselves
                    limit = np.partition(rough[i], min(k, m) - 1)[min(k, m) - 1]
                    near = np.flatnonzero((rough[i] <= limit + 1e-9 * (1 + (q[i] ** 2).sum())) & np.isfinite(rough[i]))
                    d = np.round(np.sqrt(((c[near] - q[i]) ** 2).sum(1)), 9)
                    first = np.lexsort((c_id[near], d))[:k]
                    out.append((np.full(len(first), q_id[i]), c_id[near][first], d[first]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "other", "d"])

    return run


def nearest(vectors: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, k, other, d): the k nearest points by Euclidean distance of every point asked about, itself left out.

    Points that are null, or hold null or non-finite numbers, or are of another
    length than the longest, take no part; equal distances go to the smaller id;
    repeated points each count.  A pair of blocks sends on k rows a query.
    """

    def points(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")

    every = points(vectors)
    width = every.agg(F.max(F.size("vec"))).first()[0] or 0
    packed = "ids binary, flat binary, n long"
    blocks = every.where(F.size("vec") == width).mapInArrow(_packed(BLOCK), packed)
    queries = points(asked).where(F.size("vec") == width).mapInArrow(_packed(ASKED), packed).toDF("q_ids", "q_flat", "q_n")
    found = queries.crossJoin(blocks).mapInArrow(_nearest(k), "id long, other long, d double")
    order = Window.partitionBy("id").orderBy("d", "other")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("id", "k", "other", "d")
