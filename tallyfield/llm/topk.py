"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers, floor(scale * x).  Candidates are laid out in blocks,
dimension by dimension (a block's row is one dimension of many candidates).
For a block of queries, scores are accumulated one group of dimensions after
another; after each, a candidate can gain at most the product of the norms of
its own and the query's remaining dimensions (Cauchy-Schwarz), so what can't
reach the query's current k-th score is dropped and the survivors are compacted
before the next group.  Dimensions are visited in order of their mass over all
candidates, so that bounds close early.

The query set is broadcast in pieces of at most `query_bytes`, one after
another: a piece's answers are written before the next one is read, so the
driver and each executor hold one piece whatever the number of queries.  Every
piece meets every candidate block, which is the work that an exact search
states.  A task returns k rows a query and block, and a grouped top-k merges
them.

Scores are sums of doubles where these are exact (below 2**53, by the largest
components of piece and block), and else sums of integers of the width needed,
without bounds.

Behaviour: vectors that are null, of another length than the most common one,
or that hold null or non-finite components take no part; ties go to the
smaller id; repeated ids each count; a query with fewer than k candidates gets
all; a table without queries or vectors gives no rows.  A component whose
scaled floor is no long counts as the nearest long; a best score that is no
long raises OverflowError.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import fresh_path, keep, ready

#: Bytes of query vectors in one broadcast piece.
QUERY_BYTES = 4 << 20
#: Candidates in a vertical block.
BLOCK = 8192
#: Dimensions accumulated between two compactions.
STEP = 16


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, step: int = STEP, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate id, score) of each query's k best in a block of candidates.

    block is vertical: dimensions by candidates.  All sums are of integers in
    doubles; the caller has checked that they are exact.
    """
    dims = len(block)
    order = np.arange(dims) if order is None else order
    block, queries = block[order], queries[:, order]
    groups = [slice(a, min(a + step, dims)) for a in range(0, dims, step)]
    rest_c = np.sqrt(np.array([np.square(block[g.stop :]).sum(0) for g in groups]))
    rest_q = np.sqrt(np.array([np.square(queries[:, g.stop :]).sum(1) for g in groups]))
    out_q, out_i, out_s = [], [], []
    # first group for all pairs at once; then query by query over what survives
    first = queries[:, groups[0]] @ block[groups[0]]
    n = block.shape[1]
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    for q in range(len(queries)):
        partial, alive = first[q], None
        bound = None
        for i, g in enumerate(groups):
            if i:
                partial = partial + queries[q, g] @ (block[g] if alive is None else block[g, alive])
            if i == len(groups) - 1:
                break
            reach = rest_q[i, q] * (rest_c[i] if alive is None else rest_c[i, alive])
            if bound is None and len(partial) > 4 * k:
                # an exact floor for the k-th score: the best upper bounds, scored in full
                top = np.argpartition(-(partial + reach), 2 * k)[: 2 * k]
                top = top[ids[top] != own[q]]
                if len(top) >= k:
                    bound = np.partition(queries[q] @ block[:, top], len(top) - k)[len(top) - k]
            if bound is not None:
                stay = np.flatnonzero(partial + reach >= bound - 1e-6 * (1 + abs(bound)))
                if len(stay) < len(partial):
                    partial, alive = partial[stay], stay if alive is None else alive[stay]
        place = np.arange(n) if alive is None else alive
        other = ids[place] != own[q]
        place, score = place[other], partial[other]
        chosen = np.lexsort((rank[place], -score))[:k] if len(score) <= 4 * k else _top(score, rank[place], k)
        out_q.append(np.full(len(chosen), q))
        out_i.append(ids[place[chosen]])
        out_s.append(score[chosen])
    return tuple(np.concatenate(x) for x in (out_q, out_i, out_s))


def _top(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(score, len(score) - k)[len(score) - k]
    near = np.flatnonzero(score >= least)
    return near[np.lexsort((rank[near], -score[near]))[:k]]


def best_wide(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best, in the integers that the arrays hold (int64, or objects of any size): every score in full."""
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    out_q, out_i, out_s = [], [], []
    for q in range(len(queries)):
        other = np.flatnonzero(ids != own[q])
        score = (queries[q] @ block)[other]
        if score.dtype == object:
            chosen = np.array(heapq.nsmallest(k, range(len(other)), key=lambda j: (-score[j], rank[other[j]])), np.int64)
            if any(not -(1 << 63) <= score[j] < 1 << 63 for j in chosen):
                raise OverflowError("a score doesn't fit in a long; use a smaller scale")
        else:
            chosen = np.lexsort((rank[other], -score))[:k]
        out_q.append(np.full(len(chosen), q))
        out_i.append(ids[other[chosen]])
        out_s.append(score[chosen].astype(np.int64))
    return tuple(np.concatenate(x) for x in (out_q, out_i, out_s))


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def _search(pieces, k: int):
    """(id, vec) rows to each block's best for every query of the broadcast pieces."""

    def run(batches):
        import os

        os.environ.setdefault("OMP_NUM_THREADS", "1")
        q_ids, q, order = pieces.value
        held, ids, n = [], [], 0

        def block():
            vectors, names = np.concatenate(held), np.concatenate(ids)
            most = vectors.shape[1] * _largest(vectors) * _largest(q)
            kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
            vertical = np.ascontiguousarray(vectors.astype(kind).T)
            found = []
            for at in range(0, len(q), 128):
                some, own = q[at : at + 128].astype(kind), q_ids[at : at + 128]
                w, i, s = best(some, own, vertical, names, k, order=order) if kind is np.float64 else best_wide(some, own, vertical, names, k)
                found.append((at + w, i, s))
            who, what, score = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(who.astype(np.int64)), pa.array(what), pa.array(score.astype(np.int64))], names=["query_id", "place", "vec_id", "score"])

        for b in batches:
            if not len(b):
                continue
            held.append(_matrix(b.column(1)))
            ids.append(b.column(0).to_numpy())
            n += len(b)
            if n >= BLOCK:
                yield block()
                held, ids, n = [], [], 0
        if n:
            yield block()

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k candidates with the highest integer inner products for every query: (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    ready(spark)

    def whole(df: DataFrame) -> DataFrame:
        vec = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
        ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.where(ok & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))

    candidates = whole(vectors)
    sizes = candidates.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims = sizes[0]["d"]
    candidates = candidates.where(F.size("vec") == dims)
    mass = candidates.agg(*(F.sum(F.pow(F.col("vec")[i].cast("double"), 2)).alias(f"m{i}") for i in range(dims))).first()
    order = np.argsort([-x for x in mass], kind="stable")
    asked = keep(whole(queries).where(F.size("vec") == dims))
    each = max(1, query_bytes // (8 * dims))
    spread = max(1, -(-asked.count() // each))
    path, written = fresh_path(spark, "top-k"), False
    for part in range(spread):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(spread)) == part).toArrow() if spread > 1 else asked.toArrow()
        if not rows.num_rows:
            continue
        q = _matrix(rows.column("vec").combine_chunks()).astype(np.int64)
        pieces = spark.sparkContext.broadcast((rows.column("id").to_numpy(), q, order))
        near = candidates.mapInArrow(_search(pieces, k), "query_id long, place long, vec_id long, score long")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("place", "query_id").orderBy(F.desc("score"), "vec_id")))
        ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        pieces.destroy()
        written = True
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
