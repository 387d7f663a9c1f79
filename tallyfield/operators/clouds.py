"""Matrix and topology kernels.

Tables of vectors of any length are reduced to their second moments (a matrix of
the vectors' width).  Kernels that need all points of a cloud at once run inside
applyInPandas, one cloud a group; they refuse clouds over MOST points.

Vectors that are null, of another width than the first, or that hold null or
non-finite components take no part.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that a cloud may have; its kernels hold all distances, the topology all triangles.
MOST = 120


def finite(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part."""
    out = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return out.where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")


def second_moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariance of (ln(id + 1), vec) of the vectors of the commonest length; what is collected grows with the width alone."""
    common = points.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    width = common.d + 1

    def sums(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            if len(b):
                x = np.column_stack((np.ones(len(b)), np.log(b["id"].to_numpy(float) + 1), np.stack(b["vec"].to_numpy())))
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    rows = points.where(F.size("vec") == width - 1).mapInPandas(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((width + 1) ** 2)
    for r in rows:
        m[r["at"]] = r["s"]
    m = m.reshape(width + 1, width + 1)
    n = int(m[0, 0])
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def pca(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray]:
    """(id, pc1) and all variances, falling.  pc1 rises with ln(id + 1)."""
    points = finite(vectors, id_col, vec_col)
    n, mean, cov = second_moments(points)
    if not n:
        return points.select("id", F.lit(0.0).alias("pc1")), np.zeros(0)
    values, axes = np.linalg.eigh(cov[1:, 1:])
    axis = axes[:, -1] * (1 if axes[:, -1] @ cov[0, 1:] >= 0 else -1)
    along = F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(x)) for x in axis)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return points.where(F.size("vec") == len(axis)).select("id", (along - float(axis @ mean[1:])).alias("pc1")), np.maximum(values[::-1], 0)


def lowest(f, lo: float, hi: float, steps: int = 400) -> float:
    """The argument of f's smallest value on [lo, hi]: a grid, then golden sections about its best point."""
    grid = np.linspace(lo, hi, steps)
    at = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(0, at - 1)], grid[min(steps - 1, at + 1)]
    r = (math.sqrt(5) - 1) / 2
    while b - a > 1e-10:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if f(c) <= f(d) else (c, b)
    return (a + b) / 2


def _profile(basis, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Squares left, coefficients and fit of the least-squares fit of y on the basis' columns."""
    coef = np.linalg.lstsq(basis, y, rcond=None)[0]
    fit = basis @ coef
    return float(((y - fit) ** 2).sum()), coef, fit


def direct_spacing(gaps: np.ndarray) -> tuple[float, float]:
    """(beta, scale) of gaps i = scale * beta**i; NaN for under two gaps, non-finite or all zero ones."""
    if len(gaps) < 2 or not np.isfinite(gaps).all() or not gaps.any():
        return math.nan, math.nan
    i = np.arange(len(gaps))
    t = lowest(lambda t: _profile(np.exp(t * i - max(t * i[-1], 0))[:, None], gaps)[0], -8, 8)
    return math.exp(t), float(_profile(np.exp(t * i)[:, None], gaps)[1][0])


def continuous_spacing(u: np.ndarray, y: np.ndarray) -> float:
    """beta of y = a + s * beta**u; beta within 1e-6 of 1 stands for a straight line."""
    if len(y) < 3 or not np.isfinite(y).all():
        return math.nan

    def left(t):
        return _profile(np.column_stack((np.ones(len(u)), np.expm1(t * u) / t if abs(t) > 1e-6 else u)), y)[0]

    return math.exp(lowest(left, -6, 6))


def falling_exponential(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b), both at least 0, of y = a * exp(-b * x)."""
    if len(y) < 2 or not np.isfinite(y).all():
        return math.nan, math.nan

    def scale(b):
        e = np.exp(-b * x)
        return max(0.0, float(e @ y / (e @ e)))

    t = lowest(lambda b: float(((y - scale(b) * np.exp(-b * x)) ** 2).sum()), 0, 20 / max(float(np.ptp(x)), 1e-9))
    return scale(t), t


def distances(x: np.ndarray) -> np.ndarray:
    if len(x) > MOST:
        raise ValueError(f"a cloud of {len(x)} points; at most {MOST}")
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def rips(d: np.ndarray) -> tuple[list[float], list[tuple[float, float]]]:
    """Deaths of the components (the spanning tree's edges, rising), and (birth, death) of the loops, of the Rips filtration of d."""
    n = len(d)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i))
    rank = {(i, j): k for k, (_, i, j) in enumerate(edges)}
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    deaths = []
    for v, i, j in edges:
        a, b = top(i), top(j)
        if a != b:
            root[a] = b
            deaths.append(float(v))
    triangles = sorted((max(q), q) for i in range(n) for j in range(i) for k in range(j) for q in [(rank[i, j], rank[i, k], rank[j, k])])
    pivots: dict[int, int] = {}
    loops = []
    for last, q in triangles:
        column = sum(1 << k for k in q)  # a column over Z2 as the bits of an integer
        while column and (low := column.bit_length() - 1) in pivots:
            column ^= pivots[low]
        if column:
            pivots[low] = column
            if edges[last][0] > edges[low][0]:
                loops.append((float(edges[low][0]), float(edges[last][0])))
    return deaths, sorted(loops)


def matched(cost: np.ndarray) -> float:
    """The smallest total of one entry in each row and column (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v, of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        best, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while of[j]:
            used[j] = True
            free = np.flatnonzero(~used)
            now = cost[of[j] - 1, free - 1] - u[of[j]] - v[free]
            better = now < best[free]
            best[free[better]], back[free[better]] = now[better], j
            k = free[np.argmin(best[free])]
            step = best[k]
            u[of[used]] += step
            v[used] -= step
            best[~used] -= step
            j = k
        while j:
            of[j] = of[back[j]]
            j = back[j]
    return float(cost[of[1:] - 1, np.arange(n)].sum()) if n else 0.0


def wasserstein(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Wasserstein-1 of two diagrams, with the largest coordinate's difference as ground distance; points may go to the diagonal."""
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    for i in range(n):
        cost[i, m:] = (a[i][1] - a[i][0]) / 2
        for j in range(m):
            cost[i, j] = max(abs(a[i][0] - b[j][0]), abs(a[i][1] - b[j][1]))
    for j in range(m):
        cost[n:, j] = (b[j][1] - b[j][0]) / 2
    return matched(cost)


def isomap(d: np.ndarray, k: int = 3) -> np.ndarray:
    """One coordinate a point from the paths in the graph of k neighbours; k grows until the graph is connected."""
    n = len(d)
    g = np.full((n, n), np.inf)
    while True:
        near = np.argsort(d, axis=1, kind="stable")[:, : min(n, k + 1)]
        for i in range(n):
            g[i, near[i]] = g[near[i], i] = d[i, near[i]]
        paths = g.copy()
        np.fill_diagonal(paths, 0)
        for m in range(n):
            paths = np.minimum(paths, paths[:, m : m + 1] + paths[m : m + 1])
        if np.isfinite(paths).all() or k >= n:
            break
        k += 1
    c = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-c @ paths**2 @ c / 2)
    axis = axes[:, -1] * math.sqrt(max(values[-1], 0))
    return axis * (1 if axis[-1] >= axis[0] else -1)


# Fixed values, as Lin, Chen and Ma give them for the inexact method: first penalty over the spectral norm, its growth, and the residual at which to stop.
PENALTY, GROWTH, RESIDUAL = 1.25, 1.5, 1e-7


def low_rank_and_sparse(x: np.ndarray, most_rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit (Candes, Li, Ma and Wright 2011): the low-rank and the sparse part whose nuclear norm and weighted absolute sum are least.

    Solved by the inexact augmented Lagrange multiplier method (Lin, Chen and Ma 2010), with a penalty that grows.
    """
    scale = np.linalg.norm(x)
    if not scale:
        return x.copy(), np.zeros_like(x)
    weight = max(x.shape) ** -0.5
    spectral = np.linalg.norm(x, 2)
    multiplier = x / max(spectral, np.abs(x).max() / weight)
    penalty, top = PENALTY / spectral, 1e7 * PENALTY / spectral
    low = np.zeros_like(x)
    for _ in range(most_rounds):
        open_part = x - low + multiplier / penalty
        sparse = open_part - np.clip(open_part, -weight / penalty, weight / penalty)
        left, values, right = np.linalg.svd(x - sparse + multiplier / penalty, full_matrices=False)
        rank = int((values > 1 / penalty).sum())
        low = left[:, :rank] * (values[:rank] - 1 / penalty) @ right[:rank]
        gap = x - low - sparse
        if np.linalg.norm(gap) < RESIDUAL * scale:
            break
        multiplier = multiplier + penalty * gap
        penalty = min(GROWTH * penalty, top)
    return low, sparse
