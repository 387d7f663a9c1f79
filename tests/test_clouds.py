"""The matrix and topology kernels against known shapes and brute force."""

import itertools
import math

import numpy as np
import pytest

from tallyfield.operators import clouds
from tallyfield.plans.kernels import KERNELS

SF = "/root/testdata/sf0.001"


def test_circle_has_one_loop():
    t = np.arange(60) * 2 * math.pi / 60
    deaths, loops = clouds.rips(clouds.distances(10 * np.column_stack((np.cos(t), np.sin(t)))))
    assert len(deaths) == 59 and len(loops) == 1 and loops[0][1] - loops[0][0] > 10
    with pytest.raises(ValueError):
        clouds.distances(np.zeros((clouds.MOST + 1, 2)))


def test_matching_is_the_best_of_all():
    cost = np.random.default_rng(3).random((6, 6))
    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert math.isclose(clouds.matched(cost), best)
    assert clouds.wasserstein([], []) == 0 and clouds.wasserstein([(0.0, 2.0)], []) == 1


def test_spacing_fits():
    beta, scale = clouds.direct_spacing(np.array([2.0, 4.0, 8.0]))
    assert abs(beta - 2) < 1e-4 and abs(scale - 2) < 1e-3
    assert math.isnan(clouds.direct_spacing(np.zeros(3))[0])
    u = np.linspace(0, 3, 30)
    for b in (0.5, 1.0, 1.6):
        assert abs(clouds.continuous_spacing(u, 1 + 2 * (b**u if b != 1 else u)) - b) < 1e-3
    a, b = clouds.falling_exponential(u, 3 * np.exp(-0.7 * u))
    assert abs(a - 3) < 1e-3 and abs(b - 0.7) < 1e-3


def test_low_rank_part_and_line():
    rng = np.random.default_rng(5)
    x = np.outer(rng.normal(size=30), rng.normal(size=20))
    y = x.copy()
    y[3, 4] += 9
    low, sparse = clouds.low_rank_and_sparse(y)
    assert np.abs(low - x).max() < 0.05 and np.abs(sparse).argmax() == 3 * 20 + 4
    line = np.arange(20.0)[:, None] * np.ones(3)
    assert np.all(np.diff(clouds.isomap(clouds.distances(line))) > 0)


def test_pca_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6)) * [3, 2, 1, 1, 1, 1]
    rows = [(i, x[i].tolist()) for i in range(200)]
    odd = [(500, None), (501, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (None, [0.0] * 6)]
    scores, var = clouds.pca(spark.createDataFrame(rows + odd, "k long, v array<double>"), "k", "v")
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(var, s**2 / 200)
    found = np.array([r.pc1 for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(found), np.abs(u[:, 0] * s[0]))
    assert clouds.pca(spark.createDataFrame([], "k long, v array<double>"), "k", "v")[0].count() == 0


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_queries_give_rows(spark, name):
    assert KERNELS[name](spark, SF).count() > 0
