"""Resampling draws, and each further query against its oracle."""

import math

import duckdb
import pytest

from tallyfield import plans
from tallyfield.plans.further import FURTHER
from tallyfield.plans.more import MORE, _draws
from tallyfield.plans.sql import spell

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in plans.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(MORE | FURTHER))
def test_same_as_oracle(spark, oracle, name):
    found = plans.queries()[name](spark, SF)
    said = oracle.sql(plans.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(said.columns)
    left = sorted(tuple(r[c] for c in names) for r in found.collect())
    right = sorted(tuple(r[said.columns.index(c)] for c in names) for r in said.fetchall())
    assert len(left) == len(right) > 0
    assert all(close(a, b) for x, y in zip(left, right, strict=True) for a, b in zip(x, y, strict=True))


def test_draws_are_with_replacement(spark):
    rows = spark.sql(spell(f"WITH {_draws('40')} SELECT rep, count(DISTINCT at) AS k, count(*) AS n FROM pick GROUP BY rep", 0)).collect()
    kinds = [r.k for r in rows]
    assert {r.n for r in rows} == {40} and len(rows) == 50
    assert 0.55 < sum(kinds) / len(kinds) / 40 < 0.72  # 1 - 1/e of the rows are drawn
