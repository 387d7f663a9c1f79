"""The counting rule, fits, and the oracle on the smallest tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallyfield import plans
from tallyfield.functions.tokens import digit_tokens
from tallyfield.operators.counts import count_integers, describe, mle, zero_fill

SF = "/root/testdata/sf0.001"


def counted(spark, text):
    return {r.n: r.c for r in count_integers(spark.createDataFrame([(text,)], "text string")).collect()}


def test_counting_rule(spark):
    """Leading zeros, the top and one beyond it, digits in words, both sides of a point, and repeats."""
    text = "room 0042, or 42; year_1987 1987. 12,000 -6 6.0625 v2 10001 10000 000"
    assert counted(spark, text) == {42: 2, 1987: 1, 12: 1, 0: 2, 6: 2, 625: 1, 10000: 1}


def test_unicode_boundaries(spark):
    row = spark.createDataFrame([("é5 5é ٣ １２ x²3 5́ 7 _9 a1 3_ 00",)], "text string").select(digit_tokens(F.col("text")).alias("t")).first()
    assert row.t == ["٣", "１２", "5", "7", "00"]


@pytest.mark.parametrize("text", [None, "", "no digits", "9" * 40])
def test_nothing_to_count(spark, text):
    assert counted(spark, text) == {}


@pytest.mark.parametrize(("n", "c", "rare"), [(10, 3999, True), (10, 4000, False), (9, 0, False), (9999, 0, True), (10000, 0, False), (5000, 3999, True)])
def test_rare_counts_of_one_number(spark, n, c, rare):
    """Only numbers of two to four digits count as rare, below 4000 occurrences."""
    base = spark.range(0, 10001).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") == n, c).otherwise(4000 + F.col("id")).cast("long").alias("c"))
    assert describe(base).first().rare == int(rare)


def test_zero_fill(spark):
    filled = zero_fill(spark.createDataFrame([(3, 8), (70, 1)], "n int, c long")).collect()
    assert len(filled) == 10001 and {r.n: r.c for r in filled if r.c} == {3: 8, 70: 1}


def test_mle_recovers_exponent(spark):
    counts = [round(2e7 * n**-1.3 / sum(k**-1.3 for k in range(1, 10001))) for n in range(1, 10001)]
    total, logs = sum(counts), sum(c * math.log(n) for n, c in enumerate(counts, 1))
    found = spark.range(1).select(mle(F.lit(float(total)), F.lit(logs)).alias("a")).first().a
    assert abs(found + 1.3) < 2e-3


def test_flagship(spark):
    rows = {r.corpus: r for r in plans.flagship(spark, SF).collect()}
    assert set(rows) == {"documents", "pages"} and all(r.alpha_mle < 0 for r in rows.values())


def normal(v):
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["P01_count_text", "A04_rollups", "F01_alpha_ols", "W02_cumulative", "R16_benjamini_hochberg", "M17_fractional_prefix", "G14_norms", "L01_streamed_counts"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in plans.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = plans.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    found = con.sql(plans.oracle_sql()[name])
    at = [found.columns.index(c) for c in cols]
    want = sorted(repr([normal(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([normal(r[c]) for c in cols]) for r in frame.collect()) == want
