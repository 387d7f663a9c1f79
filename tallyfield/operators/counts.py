"""Counts of integers: (key..., n, c) tables, dense forms and their fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TOP, digit_tokens, token_value


def count_integers(docs: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """(keys..., n, c): one scan, one shuffle of partial counts."""
    tokens = docs.select(*keys, F.explode(digit_tokens(F.col(text_col))).alias("t")).select(*keys, token_value(F.col("t")).alias("n"))
    return tokens.where(F.col("n").between(0, TOP)).groupBy(*keys, "n").agg(F.count("*").alias("c"))


def zero_fill(counts: DataFrame, *keys: str, low: int = 0, high: int = TOP) -> DataFrame:
    """The dense form: a row for every n of every key."""
    grid = counts.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("n"))
    every = counts.select(*keys).distinct().crossJoin(F.broadcast(grid)) if keys else grid
    return every.join(counts, [*keys, "n"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def mle(pairs_total, log_sum, low: int = 1, high: int = TOP, rounds: int = 40):
    """The discrete power-law exponent from sum(c) and sum(c ln n): Newton steps of at most 2 from -1, as a fold."""
    logs = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.ln(n.cast("double")))
    goal = log_sum / pairs_total

    def step(a, _):
        sums = F.aggregate(logs, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")), lambda s, x: F.struct((s["z"] + F.exp(a * x)).alias("z"), (s["m"] + x * F.exp(a * x)).alias("m"), (s["q"] + x * x * F.exp(a * x)).alias("q")))
        return F.transform(F.array(sums), lambda s: a + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (goal - s["m"] / s["z"]) / (s["q"] / s["z"] - F.pow(s["m"] / s["z"], 2)))))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(-1.0), step)


def describe(counts: DataFrame, *keys: str) -> DataFrame:
    """alpha_ols, r2, matches, support, rare and saturation for each key."""
    dense = zero_fill(counts, *keys)
    n, c = F.col("n"), F.col("c")
    fitted = (n >= 1) & (c > 0)
    x, y = F.when(fitted, F.ln(n)), F.when(fitted, F.ln(c))
    mid = n.between(10, 9999)
    return dense.groupBy(*keys).agg(
        F.round(F.regr_slope(y, x), 6).alias("alpha_ols"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.sum("c").alias("integer_matches"),
        F.round(F.count_if(fitted) / 10000, 6).alias("support"), F.count_if(mid & (c < 4000)).alias("rare"), F.round(F.sum(F.when(mid, c / (c + 4000))), 6).alias("saturation"),
        F.sum(F.when(n >= 1, c)).alias("_c"), F.sum(F.when(n >= 1, c * F.ln(n))).alias("_l"),
    )
