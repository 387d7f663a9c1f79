"""Resampling, further fits and geometry as SQL, spelled like those of sql.py.

Resampling draws come from a quadratic congruence of (draw, repetition), so that
every engine and every retry of a task takes the same draws.  Geometry works on
label centroids: as many points as there are labels, whatever the table's size.
"""

from __future__ import annotations

from .sql import CMP, DENSE, FAM, PART

#: Mean vector of each label, and the distances between them.
CENTRE = "cen AS (SELECT label, p, avg(x) AS v FROM {VEC} q WHERE label IS NOT NULL GROUP BY label, p)"
APART = CENTRE + ", far AS (SELECT a.label AS a, b.label AS b, sqrt(sum(power(a.v - b.v, 2))) AS d FROM cen a JOIN cen b ON a.p = b.p AND a.label <> b.label GROUP BY a.label, b.label)"
#: A series of about fifty points.
SERIES = "ser AS (SELECT CAST(p_size AS INT) AS i, CAST(avg(p_retailprice) AS DOUBLE) AS y FROM part GROUP BY 1)"


def _mixed(i: str, rep: str) -> str:
    """A whole number below 2^31 - 1 from two small ones; squared on the way, as a linear rule would only permute the rows."""
    x = f"({i} * CAST(7919 AS BIGINT) + {rep} * 104729)"
    return f"(({x} * {x} % 2147483647 * 48271 + {x}) % 2147483647)"


def _draws(n: str, reps: int = 50) -> str:
    """(rep, at): for each repetition, n draws from 0 to n - 1 with replacement."""
    return f"rep AS (SELECT CAST(n AS BIGINT) AS rep FROM {{ZERO}} z WHERE n >= 1 AND n <= {reps}), pick AS (SELECT rep, CAST({_mixed('(i.n + 1)', 'rep')} % {n} AS INT) AS at FROM rep CROSS JOIN {{ZERO}} i WHERE i.n < {n})"


CI = "round({PCT}(v, 0.025), 6) AS low, round({PCT}(v, 0.5), 6) AS mid, round({PCT}(v, 0.975), 6) AS high"

MORE: dict[str, str] = {
    # aggregation and joins
    "A02_partial_final": "WITH part0 AS (SELECT l_orderkey % 100 AS task, l_partkey AS n, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT n, CAST(sum(c) AS BIGINT) AS c FROM part0 GROUP BY n",
    "A03_missing_parts": "SELECT z.n AS task, coalesce(k.c, 0) AS c, k.c IS NULL AS missing FROM {ZERO} z LEFT JOIN (SELECT l_linenumber AS task, count(*) AS c FROM lineitem GROUP BY 1) k ON k.task = z.n WHERE z.n BETWEEN 1 AND 9",
    "A16_nan_aware": "SELECT l_returnflag, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round({PCT}(v, 0.5), 6) AS median FROM (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN l_quantity / l_discount END AS v FROM lineitem) q GROUP BY l_returnflag",
    "J01_three_way": "SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name",
    "J13_best_match": "SELECT n_name, b.best FROM nation LEFT JOIN (SELECT s_nationkey, {MAXBY}(s_suppkey, s_acctbal) AS best FROM supplier GROUP BY s_nationkey) b ON b.s_nationkey = n_nationkey",
    # fits
    "F10_regime_map": f"WITH {DENSE}, t AS (SELECT CAST(sum(c) AS DOUBLE) AS t, sum(1.0 / n) AS h, sum(exp(-0.5 * power((n - 5000.5) / 2499.75, 2))) AS g FROM den WHERE n >= 1), e AS (SELECT n, abs(ln(greatest(c / t, 1e-30) * 10000.0)) AS u, abs(ln(greatest(c / t, 1e-30) / (exp(-0.5 * power((n - 5000.5) / 2499.75, 2)) / g))) AS ga, abs(ln(greatest(c / t, 1e-30) * n * h)) AS zi FROM den CROSS JOIN t WHERE n >= 1) SELECT CASE WHEN u <= ga AND u <= zi THEN 'uniform' WHEN ga <= zi THEN 'gaussian' ELSE 'zipf' END AS regime, count(*) AS k FROM e GROUP BY 1",
    "F12_features": f"""WITH {DENSE}, t AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM den WHERE n >= 1)
SELECT CAST(sum(c) AS BIGINT) AS total, round(sum(CASE WHEN n < 10 THEN c ELSE 0 END) / max(t), 6) AS d1, round(sum(CASE WHEN n BETWEEN 10 AND 99 THEN c ELSE 0 END) / max(t), 6) AS d2,
  round(sum(CASE WHEN n BETWEEN 100 AND 999 THEN c ELSE 0 END) / max(t), 6) AS d3, round(sum(CASE WHEN n BETWEEN 1000 AND 9999 THEN c ELSE 0 END) / max(t), 6) AS d4,
  round(sum(CASE WHEN n % 10 = 0 THEN c ELSE 0 END) / max(t), 6) AS last0, round(sum(CASE WHEN n % 10 = 5 THEN c ELSE 0 END) / max(t), 6) AS last5,
  round(sum(CASE WHEN n BETWEEN 1900 AND 2025 THEN c ELSE 0 END) / max(t), 6) AS years, round(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) ELSE 0 END) / ln(10000), 6) AS entropy,
  round(max(c) / max(t), 6) AS spike, count_if(n BETWEEN 10 AND 9999 AND c < 4000) AS rare FROM den CROSS JOIN t WHERE n >= 1""",
    "F15_probe_bands": f"WITH band AS (SELECT n AS g, round(power(10, 1 + n / 3.0)) AS m FROM {{ZERO}} z WHERE n < 10), w AS (SELECT g, ceil(0.9 * m) AS lo, least(floor(1.1 * m), 10000) AS hi, floor(1.1 * m) AS whole FROM band), {PART} SELECT g, round(sum(c) * max((whole - lo + 1.0) / (hi - lo + 1.0)), 6) AS c FROM w JOIN cnt ON cnt.n BETWEEN lo AND hi GROUP BY g",
    "F18_left_out_r2": f"WITH {FAM}, f AS (SELECT a.model, max(a.y) AS y, max(a.x) AS x, regr_slope(b.y, b.x) AS s, regr_intercept(b.y, b.x) AS i FROM cell a JOIN cell b ON a.model <> b.model GROUP BY a.model) SELECT round(1 - sum(power(y - i - s * x, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(power(y - i - s * x, 2))), 4) AS rmse FROM f",
    "F19_efficient_coding": f"WITH {DENSE}, s AS (SELECT n, sum(sqrt(greatest(c, 0.5))) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS f FROM den) SELECT n, round(f, 4) AS f FROM s WHERE n IN (10, 22, 46, 100, 215, 464, 1000, 2154, 4642, 10000)",
    "F22_relative_error": "WITH m AS (SELECT p, label, avg(x) AS v FROM {VEC} q GROUP BY p, label), o AS (SELECT p, label + 1 AS i, abs(lead(v) OVER (PARTITION BY p ORDER BY label) - v) AS d FROM m), f AS (SELECT p, regr_slope(ln(greatest(d, 1e-8)), i) AS s, regr_intercept(ln(greatest(d, 1e-8)), i) AS b FROM o GROUP BY p) SELECT o.p, round(sqrt(avg(power(d - exp(b + s * i), 2))) / avg(d), 6) AS error FROM o JOIN f ON f.p = o.p WHERE d IS NOT NULL GROUP BY o.p",
    "F24_power_grid": f"WITH {SERIES}, g AS (SELECT n / 20.0 AS p FROM {{ZERO}} z WHERE n BETWEEN 1 AND 40) SELECT round(p, 2) AS p, round(regr_r2(y, power(i, p)), 6) AS r2, round(regr_slope(y, power(i, p)), 5) AS slope FROM ser CROSS JOIN g GROUP BY 1",
    "F26_line_or_step": f"""WITH {SERIES}, line AS (SELECT CAST(count(*) AS DOUBLE) AS n, (1 - regr_r2(y, i)) * var_pop(y) * count(*) AS rss FROM ser),
side AS (SELECT a.i AS cut, CASE WHEN b.i <= a.i THEN 0 ELSE 1 END AS s, var_pop(b.y) * count(*) AS rss FROM ser a CROSS JOIN ser b GROUP BY 1, 2),
step AS (SELECT cut, sum(rss) AS rss FROM side GROUP BY cut HAVING count(*) = 2)
SELECT {{MINBY}}(cut, step.rss) AS cut, round(max(n * ln(line.rss / n)) + 4, 4) AS line_aic, round(min(n * ln(step.rss / n)) + 6, 4) AS step_aic FROM step CROSS JOIN line""",
    # statistics
    "R05_ols": f"""WITH {FAM}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(x) AS vx, var_pop(z) AS vz, var_pop(y) AS vy, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM cell),
b AS (SELECT *, vx * vz - xz * xz AS det, (xy * vz - zy * xz) / (vx * vz - xz * xz) AS bx, (zy * vx - xy * xz) / (vx * vz - xz * xz) AS bz FROM s),
e AS (SELECT *, n * (vy - bx * xy - bz * zy) / (n - 3) AS s2 FROM b)
SELECT round(bx, 5) AS bx, round(bz, 4) AS bz, round(sqrt(s2 * vz / (n * det)), 5) AS se_x, round(bx / sqrt(s2 * vz / (n * det)), 4) AS t_x FROM e""",
    "R09_unit_bootstrap": f"WITH u AS (SELECT CAST(o_orderkey % 40 AS INT) AS unit, CAST(avg(o_totalprice) AS DOUBLE) AS y FROM orders GROUP BY 1), {_draws('40')}, b AS (SELECT rep, avg(y) AS v FROM pick JOIN u ON u.unit = pick.at GROUP BY rep) SELECT {CI} FROM b",
    "R10_row_bootstrap": f"WITH {FAM}, {_draws('25')}, b AS (SELECT rep, regr_slope(y, x) AS v FROM pick JOIN cell ON cell.model = pick.at GROUP BY rep) SELECT {CI} FROM b",
    "R11_task_bootstrap": f"WITH {CMP}, k AS (SELECT CAST(gap - 1 AS INT) AS task, avg(CASE WHEN fam = 'O' THEN correct * 1.0 END) - avg(CASE WHEN fam = 'F' THEN correct * 1.0 END) AS y FROM row GROUP BY 1), {_draws('7')}, b AS (SELECT rep, avg(y) AS v, count(y) AS n FROM pick JOIN k ON k.task = pick.at GROUP BY rep) SELECT {CI}, min(n) AS tasks FROM b",
    "R12_block_bootstrap": f"WITH {DENSE}, k AS (SELECT CAST(floor(n / 100) AS INT) AS block, CAST(sum(c) AS DOUBLE) AS s FROM den WHERE n < 2000 GROUP BY 1), {_draws('20')}, b AS (SELECT rep, sum(s) AS v FROM pick JOIN k ON k.block = pick.at GROUP BY rep) SELECT {CI} FROM b",
    "R13_split_half": "WITH h AS (SELECT l_partkey AS n, CAST(count(CASE WHEN l_orderkey % 2 = 0 THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN l_orderkey % 2 = 1 THEN 1 END) AS DOUBLE) AS b FROM lineitem GROUP BY 1) SELECT round(corr(a, b), 6) AS r, round(2 * corr(a, b) / (1 + corr(a, b)), 6) AS spearman_brown FROM h",
    "R14_permutations": f"WITH {FAM}, rep AS (SELECT CAST(n AS BIGINT) AS rep FROM {{ZERO}} z WHERE n <= 99), o AS (SELECT rep, family, x, y, row_number() OVER (PARTITION BY rep, family ORDER BY model) AS k, row_number() OVER (PARTITION BY rep, family ORDER BY CASE WHEN rep = 0 THEN model ELSE {_mixed('(model + 1)', 'rep')} END, model) AS j FROM cell CROSS JOIN rep), s AS (SELECT a.rep, corr(a.x, b.y) AS r FROM o a JOIN o b ON a.rep = b.rep AND a.family = b.family AND a.k = b.j GROUP BY a.rep), t AS (SELECT round(max(CASE WHEN rep = 0 THEN r END), 9) AS r0 FROM s) SELECT round(max(r0), 6) AS r, round((count_if(rep > 0 AND round(r, 9) >= r0) + 1.0) / 100, 6) AS p FROM s CROSS JOIN t",
    "R17_welch": "SELECT round((avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) - avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END)) / sqrt(var_samp(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / count(CASE WHEN l_linestatus = 'O' THEN 1 END) + var_samp(CASE WHEN l_linestatus = 'F' THEN l_quantity END) / count(CASE WHEN l_linestatus = 'F' THEN 1 END)), 5) AS z FROM lineitem",
    "R18_kendall": f"WITH {FAM} SELECT round(avg(sign((a.x - b.x) * (a.y - b.y))), 6) AS tau, count(*) AS pairs FROM cell a JOIN cell b ON a.model < b.model",
    "R19_cells": f"WITH {CMP} SELECT grp, fam, gap, count(*) AS k, round(avg(correct * 1.0), 6) AS accuracy, count(*) >= 200 AS covered FROM row GROUP BY grp, fam, gap",
    "R20_auc": f"WITH {CMP}, s AS (SELECT round(margin, 4) AS m, CAST(sum(correct) AS DOUBLE) AS pos, CAST(sum(1 - correct) AS DOUBLE) AS neg FROM row GROUP BY 1), c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) - neg AS below FROM s) SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM c",
    "R21_isotonic": f"WITH {SERIES}, seg AS (SELECT a.i AS a, b.i AS b, avg(m.y) AS v FROM ser a JOIN ser b ON a.i <= b.i JOIN ser m ON m.i BETWEEN a.i AND b.i GROUP BY a.i, b.i), low AS (SELECT s.i, seg.a, min(seg.v) AS v FROM ser s JOIN seg ON s.i BETWEEN seg.a AND seg.b GROUP BY s.i, seg.a) SELECT i, round(max(v), 5) AS fitted FROM low GROUP BY i",
    "R22_one_hot": "SELECT n, pos.n AS place, CAST(substr(lpad(CAST(z.n AS STRING), 4, '0'), pos.n, 1) AS INT) AS digit, 1 AS one FROM {ZERO} z CROSS JOIN (SELECT n FROM {ZERO} y WHERE n BETWEEN 1 AND 4) pos WHERE z.n BETWEEN 100 AND 999".replace("SELECT n,", "SELECT z.n AS n,"),
    # vectors
    "G02_pls": "WITH w AS (SELECT p, covar_pop(x, label) AS c FROM {VEC} v GROUP BY p), t AS (SELECT sqrt(sum(c * c)) AS t FROM w) SELECT p, round(c / t, 5) AS weight FROM w CROSS JOIN t",
    "G03_monotonicity": f"WITH {CENTRE}, r AS (SELECT p, label, rank() OVER (PARTITION BY p ORDER BY v) + (count(*) OVER (PARTITION BY p, v) - 1) / 2.0 AS k FROM cen) SELECT p, round(abs(corr(label, k)), 6) AS rho FROM r GROUP BY p",
    "G05_layer_choice": "WITH v AS (SELECT p, var_pop(x) AS s, abs(corr(x, label)) AS r FROM {VEC} q GROUP BY p) SELECT {MAXBY}(p, s) AS by_variance, {MAXBY}(p, sqrt(s * r)) AS by_both, {MAXBY}(p, r) AS by_order FROM v",
    "G06_fixed_layers": "SELECT p, round({PCT}(x, 0.5), 6) AS median FROM {VEC} v GROUP BY p",
    "G16_smoother": f"WITH {SERIES} SELECT a.i, round(sum(b.y * exp(-0.5 * power((a.i - b.i) / 3.0, 2))) / sum(exp(-0.5 * power((a.i - b.i) / 3.0, 2))), 5) AS smooth, round(sum(CASE WHEN a.i <> b.i THEN b.y * exp(-0.5 * power((a.i - b.i) / 3.0, 2)) END) / sum(CASE WHEN a.i <> b.i THEN exp(-0.5 * power((a.i - b.i) / 3.0, 2)) END), 5) AS left_out FROM ser a CROSS JOIN ser b GROUP BY a.i",
    "G13_intrinsic_dimension": f"WITH {APART}, o AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM far), m AS (SELECT a, max(CASE WHEN k = 5 THEN ln(d) END) * 4 - sum(CASE WHEN k < 5 THEN ln(d) END) AS s, max(CASE WHEN k = 2 THEN d END) / max(CASE WHEN k = 1 THEN d END) AS mu FROM o WHERE k <= 5 GROUP BY a) SELECT round(1 / avg(s / 4), 4) AS mle_5, round(count(*) / sum(ln(mu)), 4) AS two_nn FROM m",
    "G21_ultrametric": f"WITH {APART}, t AS (SELECT x.d AS p, y.d AS q, z.d AS r FROM far x JOIN far y ON x.b = y.a AND x.a < x.b AND y.a < y.b JOIN far z ON z.a = x.a AND z.b = y.b) SELECT round(avg((greatest(p, q, r) - (p + q + r - greatest(p, q, r) - least(p, q, r))) / greatest(p, q, r)), 6) AS violation, count(*) AS triples FROM t",
    "G24_periodic_power": f"WITH {SERIES}, per AS (SELECT n AS t FROM {{ZERO}} z WHERE n IN (2, 5, 10)), m AS (SELECT avg(y) AS m FROM ser) SELECT t, round((power(sum((y - m) * cos(2 * pi() * i / t)), 2) + power(sum((y - m) * sin(2 * pi() * i / t)), 2)) / count(*), 3) AS power FROM ser CROSS JOIN per CROSS JOIN m GROUP BY t",
    "G25_two_way": f"WITH {CMP}, c AS (SELECT grp, gap, avg(correct * 1.0) AS v FROM row GROUP BY grp, gap), e AS (SELECT v, avg(v) OVER () AS m, avg(v) OVER (PARTITION BY grp) AS a, avg(v) OVER (PARTITION BY gap) AS b FROM c) SELECT round(sum(power(a - m, 2)) / sum(power(v - m, 2)), 5) AS by_group, round(sum(power(b - m, 2)) / sum(power(v - m, 2)), 5) AS by_gap, round(sum(power(v - a - b + m, 2)) / sum(power(v - m, 2)), 5) AS rest FROM e",
    "G30_distance_effects": f"WITH {APART} SELECT round(corr(d, abs(a - b)), 6) AS distance, round(corr(d, a + b), 6) AS size, round(corr(d, (least(a, b) + 1.0) / (greatest(a, b) + 1.0)), 6) AS ratio FROM far WHERE a < b",
    "G31_group_structure": "WITH g AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS k, var_pop(value) AS v FROM events GROUP BY user_id), r AS (SELECT k, v, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rk, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv FROM g WHERE v > 0) SELECT round(0.5 * corr(rk, rv) + 0.5 * regr_slope(ln(v), ln(k)), 5) AS score FROM r",
    "G33_adjusted_rand": "WITH c AS (SELECT label AS a, CASE WHEN x >= 0 THEN 1 ELSE 0 END AS b, CAST(count(*) AS DOUBLE) AS k FROM {VEC} v WHERE p = 0 GROUP BY 1, 2), s AS (SELECT (SELECT sum(k * (k - 1) / 2) FROM c) AS ab, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(k) AS k FROM c GROUP BY a) q) AS a, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(k) AS k FROM c GROUP BY b) q) AS b, (SELECT sum(k) * (sum(k) - 1) / 2 FROM c) AS n) SELECT round((ab - a * b / n) / ((a + b) / 2 - a * b / n), 6) AS ari FROM s",
}
