"""Queries over whole tables, with the oracle's statement of each apart from Spark's.

Running sums and ranks over a table, or over all rows of one source, take two
steps: blocks of neighbouring rows are added up, a window over the blocks gives
each its start, and a window within the block does the rest, so that no task
sorts a whole table or source.

tests/test_whole.py holds the first of them against brute force as well.
"""

from __future__ import annotations

from .further import _DRAW
from .more import CI, _draws
from .sql import DENSE, UNIT, spell

#: Ids in a block.
_BLOCK = 4096


def _starts(weight: str, by: str = "") -> str:
    """t: for each block r of u (and source, with by), the weight in it (s) and before it (at)."""
    each = f"{by}, r" if by else "r"
    part = f"PARTITION BY {by} " if by else ""
    return f"t AS (SELECT {each}, sum({weight}) AS s, sum(sum({weight})) OVER ({part}ORDER BY r ROWS UNBOUNDED PRECEDING) - sum({weight}) AS at FROM u GROUP BY {each})"


WHOLE: dict[str, str] = {
    # a running sum over the distinct values instead of one sort of all rows
    "W05_average_rank": "WITH k AS (SELECT l_quantity, count(*) AS c FROM lineitem GROUP BY l_quantity), s AS (SELECT l_quantity, sum(c) OVER (ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) - c + 1 + (c - 1) / 2.0D AS r FROM k) SELECT /*+ BROADCAST(s) */ l_orderkey, l_linenumber, s.r FROM lineitem l JOIN s ON l.l_quantity <=> s.l_quantity",
    # offsets summed over ranges of ids, then within each; every document makes its own chunks
    "M12_chunk_to_file": f"WITH {UNIT}, u AS (SELECT doc_id, CAST(floor(size / 2048) AS BIGINT) AS k, floor(doc_id / 4096) AS r FROM unit), t AS (SELECT r, sum(sum(k)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) - sum(k) AS before FROM u GROUP BY r), o AS (SELECT u.doc_id, k, before + sum(k) OVER (PARTITION BY u.r ORDER BY u.doc_id ROWS UNBOUNDED PRECEDING) - k AS lo FROM u JOIN t ON u.r <=> t.r) SELECT CAST(lo + j AS BIGINT) AS chunk, doc_id, CAST(j * 2048 AS BIGINT) AS start FROM (SELECT doc_id, lo, explode(sequence(CAST(0 AS BIGINT), k - 1)) AS j FROM o WHERE k > 0) q",
    # all of the dense table
    "P27_log_guards": f"WITH {DENSE} SELECT n, round(ln(greatest(c, 0.5)), 6) AS a, round(ln(c + 1), 6) AS b FROM den",
    "W08_sliding_mean": f"WITH {DENSE} SELECT n, round(avg(c) OVER (ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM den",
    "F08_null_models": f"WITH {DENSE}, t AS (SELECT CAST(sum(c) AS DOUBLE) AS t FROM den WHERE n >= 1), g AS (SELECT n, exp(-0.5 * power((n - 5000.5) / 2499.75, 2)) AS g, 1.0 / n AS z FROM den WHERE n >= 1), s AS (SELECT sum(g) AS sg, sum(z) AS sz FROM g) SELECT n, round(t / 10000, 6) AS uniform, round(t * g / sg, 6) AS gaussian, round(t * z / sz, 6) AS zipf FROM g CROSS JOIN t CROSS JOIN s",
    # 0 to 10000 are 101 blocks, the last of one number
    "R12_block_bootstrap": f"WITH {DENSE}, k AS (SELECT CAST(floor(n / 100) AS INT) AS block, CAST(sum(c) AS DOUBLE) AS s FROM den GROUP BY 1), {_draws('101')}, b AS (SELECT rep, sum(s) AS v FROM pick JOIN k ON k.block = pick.at GROUP BY rep) SELECT {CI} FROM b",
    "M03_size_proportional": f"WITH {UNIT}, u AS (SELECT doc_id, size, floor(doc_id / {_BLOCK}) AS r FROM unit), {_starts('size')}, a AS (SELECT sum(size) AS tot, count(*) AS units FROM u), d AS (SELECT n AS draw, ((CAST(n AS BIGINT) * 1103515245 + 12345) % 2147483648) / 2147483648.0 AS x FROM {{ZERO}} z WHERE n < 200), hit AS (SELECT /*+ BROADCAST(d), BROADCAST(a) */ draw, x, tot, units, t.r, t.at FROM t CROSS JOIN a JOIN d ON x * tot >= t.at AND x * tot < t.at + s), w AS (SELECT u.doc_id, u.size, u.r, sum(u.size) OVER (PARTITION BY u.r ORDER BY u.doc_id ROWS UNBOUNDED PRECEDING) AS hi FROM u LEFT SEMI JOIN hit ON u.r <=> hit.r) SELECT CAST(draw AS INT) AS draw, doc_id, round(CAST(tot AS DOUBLE) / units / size, 6) AS weight FROM hit h JOIN w ON h.r <=> w.r AND x * tot >= h.at + hi - size AND x * tot < h.at + hi",
    "M04_budget_prefix": f"WITH {UNIT}, u AS (SELECT doc_id, size, (doc_id * 69069 + 1) % 4294967296 AS h, floor((doc_id * 69069 + 1) % 4294967296 / 65536) AS r FROM unit), {_starts('size')}, o AS (SELECT u.doc_id, u.size, t.at + sum(u.size) OVER (PARTITION BY u.r ORDER BY u.h, u.doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM u JOIN t ON u.r <=> t.r WHERE t.at < 200000) SELECT doc_id, size FROM o WHERE cum - size < 200000",
    "M05_two_stage_order": f"WITH {UNIT}, u AS (SELECT source, doc_id, (doc_id * 69069 + 1) % 4294967296 AS h, floor((doc_id * 69069 + 1) % 4294967296 / 1048576) AS r FROM unit), {_starts('1', 'source')} SELECT u.source, u.doc_id, CAST(t.at + row_number() OVER (PARTITION BY u.source, u.r ORDER BY u.h, u.doc_id) AS INT) AS place FROM u JOIN t ON u.source <=> t.source AND u.r <=> t.r",
    "M07_coverage_windows": f"WITH u AS (SELECT source, doc_id, n_chars + 2047 AS w, floor(doc_id / {_BLOCK}) AS r FROM documents), {_starts('w', 'source')}, d AS (SELECT source, j, (j * 1664525 + 1013904223) % total AS x FROM (SELECT source, sum(w) AS total FROM u GROUP BY source) q CROSS JOIN {_DRAW} y), hit AS (SELECT d.source, j, x, t.r, t.at FROM d JOIN t ON d.source = t.source AND x >= t.at AND x < t.at + s), f AS (SELECT u.source, u.r, u.doc_id, u.w, sum(u.w) OVER (PARTITION BY u.source, u.r ORDER BY u.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM u LEFT SEMI JOIN hit ON u.source = hit.source AND u.r = hit.r) SELECT h.source, CAST(h.j AS INT) AS draw, f.doc_id, CAST(h.x - (h.at + f.hi - f.w) - 2047 AS BIGINT) AS start_at FROM hit h JOIN f ON h.source = f.source AND h.r = f.r AND h.x >= h.at + f.hi - f.w AND h.x < h.at + f.hi",
    "M10_chunk_offsets": f"WITH {UNIT}, u AS (SELECT doc_id, CAST(floor(size / 2048) AS BIGINT) AS k, floor(doc_id / {_BLOCK}) AS r FROM unit), {_starts('k')} SELECT u.doc_id, k AS chunks, CAST(t.at + sum(k) OVER (PARTITION BY u.r ORDER BY u.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM u JOIN t ON u.r <=> t.r",
    "M15_stratum_shuffle": f"WITH u AS (SELECT source, doc_id, md5(concat('7|', source, '|', CAST(doc_id AS STRING))) AS h, substr(md5(concat('7|', source, '|', CAST(doc_id AS STRING))), 1, 3) AS r FROM documents), {_starts('1', 'source')} SELECT u.source, u.doc_id, CAST(t.at + row_number() OVER (PARTITION BY u.source, u.r ORDER BY u.h, u.doc_id) AS INT) AS place FROM u JOIN t ON u.source <=> t.source AND u.r <=> t.r",
    "M17_fractional_prefix": f"WITH {UNIT}, u AS (SELECT source, doc_id, size, floor(doc_id / {_BLOCK}) AS r FROM unit), {_starts('size', 'source')}, o AS (SELECT u.source, u.doc_id, u.size, t.at + sum(u.size) OVER (PARTITION BY u.source, u.r ORDER BY u.doc_id ROWS UNBOUNDED PRECEDING) - u.size AS before FROM u JOIN t ON u.source <=> t.source AND u.r <=> t.r WHERE t.at < 30000) SELECT source, doc_id, round(least(1.0, greatest(0.0, (30000.0 - before) / size)), 6) AS w FROM o WHERE before < 30000",
    "P10_tokens_per_byte": f"WITH u AS (SELECT source, doc_id, text, floor(doc_id / {_BLOCK}) AS r FROM documents), {_starts('1', 'source')}, n AS (SELECT source, doc_id, r, row_number() OVER (PARTITION BY source, r ORDER BY doc_id) - 1 AS i, length(text) - length(replace(text, ' ', '')) + 2 AS tokens, {{BYTES}} AS size FROM u) SELECT n.source, count(*) AS sampled, round(CAST(sum(tokens) AS DOUBLE) / sum(size), 6) AS ratio FROM n JOIN t ON n.source <=> t.source AND n.r <=> t.r WHERE (t.at + i) % 50 = 0 GROUP BY n.source",
    "P26_min_max": "SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS v FROM part CROSS JOIN (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) b",
    # equal p values share the last of their places, so the windows run over the distinct ones
    "R16_benjamini_hochberg": "WITH v AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1000 + 0.5D) / 1000 * (p_partkey % 10 + 1) / 10 AS p FROM part), g AS (SELECT p, count(*) AS c FROM v GROUP BY p), k AS (SELECT p, sum(c) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS k, sum(c) OVER () AS m FROM g), q AS (SELECT p, least(1.0D, min(p * m / k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k) SELECT v.id, round(q.q, 6) AS q FROM v JOIN q ON v.p = q.p",
    "X04_answer_letters": f"WITH u AS (SELECT item_id, floor(item_id / {_BLOCK}) AS r FROM benchmark), {_starts('1')} SELECT u.item_id, substr('ABCD', CAST((t.at + row_number() OVER (PARTITION BY u.r ORDER BY u.item_id) - 1) % 4 AS INT) + 1, 1) AS letter FROM u JOIN t ON u.r <=> t.r",
}

#: The oracle's SQL of these queries: windows over all rows where Spark sums in two steps.
ORACLE: dict[str, str] = {
    "W05_average_rank": "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem",
    "M12_chunk_to_file": "WITH o AS (SELECT doc_id, octet_length(encode(text)) // 2048 AS k, sum(octet_length(encode(text)) // 2048) OVER (ORDER BY doc_id NULLS FIRST) - octet_length(encode(text)) // 2048 AS lo FROM documents WHERE octet_length(encode(text)) >= 2048) SELECT CAST(lo + j AS BIGINT) AS chunk, doc_id, CAST(j * 2048 AS BIGINT) AS start FROM (SELECT doc_id, lo, unnest(range(k)) AS j FROM o) q",
    "J11_knn": "WITH d AS (SELECT a.vec_id, b.vec_id AS other, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM d) SELECT vec_id, CAST(k AS INT) AS k, other, round(d, 6) AS d FROM r WHERE k <= 5",
    "G12_knn_labels": "WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS same FROM d WHERE k <= 10",
} | {name: spell(WHOLE[name], 1) for name in ("P27_log_guards", "W08_sliding_mean", "F08_null_models", "R12_block_bootstrap")}
