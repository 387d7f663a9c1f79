"""Document windows, orders, draws and prompt generators as SQL, spelled like those of sql.py.

Draws and shuffles come from fixed congruences or hashes, so that both engines
and every retry of a task take the same ones.  Windows are partitioned by source.
"""

from __future__ import annotations

from .sql import PART, UNIT

_PERMUTED = UNIT + ", o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 69069 + 1) % 4294967296, doc_id) AS place FROM unit)"
_DRAW = "(SELECT CAST(n AS BIGINT) AS j FROM {ZERO} z WHERE n BETWEEN 1 AND 200)"
#: Turns of a conversation as a token window; an assistant turn ends a document.
_CUT = "p AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS k FROM conversations), e AS (SELECT conv_id, max(k) AS most FROM p GROUP BY conv_id), s AS (SELECT p.conv_id, k, most, count(*) AS tokens FROM p JOIN e ON p.conv_id = e.conv_id WHERE role <> 'assistant' GROUP BY p.conv_id, k, most)"
#: (dist, n, hi): upper ends of the cumulative shares of each weighting over 1..9999.
_WEIGHTS = PART + ", w AS (SELECT 'zipf' AS dist, n, 1000000000 {DIV} n AS w FROM {ZERO} z WHERE n BETWEEN 1 AND 9999 UNION ALL SELECT 'corpus', n, CAST(c AS BIGINT) FROM cnt WHERE n BETWEEN 1 AND 9999), h AS (SELECT dist, n, CAST(w AS BIGINT) AS w, CAST(sum(w) OVER (PARTITION BY dist ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi, CAST(sum(w) OVER (PARTITION BY dist) AS BIGINT) AS total FROM w)"
_UNIFORM = "u AS (SELECT j, ((j * 7919 + 13) % 10007) / 10007.0D AS u, ((j * 104729 + 7) % 10009) / 10009.0D AS v FROM " + _DRAW + " d)"
_PAIR = "pair AS (SELECT g.gap, z.n AS a, z.n + g.gap AS b FROM {ZERO} z JOIN (SELECT 1 AS gap UNION ALL SELECT 10 UNION ALL SELECT 100) g ON z.n BETWEEN 100 AND 999 - g.gap)"

FURTHER: dict[str, str] = {
    "M05_two_stage_order": f"WITH {_PERMUTED} SELECT source, doc_id, CAST(place AS INT) AS place FROM o",
    "M06_two_stage_weight": f"WITH {_PERMUTED}, k AS (SELECT source, count(*) AS units, CAST(sum(size) AS BIGINT) AS bytes FROM unit GROUP BY source) SELECT o.source, k.units, count(*) AS taken, round(CAST(sum(size) AS DOUBLE) * k.units / count(*), 4) AS estimate, k.bytes FROM o JOIN k ON o.source = k.source WHERE place <= 5 GROUP BY o.source, k.units, k.bytes",
    "M07_coverage_windows": "WITH f AS (SELECT source, doc_id, n_chars + 2047 AS w, CAST(sum(n_chars + 2047) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi, CAST(sum(n_chars + 2047) OVER (PARTITION BY source) AS BIGINT) AS total FROM documents), d AS (SELECT source, j, (j * 1664525 + 1013904223) % total AS u FROM (SELECT DISTINCT source, total FROM f) q CROSS JOIN " + _DRAW + " x) SELECT d.source, CAST(d.j AS INT) AS draw, f.doc_id, CAST(d.u - (f.hi - f.w) - 2047 AS BIGINT) AS start_at FROM d JOIN f ON f.source = d.source AND d.u >= f.hi - f.w AND d.u < f.hi",
    "M08_document_split": f"WITH {_CUT} SELECT conv_id, k, tokens, k > 0 AND k < most AS whole FROM s",
    "M09_edge_modes": f"WITH {_CUT} SELECT conv_id, count(*) AS kept_docs, CAST(sum(tokens) AS BIGINT) AS kept_tokens, count_if(k > 0 AND k < most) AS whole_docs, CAST(sum(CASE WHEN k > 0 AND k < most THEN tokens ELSE 0 END) AS BIGINT) AS whole_tokens FROM s GROUP BY conv_id",
    "M15_stratum_shuffle": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(concat('7|', source, '|', CAST(doc_id AS STRING))), doc_id) AS INT) AS place FROM documents",
    "M23_component_draw": f"WITH {UNIT}, k AS (SELECT source, CAST(sum(size) AS BIGINT) AS w FROM unit GROUP BY source), h AS (SELECT source, w, CAST(sum(w) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi FROM k), t AS (SELECT max(hi) AS total FROM h) SELECT h.source, count(*) AS draws FROM (SELECT (j * 179424673 + 13) % total AS u FROM {_DRAW} d CROSS JOIN t) d JOIN h ON d.u >= h.hi - h.w AND d.u < h.hi GROUP BY h.source",
    "M24_distribution_draw": f"WITH {_WEIGHTS}, {_UNIFORM} SELECT dist, CAST(j AS INT) AS draw, n FROM (SELECT h.dist, d.j, h.n FROM (SELECT q.dist, j, (j * 179424673 + 13) % total AS u FROM {_DRAW} x CROSS JOIN (SELECT DISTINCT dist, total FROM h) q) d JOIN h ON d.dist = h.dist AND d.u >= h.hi - h.w AND d.u < h.hi UNION ALL SELECT 'uniform', j, CAST(1 + floor(u * 9999) AS INT) FROM u UNION ALL SELECT 'decay', j, CAST(least(9999, 1 + floor(-1000 * ln(1 - u))) AS INT) FROM u UNION ALL SELECT 'growth', j, CAST(greatest(1, 9999 - floor(-1000 * ln(1 - u))) AS INT) FROM u UNION ALL SELECT 'gauss', j, CAST(least(9999, greatest(1, floor(5000 + 1500 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)))) AS INT) FROM u) q",
    "X01_prompts": "SELECT n, concat('The number ', CAST(n AS STRING)) AS numeral, CASE WHEN n BETWEEN 1000 AND 2025 THEN concat('In the year ', CAST(n AS STRING)) END AS year_prompt FROM {ZERO} z",
    "X02_comparisons": f"WITH {_PAIR} SELECT concat(CAST(gap AS STRING), ':', CAST(a AS STRING), ':', o.ord, ':', q.query) AS item, gap, CASE WHEN o.ord = 'up' THEN a ELSE b END AS a_value, CASE WHEN o.ord = 'up' THEN b ELSE a END AS b_value, CASE WHEN (o.ord = 'up') = (q.query = 'larger') THEN 'B' ELSE 'A' END AS correct_key FROM pair CROSS JOIN (SELECT 'up' AS ord UNION ALL SELECT 'down') o CROSS JOIN (SELECT 'larger' AS query UNION ALL SELECT 'smaller') q",
    "X03_few_shot": f"WITH {_PAIR}, s AS (SELECT gap, a, b, concat('Q: ', CAST(a AS STRING), ' or ', CAST(b AS STRING), '? A: ', CAST(b AS STRING)) AS shot FROM pair) SELECT gap, a, lag(shot, 2) OVER (PARTITION BY gap ORDER BY a) || ' ' || lag(shot, 1) OVER (PARTITION BY gap ORDER BY a) || ' Q: ' || CAST(a AS STRING) || ' or ' || CAST(b AS STRING) || '? A:' AS prompt FROM s",
    "X04_answer_letters": "SELECT item_id, substr('ABCD', CAST((row_number() OVER (ORDER BY item_id) - 1) % 4 AS INT) + 1, 1) AS letter FROM benchmark",
}
