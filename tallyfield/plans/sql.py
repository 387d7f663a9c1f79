"""Queries as SQL.  Each runs on Spark, and on the oracle engine with that engine's spelling of a few functions."""

from __future__ import annotations

import re

#: Spellings: (Spark, oracle).
SPELL = {
    "TOK": (r"filter(split(text, '[^\\p{L}\\p{N}_]+'), x -> x rlike '^\\p{Nd}+$')", r"list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{Nd}+'))"),
    "TOKL": (r"filter(split(lower(text), '[^\\p{L}\\p{N}_]+'), x -> x rlike '^\\p{Nd}+$')", r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '\p{Nd}+'))"),
    "EXPL": ("explode", "unnest"),
    "LZ": ("ltrim('0', t)", "ltrim(t, '0')"),
    "ZERO": ("(SELECT CAST(id AS INT) AS n FROM range(0, 10001))", "(SELECT CAST(range AS INT) AS n FROM range(0, 10001))"),
    "BYTES": ("octet_length(text)", "octet_length(encode(text))"),
    "PCT": ("percentile", "quantile_cont"),
    "REVEN": ("bround", "round_even"),
    "FIRSTINT": ("regexp_extract(text, '[-+]?[0-9]+', 0)", "regexp_extract(text, '[-+]?[0-9]+', 0)"),
    "SHA": ("sha2(text, 256)", "sha256(text)"),
    "MINBY": ("min_by", "arg_min"),
    "MAXBY": ("max_by", "arg_max"),
    "SEQ": ("sequence", "generate_series"),
    "DIV": ("div", "//"),
    "COUNTIF": ("count_if", "count_if"),
    "REP": (r"rlike '^([0-9])\\1+$'", "IS NOT NULL AND length(replace(s, left(s, 1), '')) = 0 AND length(s) > 1"),
    "VEC": ("(SELECT vec_id, label, p, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) AS p, x)", "(SELECT vec_id, label, CAST(i - 1 AS INT) AS p, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"),
    "DOT": ("aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)", "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"),
    "HOUR": ("date_trunc('HOUR', ts)", "date_trunc('hour', ts)"),
}

NVAL = "CASE WHEN {LZ} = '' THEN 0 WHEN length({LZ}) <= 5 THEN CAST({LZ} AS INT) END"
#: (source, n, c) over digit tokens of documents; (n, c) of a well-filled integer column, and its dense form.
TOKENS = "tok AS (SELECT doc_id, lang, source, {EXPL}({TOK}) AS t FROM documents), num AS (SELECT *, " + NVAL + " AS n FROM tok)"
PART = "cnt AS (SELECT CAST(l_partkey AS INT) AS n, count(*) AS c FROM lineitem WHERE l_partkey BETWEEN 0 AND 10000 GROUP BY 1)"
DENSE = PART + ", den AS (SELECT z.n, coalesce(cnt.c, 0) AS c FROM {ZERO} z LEFT JOIN cnt ON cnt.n = z.n)"
PRICE = "cnt AS (SELECT CAST(floor(o_totalprice / 50) AS INT) AS n, count(*) AS c FROM orders GROUP BY 1 HAVING n BETWEEN 0 AND 10000)"
FAM = "cell AS (SELECT n_nationkey AS model, n_regionkey AS family, CAST(avg(c_acctbal) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS z, CAST(max(c_acctbal) - avg(c_acctbal) / 2 AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
CMP = "row AS (SELECT l_orderkey AS item, l_returnflag AS grp, l_linenumber AS gap, l_linestatus AS fam, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS correct, l_discount - l_tax AS margin FROM lineitem)"
UNIT = "unit AS (SELECT source, doc_id, CAST({BYTES} AS BIGINT) AS size FROM documents)"
B = "CAST(%s AS BIGINT) AS %s"

QUERIES: dict[str, str] = {
    # extraction
    "P01_count_text": f"WITH {TOKENS} SELECT n, count(*) AS c FROM num WHERE n <= 10000 GROUP BY n",
    "P02_count_digit_tokens": f"WITH {TOKENS} SELECT t AS token, count(*) AS c FROM tok GROUP BY t",
    "P03_filter_to_range": f"WITH {TOKENS}, raw AS (SELECT t, count(*) AS k FROM tok GROUP BY t) SELECT n, CAST(sum(k) AS BIGINT) AS c FROM (SELECT {NVAL} AS n, k FROM raw) q WHERE n BETWEEN 1 AND 9999 GROUP BY n",
    "P04_lowercased_totals": "WITH tok AS (SELECT doc_id, {EXPL}({TOKL}) AS t FROM documents) SELECT count(*) AS total_matches, count(DISTINCT t) AS kinds FROM tok",
    "P05_length_guard_totals": f"WITH {TOKENS} SELECT source, count(*) AS total_matches, count_if(n <= 10000) AS in_range FROM num GROUP BY source",
    "P06_int_and_range": f"WITH {TOKENS} SELECT count(*) AS total_matches, count_if(length(t) <= 18 AND n <= 10000) AS kept FROM num",
    "P07_in_range_matches": f"WITH {TOKENS} SELECT lang, count(*) AS matches, min(n) AS least, max(n) AS most FROM num WHERE n <= 10000 GROUP BY lang",
    "P08_bad_rows": "SELECT source, count(*) AS docs, count_if(text IS NULL) AS bad_rows FROM documents GROUP BY source",
    "P09_bytes_and_tokens": "SELECT source, CAST(sum({BYTES}) AS BIGINT) AS bytes, round(sum({BYTES}) / 4.0, 6) AS tokens FROM documents GROUP BY source",
    "P10_tokens_per_byte": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT source, count(*) AS sampled, round(CAST(sum(length(text) - length(replace(text, ' ', '')) + 2) AS DOUBLE) / sum({BYTES}), 6) AS ratio FROM r WHERE i % 50 = 0 GROUP BY source",
    "P11_roundness": f"WITH {DENSE} SELECT CASE WHEN n > 0 AND n % 100 = 0 THEN 'h' WHEN n > 0 AND n % 10 = 0 THEN 't' ELSE 'o' END AS kind, CAST(sum(c) AS BIGINT) AS c FROM den GROUP BY 1",
    "P12_year_bands": f"WITH {DENSE} SELECT CAST(sum(CASE WHEN n BETWEEN 1900 AND 2025 THEN c ELSE 0 END) AS BIGINT) AS y1, CAST(sum(CASE WHEN n BETWEEN 1500 AND 2099 THEN c ELSE 0 END) AS BIGINT) AS y2, CAST(sum(CASE WHEN n BETWEEN 1800 AND 2025 THEN c ELSE 0 END) AS BIGINT) AS y3 FROM den",
    "P13_digits": f"WITH {PART} SELECT n, substr(CAST(n AS STRING), 1, 1) AS lead, CAST(length(CAST(n AS STRING)) AS INT) AS digits, CAST(n % 10 AS INT) AS last FROM cnt",
    "P14_special_patterns": "WITH s AS (SELECT n, CAST(n AS STRING) AS s FROM {ZERO} z WHERE n >= 1) SELECT n FROM s WHERE length(s) > 1 AND length(replace(s, substr(s, 1, 1), '')) = 0 OR n IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192) OR n IN (12, 123, 1234, 2345, 3456, 4567, 5678, 6789)",
    "P15_flags": "WITH s AS (SELECT n, CAST(n AS STRING) AS s FROM {ZERO} z WHERE n >= 1) SELECT n, n % 100 = 0 AS h, n % 1000 = 0 AS k, (n & (n - 1)) = 0 AS pow2, length(s) > 1 AND length(replace(s, substr(s, 1, 1), '')) = 0 AS repdigit FROM s",
    "P16_trailing_nines": "WITH s AS (SELECT CAST(n AS STRING) AS s FROM {ZERO} z) SELECT CAST(length(s) - length(regexp_replace(s, '9+$', '')) AS INT) AS depth, count(*) AS steps FROM s GROUP BY 1",
    "P17_prefixes": f"WITH {PART} SELECT n, CAST(floor(n / 10) AS INT) AS p1, CAST(floor(n / 100) AS INT) AS p2, CAST(floor(n / 1000) AS INT) AS p3 FROM cnt",
    "P18_hamming": f"WITH {PART}, s AS (SELECT n, lpad(CAST(n AS STRING), 4, '0') AS s FROM cnt) SELECT a.n AS a, b.n AS b, CAST((CASE WHEN substr(a.s, 1, 1) <> substr(b.s, 1, 1) THEN 1 ELSE 0 END) + (CASE WHEN substr(a.s, 2, 1) <> substr(b.s, 2, 1) THEN 1 ELSE 0 END) + (CASE WHEN substr(a.s, 3, 1) <> substr(b.s, 3, 1) THEN 1 ELSE 0 END) + (CASE WHEN substr(a.s, 4, 1) <> substr(b.s, 4, 1) THEN 1 ELSE 0 END) AS INT) AS d FROM s a JOIN s b ON b.n BETWEEN a.n + 1 AND a.n + 20",
    "P19_bands": f"WITH band AS (SELECT CAST(n AS INT) AS g, round(power(10, 1 + n / 3.0)) AS m FROM {{ZERO}} z WHERE n < 10), {PART} SELECT g, CAST(sum(c) AS BIGINT) AS c FROM band JOIN cnt ON cnt.n >= ceil(0.9 * m) AND cnt.n <= floor(1.1 * m) GROUP BY g",
    "P20_decades": f"WITH {DENSE} SELECT CAST(length(CAST(n AS STRING)) AS INT) AS digits, CAST(sum(c) AS BIGINT) AS c FROM den WHERE n >= 1 GROUP BY 1",
    "P21_frequency_tiers": f"WITH {DENSE} SELECT CASE WHEN c < 1000 THEN 'low' WHEN c < 100000 THEN 'mid' ELSE 'high' END AS tier, count(*) AS k FROM den WHERE n BETWEEN 10 AND 9999 GROUP BY 1",
    "P22_gap_regimes": f"WITH {CMP} SELECT CASE WHEN gap <= 5 THEN 'SG' WHEN gap <= 10 THEN 'MG' WHEN gap <= 20 THEN 'LG' END AS regime, count(*) AS k, round(avg(correct), 6) AS accuracy FROM row GROUP BY 1",
    "P23_symbol_value": "SELECT n_nationkey, CAST((ascii(lower(substr(n_name, 1, 1))) - 97) * 676 + (ascii(lower(substr(n_name, 2, 1))) - 97) * 26 + ascii(lower(substr(n_name, 3, 1))) - 97 AS INT) AS v FROM nation",
    "P24_first_integer": "SELECT doc_id, {FIRSTINT} AS first_int FROM documents WHERE {FIRSTINT} <> ''",
    "P25_stable_hash": "SELECT doc_id, {SHA} AS digest, md5(text) AS short FROM documents",
    "P26_min_max": "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS v FROM part",
    "P28_half_even": "SELECT l_orderkey, l_linenumber, {REVEN}(l_quantity / 2.0, 0) AS r FROM lineitem",
    # sampling
    "M01_units": f"WITH {UNIT}, s AS (SELECT doc_id, size, CAST(ceil(size / 4096.0) AS INT) AS k FROM unit) SELECT doc_id, CAST(part AS INT) AS part, CAST(floor(size * part / CAST(k AS DOUBLE)) AS BIGINT) AS lo, CAST(floor(size * (part + 1) / CAST(k AS DOUBLE)) AS BIGINT) AS hi FROM (SELECT doc_id, size, k, {{EXPL}}({{SEQ}}(0, k - 1)) AS part FROM s) q",
    "M02_uniform_units": f"WITH {UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 1103515245 + 12345) % 2147483648, doc_id) AS k FROM unit) SELECT source, doc_id, size FROM r WHERE k <= 3",
    "M03_size_proportional": f"WITH {UNIT}, w AS (SELECT doc_id, size, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS hi, sum(size) OVER () AS tot, count(*) OVER () AS units FROM unit), d AS (SELECT n AS draw, ((CAST(n AS BIGINT) * 1103515245 + 12345) % 2147483648) / 2147483648.0 AS u FROM {{ZERO}} z WHERE n < 200) SELECT CAST(draw AS INT) AS draw, doc_id, round(CAST(tot AS DOUBLE) / units / size, 6) AS weight FROM d JOIN w ON u * tot >= hi - size AND u * tot < hi",
    "M04_budget_prefix": f"WITH {UNIT}, o AS (SELECT doc_id, size, sum(size) OVER (ORDER BY (doc_id * 69069 + 1) % 4294967296, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM unit) SELECT doc_id, size FROM o WHERE cum - size < 200000",
    "M10_chunk_offsets": f"WITH {UNIT} SELECT doc_id, CAST(floor(size / 2048) AS BIGINT) AS chunks, CAST(sum(floor(size / 2048)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM unit",
    "M13_membership_overlap": "WITH m AS (SELECT doc_id, CAST((doc_id * 7 + 3) % 3 AS INT) AS a, CAST((doc_id * 11 + 5) % 3 AS INT) AS b FROM documents) SELECT count_if(a > 0) AS in_a, count_if(b > 0) AS in_b, count_if(a > 0 AND b > 0) AS in_both, CAST(sum(least(a, b)) AS BIGINT) AS shared FROM m",
    "M16_stratum_budget": f"WITH {UNIT} SELECT source, round(10000000.0 * sum(size) / sum(sum(size)) OVER (), 6) AS budget FROM unit GROUP BY source",
    "M17_fractional_prefix": f"WITH {UNIT}, o AS (SELECT source, doc_id, size, sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM unit) SELECT source, doc_id, round(least(1.0, greatest(0.0, (30000.0 - before) / size)), 6) AS w FROM o WHERE before < 30000",
    "M18_weighted_counts": f"WITH {TOKENS}, c AS (SELECT source, n, count(*) AS c FROM num WHERE n <= 10000 GROUP BY source, n) SELECT n, CAST({{REVEN}}(sum(c * (1 + length(source) % 3) / 2.0), 0) AS BIGINT) AS c FROM c GROUP BY n",
    "M19_stratified": f"WITH {PART}, t AS (SELECT n, c, CAST(floor(n / 100) AS INT) AS block, row_number() OVER (PARTITION BY floor(n / 100) ORDER BY (CAST(n AS BIGINT) * 1103515245 + 7) % 2147483648, n) AS k FROM cnt) SELECT block, n, c FROM t WHERE k <= 5",
    "M20_kfold": f"WITH {PART} SELECT CAST((CAST(n AS BIGINT) * 1103515245 + 12345) % 2147483648 % 5 AS INT) AS fold, count(*) AS k, CAST(sum(c) AS BIGINT) AS c FROM cnt GROUP BY 1",
    "M21_leakage_free": "WITH t AS (SELECT DISTINCT source, CAST(floor(n_chars / 500) AS BIGINT) AS target FROM documents), r AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY (target * 69069 + 5) % 65536, target) AS k, count(*) OVER (PARTITION BY source) AS m FROM t) SELECT source, target, k * 2 <= m AS train FROM r",
    "M22_pairs": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE (a.n_nationkey * 31 + b.n_nationkey * 17) % 3 = 0",
    # aggregation
    "A01_count_by_integer": f"WITH {PART} SELECT n, c FROM cnt",
    "A04_rollups": f"WITH {TOKENS} SELECT lang, source, count(*) AS matches FROM num WHERE n <= 10000 GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())",
    "A05_distinct": f"WITH {TOKENS} SELECT source, count(DISTINCT n) AS kinds, count(DISTINCT t) AS spellings FROM num GROUP BY source",
    "A06_multipliers": "SELECT CAST(l_partkey AS INT) AS n, CAST(sum(1 + l_linenumber % 2) AS BIGINT) AS c FROM lineitem GROUP BY 1",
    "A07_mixture": "WITH u AS (SELECT CAST(l_partkey AS INT) AS n, 1 AS w FROM lineitem UNION ALL SELECT CAST(p_partkey AS INT), 2 FROM part UNION ALL SELECT CAST(o_custkey AS INT), 1 FROM orders) SELECT n, CAST(sum(w) AS BIGINT) AS c FROM u GROUP BY n",
    "A08_membership_expand": "WITH c AS (SELECT CAST(l_partkey AS INT) AS n, CAST(l_orderkey % 3 AS INT) AS m, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT n, CAST(sum(c) AS BIGINT) AS whole, CAST(sum(m * c) AS BIGINT) AS seeded FROM c GROUP BY n",
    "A09_shares": "SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens, round(CAST(sum(n_chars) AS DOUBLE) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY source",
    "A10_mask_shares": f"WITH {DENSE} SELECT round(CAST(sum(CASE WHEN n < 10 THEN c END) AS DOUBLE) / sum(c), 6) AS single, round(CAST(sum(CASE WHEN n > 0 AND n % 10 = 0 THEN c END) AS DOUBLE) / sum(c), 6) AS tens, round(CAST(sum(CASE WHEN n <= 100 THEN c END) AS DOUBLE) / sum(c), 6) AS small, round(CAST(sum(CASE WHEN n <= 1000 THEN c END) AS DOUBLE) / sum(c), 6) AS thousand FROM den",
    "A11_support": f"WITH {DENSE} SELECT round(count_if(c > 0 AND n >= 1) / 10000.0, 6) AS support FROM den",
    "A12_rare_and_saturation": f"WITH {DENSE} SELECT count_if(c < 4000) AS r, round(sum(c / (c + 4000.0)), 6) AS s FROM den WHERE n BETWEEN 10 AND 9999",
    "A13_entropy_gini": f"WITH {DENSE}, m AS (SELECT c, CAST(sum(c) OVER () AS DOUBLE) AS t, row_number() OVER (ORDER BY c, n) AS k, CAST(sum(c) OVER (ORDER BY c, n ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM den WHERE n BETWEEN 10 AND 9999) SELECT round(-sum(CASE WHEN c > 0 THEN c / t * ln(c / t) ELSE 0 END) / ln(9990), 6) AS entropy, round(1 - 2 * sum(cum / t) / 9990 + 1 / 9990.0, 6) AS gini FROM m",
    "A14_density": f"WITH {TOKENS}, k AS (SELECT source, count(*) AS m FROM num WHERE n <= 10000 GROUP BY source), s AS (SELECT source, sum(n_chars) AS chars FROM documents GROUP BY source) SELECT s.source, round(1000.0 * coalesce(m, 0) / (chars / 4.0), 6) AS density FROM s LEFT JOIN k ON k.source = s.source",
    "A15_summaries": "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_quantity), 6) AS sd1, round(stddev_pop(l_quantity), 6) AS sd0, round({PCT}(l_quantity, 0.5), 6) AS median, round({PCT}(l_quantity, 0.9), 6) AS q90 FROM lineitem GROUP BY l_returnflag",
    "A17_weighted_mean": "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS w FROM lineitem GROUP BY l_returnflag",
    "A18_two_level_mean": f"WITH {CMP}, i AS (SELECT grp, gap, avg(correct) AS a FROM row GROUP BY grp, gap) SELECT grp, round(avg(a), 6) AS a FROM i GROUP BY grp",
    "A19_accuracy": f"WITH {CMP} SELECT fam, grp, gap, count(*) AS k, round(avg(correct), 6) AS acc, round(avg(margin), 6) AS margin FROM row GROUP BY GROUPING SETS ((fam), (grp, gap), ())",
    "A20_centroids": "SELECT label, p, round(avg(x), 6) AS m FROM {VEC} v GROUP BY label, p",
    "A21_argmax": "WITH a AS (SELECT l_returnflag AS grp, l_linenumber AS layer, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT grp, {MAXBY}(layer, v) AS best, {MINBY}(layer, v) AS worst FROM a GROUP BY grp",
    "A22_verdicts": f"WITH {CMP}, s AS (SELECT grp, gap, avg(correct) AS share, count(*) AS k FROM row GROUP BY grp, gap) SELECT grp, gap, CASE WHEN k < 100 THEN 'underpowered' WHEN share >= 0.7 THEN 'holds' WHEN share <= 0.3 THEN 'fails' ELSE 'mixed' END AS verdict FROM s",
    "A23_validity_gate": f"WITH {CMP}, s AS (SELECT grp, gap, avg(correct) AS share FROM row GROUP BY grp, gap) SELECT grp, round(min(share), 6) AS least, min(share) >= 0.45 AS valid FROM s GROUP BY grp",
    # joins
    "J02_key_join": "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "J03_fallback_join": "WITH e AS (SELECT o_custkey AS k, round(avg(o_totalprice), 4) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), w AS (SELECT c_custkey AS k, round(c_acctbal, 4) AS v FROM customer) SELECT w.k, coalesce(e.v, w.v) AS v, CASE WHEN e.v IS NULL THEN 'window' ELSE 'exact' END AS source FROM w LEFT JOIN e ON e.k = w.k",
    "J04_zero_fill": f"WITH {DENSE} SELECT n, c FROM den",
    "J05_semi": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "J06_anti": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "J07_range_join": f"WITH band AS (SELECT n AS g, n * 250 AS lo, n * 250 + 250 AS hi FROM {{ZERO}} z WHERE n < 40), {PART} SELECT g, count(*) AS k, CAST(sum(c) AS BIGINT) AS c FROM band JOIN cnt ON cnt.n >= lo AND cnt.n < hi GROUP BY g",
    "J08_neighbours": f"WITH {PART} SELECT a.n, count(*) AS k, round(avg(b.c), 6) AS base FROM cnt a JOIN cnt b ON b.n BETWEEN a.n - 3 AND a.n + 3 AND b.n <> a.n AND b.n % 10 <> 0 WHERE a.n % 10 = 0 AND a.n > 0 GROUP BY a.n",
    "J09_successor": f"WITH {PART} SELECT a.n, b.c - a.c AS step FROM cnt a JOIN cnt b ON b.n = a.n + 1",
    "J10_pairs": "SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 4) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "J12_nearest_key": f"WITH {PART}, o AS (SELECT n FROM cnt WHERE n % 37 = 0), r AS (SELECT a.n AS a, o.n AS near, row_number() OVER (PARTITION BY a.n ORDER BY abs(a.n - o.n), o.n) AS k FROM cnt a JOIN o ON o.n BETWEEN a.n - 40 AND a.n + 40) SELECT a, near FROM r WHERE k = 1",
    # windows, sets
    "W01_rank_frequency": f"WITH {PART} SELECT n, c, CAST(row_number() OVER (ORDER BY c DESC, n) AS INT) AS rank FROM cnt WHERE c > 0",
    "W02_cumulative": f"WITH {DENSE}, s AS (SELECT n, CAST(sum(c) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(c) OVER () AS q FROM den) SELECT d.n AS decile, min(s.n) AS at FROM {{ZERO}} d JOIN s ON s.q >= d.n / 10.0 WHERE d.n BETWEEN 1 AND 9 GROUP BY d.n",
    "W03_tiers": f"WITH {PART}, r AS (SELECT n, floor(n / 100) AS block, row_number() OVER (PARTITION BY floor(n / 100) ORDER BY c, n) - 1 AS k, count(*) OVER (PARTITION BY floor(n / 100)) AS m FROM cnt) SELECT n, CAST(floor(k * 3 / m) AS INT) AS tier FROM r",
    "W04_demean": f"WITH {FAM} SELECT model, round(x - avg(x) OVER (PARTITION BY family), 6) AS x, round(y - avg(y) OVER (PARTITION BY family), 6) AS y FROM cell",
    "W06_gaps": "WITH m AS (SELECT p, label, avg(x) AS v FROM {VEC} q GROUP BY p, label), o AS (SELECT p, label, lead(v) OVER (PARTITION BY p ORDER BY label) - v AS d FROM m) SELECT p, label, round(d, 6) AS gap FROM o WHERE d IS NOT NULL",
    "W07_percentile_cut": f"WITH {PART}, q AS (SELECT {{PCT}}(c, 0.3333) AS p1, {{PCT}}(c, 0.6667) AS p2 FROM cnt) SELECT CASE WHEN c < p1 THEN 0 WHEN c < p2 THEN 1 ELSE 2 END AS tier, count(*) AS k FROM cnt CROSS JOIN q GROUP BY 1",
    "W09_crossing": "WITH s AS (SELECT l_returnflag AS g, l_linenumber AS t, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), h AS (SELECT g, max(v) / 2 AS h FROM s GROUP BY g), w AS (SELECT s.g, t, v, h, lag(t) OVER (PARTITION BY s.g ORDER BY t) AS t0, lag(v) OVER (PARTITION BY s.g ORDER BY t) AS v0 FROM s JOIN h ON h.g = s.g) SELECT g, round(min(t0 + (h - v0) / (v - v0) * (t - t0)), 6) AS at FROM w WHERE v0 >= h AND v < h GROUP BY g",
    "W10_top_k": f"WITH {PART} SELECT n, c FROM cnt ORDER BY c DESC, n LIMIT 20",
    "W11_limits": "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, doc_id FROM r WHERE k <= 4",
    "W12_prefixes": f"WITH u AS (SELECT doc_id, CAST({{BYTES}} AS BIGINT) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), k AS (SELECT CAST(power(2, n) AS INT) * 8 AS k FROM {{ZERO}} z WHERE n < 5) SELECT k, CAST(sum(size) AS BIGINT) AS bytes FROM k JOIN u ON i < k GROUP BY k",
    "W13_pivot": "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS p1, CAST(sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS BIGINT) AS p5 FROM orders GROUP BY o_orderstatus",
    "U01_union": "SELECT 'part' AS kind, p_partkey AS k FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier",
    "U02_intersect": "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'",
    "U03_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "U04_jaccard": "WITH s AS (SELECT DISTINCT c_nationkey AS a, c_mktsegment AS m, CAST(c_custkey % 10 AS INT) AS k FROM customer), z AS (SELECT a, count(*) AS n FROM s GROUP BY a) SELECT x.a AS a, y.a AS b, round(CAST(count(*) AS DOUBLE) / (max(p.n) + max(q.n) - count(*)), 6) AS j FROM s x JOIN s y ON x.m = y.m AND x.k = y.k AND x.a < y.a JOIN z p ON p.a = x.a JOIN z q ON q.a = y.a GROUP BY x.a, y.a",
    "U05_distinct": "SELECT DISTINCT lang, source FROM documents",
    # fits
    "F01_alpha_ols": f"WITH {PART} SELECT round(regr_slope(ln(c), ln(n)), 6) AS alpha, round(regr_r2(ln(c), ln(n)), 6) AS r2 FROM cnt WHERE n >= 1 AND c > 0",
    "F02_alpha_by_family": "WITH cnt AS (SELECT l_returnflag AS fam, l_partkey AS n, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT fam, CASE WHEN count(*) >= 2 THEN round(regr_slope(ln(c), ln(n)), 6) END AS alpha FROM cnt WHERE n >= 1 GROUP BY fam",
    "F04_zipf": f"WITH {PART}, r AS (SELECT c, row_number() OVER (ORDER BY c DESC, n) AS k FROM cnt WHERE c > 0) SELECT round(-regr_slope(ln(c), ln(k)), 6) AS zipf FROM r",
    "F05_local_slopes": f"WITH {PART} SELECT CAST(length(CAST(n AS STRING)) AS INT) AS digits, round(regr_slope(ln(c), ln(n)), 6) AS slope FROM cnt WHERE n >= 10 AND n < 10000 GROUP BY 1",
    "F06_log_correlation": f"WITH {PART}, s AS (SELECT CAST(l_partkey AS INT) AS n, count(*) AS c FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1) SELECT round(corr(ln(s.c), ln(cnt.c)), 6) AS r FROM s JOIN cnt ON cnt.n = s.n",
    "F09_kl": f"WITH {DENSE}, p AS (SELECT n, CAST(c AS DOUBLE) / sum(c) OVER () AS p, (1.0 / n) / sum(1.0 / n) OVER () AS z FROM den WHERE n >= 1) SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p * 10000) ELSE 0 END), 6) AS kl_uniform, round(sum(CASE WHEN p > 0 THEN p * ln(p / z) ELSE 0 END), 6) AS kl_zipf FROM p",
    "F11_benford": f"WITH {PART}, d AS (SELECT CAST(substr(CAST(n AS STRING), 1, 1) AS INT) AS d, CAST(sum(c) AS DOUBLE) AS c FROM cnt WHERE n > 0 GROUP BY 1) SELECT d, round(c / sum(c) OVER (), 6) AS share, round(c / sum(c) OVER () - ln(1 + 1.0 / d) / ln(10), 6) AS residual FROM d",
    "F13_round_excess": f"WITH {DENSE}, e AS (SELECT a.n, max(a.c) AS c, avg(b.c) AS base FROM den a JOIN den b ON b.n BETWEEN a.n - 3 AND a.n + 3 AND b.n % 10 <> 0 AND b.n >= 1 WHERE a.n % 10 = 0 AND a.n BETWEEN 20 AND 9990 GROUP BY a.n) SELECT round(avg(ln(c / base)), 6) AS excess FROM e WHERE c > 0 AND base > 0",
    "F14_year_excess": f"WITH {DENSE} SELECT round(ln(avg(CASE WHEN n BETWEEN 1950 AND 2030 THEN c END) / nullif(avg(CASE WHEN n BETWEEN 1800 AND 1949 OR n BETWEEN 2031 AND 2199 THEN c END), 0.0)), 6) AS excess FROM den",
    "F16_decade_beta": f"WITH {DENSE}, d AS (SELECT length(CAST(n AS STRING)) AS k, sum(c / (c + 4000.0D)) AS g FROM den WHERE n BETWEEN 10 AND 9999 GROUP BY 1) SELECT round(sqrt(max(CASE WHEN k = 4 THEN g END) / max(CASE WHEN k = 2 THEN g END)), 6) AS beta FROM d",
    "F17_grid_search": f"WITH {DENSE}, q AS (SELECT n / 20.0D AS q FROM {{ZERO}} z WHERE n <= 20), d AS (SELECT q, length(CAST(n AS STRING)) AS k, sum(CASE WHEN c > 0 THEN power(CAST(c AS DOUBLE), q) ELSE 0 END) AS g FROM den CROSS JOIN q WHERE n BETWEEN 10 AND 1999 GROUP BY 1, 2) SELECT round(q, 6) AS q, round(max(CASE WHEN k = 3 THEN g END) / max(CASE WHEN k = 2 THEN g END), 6) AS ratio FROM d GROUP BY q",
    "F21_log_spacing": "WITH m AS (SELECT p, label, avg(x) AS v FROM {VEC} q GROUP BY p, label), o AS (SELECT p, label + 1 AS i, abs(lead(v) OVER (PARTITION BY p ORDER BY label) - v) AS d FROM m) SELECT p, round(exp(regr_slope(ln(greatest(d, 1e-8)), i)), 6) AS beta FROM o WHERE d IS NOT NULL GROUP BY p",
    # statistics
    "R01_correlations": f"WITH {FAM}, k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM cell) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k",
    "R02_partial": f"WITH {FAM}, r AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM cell) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM r",
    "R03_within_family": f"WITH {FAM}, d AS (SELECT x - avg(x) OVER (PARTITION BY family) AS x, y - avg(y) OVER (PARTITION BY family) AS y FROM cell) SELECT round(corr(x, y), 6) AS r FROM d",
    "R04_leave_family_out": f"WITH {FAM} SELECT f.r_regionkey AS held_out, round(corr(x, y), 6) AS r FROM region f JOIN cell ON cell.family <> f.r_regionkey GROUP BY f.r_regionkey",
    "R06_line": f"WITH {FAM} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM cell",
    "R07_apply_line": f"WITH {FAM}, l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi FROM cell WHERE model % 2 = 0) SELECT model, round(a + b * x, 4) AS predicted, x < lo OR x > hi AS outside FROM cell CROSS JOIN l",
    "R08_scores": f"WITH {FAM}, l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM cell WHERE model % 2 = 0) SELECT round(avg(abs(y - a - b * x)), 4) AS mae, round(avg(y - a - b * x), 4) AS shift FROM cell CROSS JOIN l WHERE model % 2 = 1",
    "R15_p_values": "WITH o AS (SELECT avg(l_quantity) AS o FROM lineitem WHERE l_orderkey % 50 = 0), p AS (SELECT l_orderkey % 50 AS k, avg(l_quantity) AS v FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY 1) SELECT round((count_if(v >= o) + 1.0) / (count(*) + 1), 6) AS p FROM p CROSS JOIN o",
    "R16_benjamini_hochberg": "WITH p AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1000 + 0.5D) / 1000 * (p_partkey % 10 + 1) / 10 AS p FROM part), r AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS m FROM p) SELECT id, round(least(1.0D, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r",
    # geometry
    "G07_path": "WITH m AS (SELECT label, p, avg(x) AS v FROM {VEC} q GROUP BY label, p), d AS (SELECT a.label, sqrt(sum(power(b.v - a.v, 2))) AS len FROM m a JOIN m b ON b.p = a.p AND b.label = a.label + 1 GROUP BY a.label) SELECT label, round(len, 6) AS segment, round(sum(len) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING), 6) AS travelled FROM d",
    "G14_norms": "SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(avg(x), 6) AS mean FROM {VEC} v GROUP BY vec_id",
    "G15_standardise": "SELECT p, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, stddev_pop(x) > 1e-8 AS kept FROM {VEC} v GROUP BY p",
    "G32_energy_distance": "WITH a AS (SELECT x FROM {VEC} v WHERE label = 0 AND p = 0), b AS (SELECT x FROM {VEC} w WHERE label = 1 AND p = 0) SELECT round(2 * (SELECT avg(abs(a.x - b.x)) FROM a CROSS JOIN b) - (SELECT avg(abs(a.x - c.x)) FROM a CROSS JOIN a c) - (SELECT avg(abs(b.x - c.x)) FROM b CROSS JOIN b c), 6) AS e",
    # generators, streams as batches
    "X05_number_sets": "WITH two AS (SELECT DISTINCT a.n FROM {ZERO} a JOIN {ZERO} b ON b.n BETWEEN 2 AND 100 AND b.n * b.n <= a.n AND a.n % b.n = 0), pow AS (SELECT DISTINCT CAST(round(least(power(b.n, e.n), 20000.0)) AS INT) AS n FROM {ZERO} b JOIN {ZERO} e ON b.n BETWEEN 2 AND 100 AND e.n BETWEEN 2 AND 13 WHERE e.n * ln(b.n) <= ln(10000.5)) SELECT z.n, z.n % 7 AS residue, z.n > 1 AND two.n IS NULL AS prime, CAST(round(sqrt(z.n)) AS INT) * CAST(round(sqrt(z.n)) AS INT) = z.n AS square, z.n = 1 OR pow.n IS NOT NULL AS perfect_power, length(replace(CAST(z.n AS STRING), left(CAST(z.n AS STRING), 1), '')) = 0 AS repdigit FROM {ZERO} z LEFT JOIN two ON two.n = z.n LEFT JOIN pow ON pow.n = z.n WHERE z.n >= 1",
    "X06_job_grid": "SELECT r_name AS model, CAST(n AS INT) AS layer, CAST(n * (r_regionkey + 1) AS INT) AS cost FROM region CROSS JOIN {ZERO} z WHERE n < 24",
}


def _counted(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END), which is a 64-bit integer on the oracle engine."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def spell(sql: str, engine: int) -> str:
    """engine: 0 Spark, where numbers with a point are doubles, 1 oracle."""
    for _ in range(2):
        for name, ways in SPELL.items():
            sql = sql.replace("{" + name + "}", ways[engine])
    if engine == 0:
        return re.sub(r"(?<![\w'\\.])(\d+\.\d+)(?![\w.])", r"\1D", sql)
    return _counted(re.sub(r"(?<![\w'])(\d+(?:\.\d+)?)D\b", r"\1", sql).replace(" AS STRING)", " AS VARCHAR)"))
