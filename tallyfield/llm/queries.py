"""One query an operator, with its production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, lines, quality, sharding, spm, substring, topk, warc

#: Folder of the tokenizer files.
TOKENIZERS = os.environ.get("TALLYFIELD_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages").select("page_id", "html"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), PIECES)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup_digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_warc, op3_sentencepiece, op4_ngram_jaccard, op5_decontamination, op6_exact_top_k, op7_substring_dedup, op8_quality, op9_sharding, op10_line_dedup)}


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SAID = r"\### Assistant: </turn> ok"

def _shard_sql(shards: int) -> str:
    """SQL of the shard of a row whose key text is `k`: the greatest ln(u) / weight at each level of sharding.tree."""
    shape: dict[str, dict[str, list[int]]] = {}
    for leaf in sharding.tree(shards):
        shape.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf.shard)

    def level(ways: dict[str, tuple[float, str]], prefix: str) -> str:
        if len(ways) == 1:
            return next(iter(ways.values()))[1]
        draws = {n: f"ln((('0x' || left(md5('{prefix}/{n}/' || k), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / {w}" for n, (w, _) in ways.items()}
        best = f"greatest({', '.join(draws.values())})"
        return "CASE " + " ".join(f"WHEN {draws[n]} = {best} THEN {ways[n][1]}" for n in sorted(ways)) + " END"

    racks = {r: {k: (float(len(s)), level({str(x): (1.0, str(x)) for x in s}, f"{r}/{k}")) for k, s in ks.items()} for r, ks in shape.items()}
    return level({r: (sum(w for w, _ in ks.values()), level(ks, r)) for r, ks in racks.items()}, "")


ORACLE = {
    "op1_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '#(\\*)## ', '#\\\1## ', 'g') AS out FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('### ' || role || ': ' || out || '</turn>' || chr(10))) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g""",
    "op2_warc": """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id::BIGINT AS doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL) o
  JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * o.k >= 75 * (p.n + q.n - o.k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) c USING (doc_id)""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_substring_dedup": rf"""
WITH w AS (SELECT doc_id::BIGINT AS doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM p),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM f WHERE first < doc_id)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at) AS text, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at WHERE g.at IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)""",
    "op9_sharding": f"""
WITH bits AS (SELECT i, c FROM (
  WITH RECURSIVE r(i, n, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE n < 8)
  SELECT i, c FROM r WHERE n = 8)),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
d AS (
  SELECT doc_id::BIGINT AS doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
e AS (SELECT doc_id, k, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM d, crc),
p AS (SELECT *, ({_shard_sql(16)})::INTEGER AS shard, ({_shard_sql(17)})::INTEGER AS grown_shard, ('0x' || left(md5(concat_ws('/', doc_id, size, text_crc32)), 8))::BIGINT % {sharding.BLOCKS} AS block FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32)::BIGINT - 1 AS slot, grown_shard FROM p""",
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id::BIGINT AS doc_id, text, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS pieces FROM documents),
raw AS (SELECT row, doc_id, text, unnest(pieces) AS raw, unnest(range(len(pieces))) AS place FROM d),
lines AS (
  SELECT row, doc_id, md5(text) AS version, raw, place, regexp_replace(trim(regexp_replace(raw, '[\t\r\x0B\f ]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM raw),
forms AS (SELECT DISTINCT line, string_split(line, ' ') AS tokens FROM lines WHERE line <> ''),
leaf AS (SELECT line, tokens, len(tokens) AS n, array_to_string(tokens[1:3], ' ') AS head FROM forms WHERE len(tokens) > 3),
open AS (
  SELECT n, head, list(pos) AS pos FROM (
    SELECT n, head, pos FROM (SELECT n, head, unnest(tokens) AS token, unnest(range(1, n + 1)) AS pos FROM leaf)
    WHERE token <> '<*>' GROUP BY n, head, pos HAVING count(DISTINCT token) > 7) GROUP BY n, head),
merged AS (
  SELECT line, opened FROM (
    SELECT l.line, l.n, list_transform(l.tokens, lambda t, i: CASE WHEN list_contains(o.pos, i) THEN '<*>' ELSE t END) AS opened FROM leaf l JOIN open o USING (n, head))
  WHERE len(list_filter(opened, lambda t: t <> '<*>')) >= 0.6::DOUBLE * n),
held AS (SELECT l.*, CASE WHEN l.line = '' THEN NULL ELSE coalesce(array_to_string(m.opened, ' '), l.line) END AS template FROM lines l LEFT JOIN merged m USING (line)),
recurring AS (SELECT template, min(doc_id) AS first FROM held WHERE template IS NOT NULL GROUP BY template HAVING count(DISTINCT version) >= 8),
marked AS (SELECT h.row, h.place, h.raw, r.template IS NOT NULL AND h.doc_id IS DISTINCT FROM r.first AS gone FROM held h LEFT JOIN recurring r USING (template)),
cut AS (SELECT row, count(*) FILTER (WHERE gone) AS n, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY row)
SELECT d.doc_id, CASE WHEN c.n > 0 THEN c.kept ELSE d.text END AS text, len(d.pieces)::INTEGER AS n_lines, coalesce(c.n, 0)::INTEGER AS n_dropped FROM d LEFT JOIN cut c USING (row)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
