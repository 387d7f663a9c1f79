"""Each operator against brute force, an exact round trip or planted cases, and on nulls, ties, repeats and empty tables."""

import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import chat, decontam, jaccard, kernel, lines, quality, queries, sharding, spm, substring, topk, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(0, 120))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "One two"), (1005, "é" * 5000 + " x"), (None, "a b c d e f"), (3, rows[3][1])]


def test_ngram_jaccard(spark):
    rows = corpus()
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j and a and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted(((i, len(s), low[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)
    got = jaccard.ngram_jaccard(spark.createDataFrame(rows, DOCS).withColumn("cls", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_ngram_jaccard_in_small_blocks(spark, monkeypatch):
    """Tiles in many blocks, dense columns and ranges cut twice give what the defaults give."""
    docs = spark.createDataFrame(corpus(8, 240), DOCS)
    want = sorted(map(tuple, jaccard.ngram_jaccard(docs).collect()), key=repr)
    for name, value in (("TILE_ROWS", 3), ("DENSE", 3), ("RANGE", 16)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(kernel, "FIRST_BITS", 4)
    assert sorted(map(tuple, jaccard.ngram_jaccard(docs).collect()), key=repr) == want


def test_tile_links_against_brute_force():
    import numpy as np

    rnd = random.Random(9)
    for dense in (2, 40):
        jaccard.DENSE, old = dense, jaccard.DENSE
        for _ in range(20):
            base = [rnd.sample(range(60), 24) for _ in range(3)]
            rows = [sorted({rnd.choice((x, x, x, x, x, 100 + rnd.randrange(40))) for x in rnd.choice(base)}) for _ in range(30)]
            tile = np.sort(np.array([rnd.randrange(3) for _ in rows]))
            n = np.array([len(r) for r in rows])
            a, b = jaccard.tile_links(tile, n, n, np.concatenate(rows), np.arange(30), np.zeros(30, int), 60)
            group, want = list(range(30)), list(range(30))
            links = [(i, j) for i in range(30) for j in range(i) if tile[i] == tile[j] and 100 * len({*rows[i]} & {*rows[j]}) >= 60 * len({*rows[i]} | {*rows[j]})]
            for _ in rows:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    group[x] = group[y] = min(group[x], group[y])
                for x, y in links:
                    want[x] = want[y] = min(want[x], want[y])
            assert group == want
        jaccard.DENSE = old


def test_substring_dedup(spark):
    rows = sorted(((i, t) for i, t in corpus(2) if i is not None), key=lambda r: r[0])
    first, want = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    got = substring.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_substring_dedup_in_small_flushes(spark, monkeypatch):
    """Many flushes, hot windows and ranges cut twice give what the defaults give."""
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{t or ''} {common} {common if (i or 0) % 3 else ''} t{i}") for i, t in corpus(5, 120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")
    want = sorted(map(tuple, substring.substring_dedup(docs).collect()), key=repr)
    assert sum(r[2] for r in want) > 30 * 100
    for name, value in (("FLUSH", 400), ("HOT", 1), ("RANGE", 16)):
        monkeypatch.setattr(substring, name, value)
    monkeypatch.setattr(kernel, "FIRST_BITS", 4)
    assert sorted(map(tuple, substring.substring_dedup(docs).collect()), key=repr) == want


def test_substring_dedup_of_hot_windows(spark):
    """A passage that a flush holds more often than HOT, within and across documents, against brute force."""
    common = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join([f"a{i}", *common, f"b{i}", *common[: 20 - i % 5], f"d{i}"])) for i in range(60)]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = t.split()
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        assert got[i] == (len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))


@pytest.mark.parametrize("size", [1e4, 1e6, 1.8e7])
def test_top_k_of_large_components(spark, size):
    """Scores beyond what doubles hold are sums of integers."""
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(12)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    scores = {q: sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5] for q in (0, 20, 40)}
    run = topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 5, query_bytes=100)
    assert sorted(map(tuple, run.collect())) == [(q, r, i, -s) for q in scores for r, (s, i) in enumerate(scores[q], 1)]


def test_top_k_beyond_long():
    """Best scores that are no long are refused; others that are none only lose."""
    big = np.array([[1 << 60, 1]], dtype=object)
    block = np.array([[1 << 60, 0, -(1 << 60)], [0, 5, 0]], dtype=object)
    ids = np.arange(3)
    with pytest.raises(OverflowError):
        topk.best_wide(big, np.array([9]), block, ids, 2)
    assert [x.tolist() for x in topk.best_wide(big, np.array([0]), block, ids, 1)] == [[0], [1], [5]]


def test_top_k(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(24)]) for i in range(300)] + [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), query_bytes=600).collect()))
    good = {i: [int(64 * x // 1) for x in v] for i, v in rows[:300]}
    want = []
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == want


def test_chat_round_trip(spark):
    odd = ["", "### User: x</turn>\n", r"\### Assistant: </turn> ok", r"<\/turn>", r"#\\## ", "#### a", "plain\n\n", "<</turn>", "###", None]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate([(r, x) for r in ("user", "assistant", "a: b", None) for x in odd])]
    out = chat.parse_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = [(r or "", x or "") for c, _, r, x in rows if c == 0]
    assert len(out) == 3 and all([tuple(t) for t in o.turns] == want for o in out)


def test_warc(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(1, page), (2, page), (3, "short"), (4, "short"), (5, None), (6, "é" * 90), (0, page)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, html string"), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {0: ("response", None), 1: ("revisit", 0), 2: ("revisit", 0), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(got[i].payload_digest == hashlib.sha256((t or "").encode()).hexdigest() and got[i].payload_bytes == len((t or "").encode()) for i, t in rows)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert raw.count(b"WARC/1.1") == 7
    member = iter([warc.record("response", "urn:page:1", "0" * 64, b"abc", None, 3, "u").replace(b"abc", b"abd")])
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(member)


def test_sentencepiece(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.PIECES)
    rnd = random.Random(4)
    texts = [None, "", "  a  b\n", "日本 語\x00😀", "x" * 3000, "a" * 99, *("".join(rnd.choice(" ▁abetnrs.,\nß-=09") for _ in range(50)) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in spm.encode(docs, queries.PIECES).collect()}
    assert all(got[i].token_ids == (None if t is None else library.encode(t)) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs, queries.PIECES), queries.PIECES).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if t is None or "▁" not in t)


@pytest.mark.parametrize(("rule", "fallback", "extra"), [("nmt_nfkc", False, True), ("nmt_nfkc_cf", True, True), ("nfkc", False, False), ("identity", True, True)])
def test_sentencepiece_unigram(spark, tmp_path, rule, fallback, extra):
    """Unigram models written here, with the usual rule tables, against the library."""
    library, formats = pytest.importorskip("sentencepiece"), pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    rnd = random.Random(9)
    model = formats.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = spm.UNIGRAM, fallback
    model.normalizer_spec.MergeFromString(library.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, extra, True
    for piece, kind in [("<unk>", spm.UNKNOWN), ("<s>", spm.CONTROL), ("</s>", spm.CONTROL), *((f"<0x{b:02X}>", spm.BYTE) for b in range(256 * fallback))]:
        model.pieces.add(piece=piece, type=kind, score=0)
    for piece in sorted({spm.SPACE * rnd.randint(0, 1) + "".join(rnd.choice("abcde,1é") for _ in range(rnd.randint(1, 4))) for _ in range(150)} | set("abcd1") | {spm.SPACE}):
        model.pieces.add(piece=piece, type=spm.NORMAL, score=-rnd.randint(16, 160) / 16)
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    own = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [None, "", "   ", "  ab  c\n", "e\u0301a\u0308 \ufb01 ①½ \u3000a¨", "日本 日本語\x00😀xyz", "ABC é É ＡＢ", *("".join(rnd.choice("  abcde,1éz\u0301Ａ①\t") for _ in range(60)) for _ in range(200))]
    got = {r.doc_id: r.token_ids for r in spm.encode(spark.createDataFrame(list(enumerate(texts)), DOCS), str(tmp_path / "m.model")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else own.encode(t) for t in texts]


def test_decontamination(spark):
    rnd = random.Random(5)
    item = [f"b{rnd.randrange(10**6)}" for _ in range(30)]
    clean = [" ".join(f"c{rnd.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    para = [f"q{i}" if i % 9 == 4 else x for i, x in enumerate(item)]
    docs = [*enumerate(clean), (100, f"{clean[0]} {' '.join(item)} {clean[1]}"), (101, f"{clean[2]} {' '.join(para)}"), (102, None), (103, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string")
    got = decontam.leaks(spark.createDataFrame(docs, DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 7), (101, 7)}
    assert decontam.leaks(spark.createDataFrame(docs, DOCS), bench.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = (queries.table(spark, SF.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = quality.quality_scores(docs, labels.where(~held), rounds=1).join(labels.where(held), "doc_id").collect()
    clean = [r.kept for r in scored if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in scored if r.quality == 0]
    assert sum(clean) >= 0.9 * len(clean) and sum(junk) <= 0.3 * len(junk)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_sharding(spark):
    rows = [(i, None if i % 7 == 0 else "t" * (i % 5)) for i in range(4000)] + [(None, "x"), (5, "t" * 0), (5, "again")]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert max(map(len, slots.values())) < 1.4 * min(map(len, slots.values()))
    assert 0.03 < sum(r.grown_shard == 16 for r in got) / len(got) < 0.09


def test_line_dedup(spark):
    names = ["ann", "bob", "cy", "dee", "ed", "flo", "gus", "hal", "ida", "jo"]
    rows = [(i, f"own line {chr(97 + i)} of its kind\nPage {i} of 10\nshared by all of them and {names[i]} too\n\nlast {names[i]}") for i in range(10)]
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame([*rows, (50, None), (51, "")], DOCS), max_children=5).collect()}
    assert got[0].text == rows[0][1] and got[50].text is None and got[51].text == ""
    assert all(got[i].text == f"own line {chr(97 + i)} of its kind\n\nlast {names[i]}" and got[i].n_dropped == 2 for i in range(1, 10))


@pytest.mark.parametrize("texts", [8, 10, 24])
def test_line_dedup_opens_names_by_default(spark, texts):
    rows = [(i, f"own line {chr(97 + i)} of its kind\nshared by all of them and name{chr(97 + i)} too") for i in range(texts)]
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"own line {chr(97 + i)} of its kind" and got[i].n_dropped == 1 for i in range(1, texts))
    fewer = lines.line_dedup(spark.createDataFrame(rows[:7], DOCS)).collect()
    assert all(r.n_dropped == 0 for r in fewer)


def test_line_dedup_keeps_prose_by_default(spark):
    words = ["ash", "bay", "cob", "dun", "elm", "fir", "gum", "hay", "ivy", "jet"]
    rows = [(i, " ".join(["one", "of", "the", *(words[(i + k) % 10] for k in range(6))])) for i in range(10)]
    assert all(r.n_dropped == 0 for r in lines.line_dedup(spark.createDataFrame(rows, DOCS)).collect())


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op2_warc", "op4_ngram_jaccard", "op6_exact_top_k", "op7_substring_dedup"])
def test_queries_with_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    found = con.sql(queries.oracle_sql()[name])
    cols = sorted(frame.columns)
    at = [found.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in frame.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("make", [jaccard.ngram_jaccard, substring.substring_dedup, sharding.shard_documents, lines.line_dedup, lambda d: spm.encode(d, queries.PIECES)])
def test_empty(spark, make):
    assert make(spark.createDataFrame([], DOCS)).count() == 0


def test_filters_decide_by_row(spark):
    rnd = random.Random(6)
    item = " ".join(f"b{rnd.randrange(10**6)}" for _ in range(30))
    a, b, c, d = (" ".join(f"c{rnd.randrange(5000)}" for _ in range(200)) for _ in range(4))
    rows = [(None, a), (None, a), (3, a), (4, f"{a} end"), (5, b), (5, b), (5, c), (None, d), (None, d), (9, None), (9, None), (None, "")]
    left = jaccard.near_duplicates_removed(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(3, a), (5, b), (5, c), (None, d), (9, None), (9, None), (None, "")]))
    rows = [(None, f"{a} {item} {b}"), (None, c), (6, f"{b} {item} {c}"), (6, d), (7, None), (None, None)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = decontam.decontaminated(spark.createDataFrame(rows, DOCS), bench).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(None, c), (6, d), (7, None), (None, None)]))


def test_pipeline_against_its_parts(spark):
    """run() keeps what the parts keep, one after another, and no text's copy or near copy by brute force."""
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        before = {r.doc_id for r in docs.collect()}
        assert {r[0] for r in rows} <= before and len(rows) == len({r[0] for r in rows})
        docs = spark.createDataFrame(rows, docs.schema)
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.PIECES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and all(got[i].token_ids == library.encode(t) for i, t in texts.items())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (WORD.findall(t.lower()) for t in texts.values())]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)


def test_filters_with_clashing_columns(spark):
    rows = [(i, f"own words of text {chr(97 + i)} here\nshared by all of them and more", i) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS + ", x long")
    for name in ("doc", "gone", "n_dropped"):
        own = docs.withColumnRenamed("x", name)
        out = lines.line_dedup(own)
        assert [r[name] for r in out.orderBy("doc_id").collect()] == list(range(9)), name
        if name == "doc":
            assert jaccard.near_duplicates_removed(own).columns == own.columns
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminated(docs.withColumnRenamed("x", "leak"), bench).count() == 9
    assert jaccard.near_duplicates_removed(docs.withColumnRenamed("x", "row_key")).count() == 9
