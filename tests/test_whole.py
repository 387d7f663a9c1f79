"""The queries of whole.py against brute force over whole tables."""

import math

import numpy as np
import pytest

from tallyfield import plans

SF = "/root/testdata/sf0.001"


def rows(spark, name, columns):
    return [tuple(r[c] for c in columns) for r in plans.queries()[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def table(spark):
    return lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_average_rank_of_all_rows(spark, table):
    lines = table("lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    assert max(x[0] for x in lines) >= 500
    places = {}
    for place, q in enumerate(sorted(x[2] for x in lines), 1):
        places.setdefault(q, []).append(place)
    want = sorted((k, n, sum(places[q]) / len(places[q])) for k, n, q in lines)
    assert sorted(rows(spark, "W05_average_rank", ["l_orderkey", "l_linenumber", "r"])) == want


def test_every_chunk_has_its_document(spark, table):
    want, chunk = [], 0
    for doc, text in sorted(table("documents", "doc_id", "text"), key=lambda x: x[0]):
        for j in range(len((text or "").encode()) // 2048):
            want.append((chunk, doc, j * 2048))
            chunk += 1
    assert sorted(rows(spark, "M12_chunk_to_file", ["chunk", "doc_id", "start"])) == want


def test_chunks_beyond_the_helper_grid(spark, tmp_path):
    ids = [None, -5, 1, 4095, 4096, 9000]
    spark.createDataFrame([(d, "x" * (2048 * 2500 + i)) for i, d in enumerate(ids)] + [(2, "short"), (3, None)], "doc_id long, text string").selectExpr("*", "'a' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.chunk, r.doc_id, r.start) for r in plans.queries()["M12_chunk_to_file"](spark, str(tmp_path)).collect())
    assert got == [(i * 2500 + j, d, j * 2048) for i, d in enumerate(ids) for j in range(2500)]


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """A lineitem table that fills the numbers up to 10,000, and its counts."""
    keys = [n for n in range(0, 10001, 3) for _ in range(1 + n % 4)] + [10000] * 7 + [10001, -1]
    path = str(tmp_path_factory.mktemp("dense"))
    for name in ("lineitem", "part"):  # every table whose name is in the SQL is opened
        spark.createDataFrame([(k,) for k in keys], "l_partkey long").write.parquet(f"{path}/{name}.parquet")
    return path, [keys.count(n) for n in range(10001)]


def test_whole_count_table(spark, dense):
    path, c = dense

    def found(name):
        return {r.n: tuple(r)[1:] for r in plans.queries()[name](spark, path).collect()}

    logs, means, null = found("P27_log_guards"), found("W08_sliding_mean"), found("F08_null_models")
    assert logs == {n: (pytest.approx(math.log(max(k, 0.5)), abs=1e-6), pytest.approx(math.log(k + 1), abs=1e-6)) for n, k in enumerate(c)}
    assert means == {n: (pytest.approx(np.mean(c[max(0, n - 2) : n + 3]), abs=1e-6),) for n in range(10001)}
    assert set(null) == set(range(1, 10001))
    assert [sum(x[i] for x in null.values()) for i in range(3)] == pytest.approx([sum(c[1:])] * 3, rel=1e-6)
    assert null[10000][2] == pytest.approx(null[1][2] / 10000, abs=1e-5)


def test_bootstrap_of_all_blocks(spark, dense):
    path, c = dense
    sums = [sum(c[i : i + 100]) for i in range(0, 10001, 100)]

    def draw(i, rep):
        x = (i + 1) * 7919 + rep * 104729
        return (x * x % 2147483647 * 48271 + x) % 2147483647 % 101

    picks = [[draw(i, rep) for i in range(101)] for rep in range(1, 51)]
    assert {x for p in picks for x in p} == set(range(101))
    want = np.percentile([sum(sums[x] for x in p) for p in picks], [2.5, 50, 97.5])
    got = plans.queries()["R12_block_bootstrap"](spark, path).first()
    assert (got.low, got.mid, got.high) == pytest.approx(tuple(want), abs=1e-5)
    assert got.low < sum(c) < got.high


def test_nearest_against_brute_force(spark, monkeypatch):
    from tallyfield.operators import neighbours

    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(120)] + [(500, None), (501, [float("nan")] * 6), (502, [1.0]), (None, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    got = sorted(map(tuple, neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), 4).collect()))
    want = []
    for q in range(0, 120, 20):
        near = sorted((round(math.dist(rows[q][1], v), 9), i) for i, v in rows[:120] if i != q)[:4]
        want += [(q, k, i, d) for k, (d, i) in enumerate(near, 1)]
    assert got == want
    assert neighbours.nearest(frame.limit(0), frame.limit(0), 4).count() == 0
