"""Readers and writers, there and back."""

import gzip
import json

import numpy as np
import pytest

from tallyfield.sources import files


def test_json_texts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one 1"}\nnot json\n{"other": 2}\n{"text": null}\n')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps({"text": "zwei 2", "meta": {"x": 1}}) + "\n")
    assert sorted(r.text for r in files.read_json_texts(spark, str(tmp_path)).collect()) == ["one 1", "zwei 2"]


def test_tokens(spark, tmp_path):
    ids = np.arange(5 * 7 + 3, dtype="<u2") + 65000
    ids.tofile(tmp_path / "a.bin")
    rows = files.read_tokens(spark, str(tmp_path / "a.bin"), chunk=7, piece=2).orderBy("chunk").collect()
    assert [len(r.tokens) for r in rows] == [7] * 5 + [3]
    assert np.concatenate([r.tokens for r in rows]).tolist() == ids.astype(int).tolist()
    (tmp_path / "b.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole tokens"):
        files.read_tokens(spark, str(tmp_path / "b.bin")).collect()


def test_writers(spark, tmp_path):
    counts = spark.createDataFrame([(3, 4), (3, 1), (7, 2)], "n int, c long")
    files.write_dense_csv(counts, f"{tmp_path}/dense", most=8)
    parts = list((tmp_path / "dense").glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text().split() == ["number,count", "0,0", "1,0", "2,0", "3,5", "4,0", "5,0", "6,0", "7,2", "8,0"]
    files.write_summary_json(spark.createDataFrame([("a", None)], "corpus string, alpha double"), f"{tmp_path}/summary")
    assert [json.loads(x) for p in (tmp_path / "summary").glob("part-*") for x in p.read_text().splitlines()] == [{"corpus": "a", "alpha": None}]
    files.write_long_csv(counts, f"{tmp_path}/long")
    assert spark.read.option("header", True).csv(f"{tmp_path}/long").count() == 3
