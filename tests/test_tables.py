"""Readers and sinks of files in a folder."""

import json

from pyspark.sql import functions as F

from doclattice.sources import readers, sinks


def test_manifests_logs_and_artifacts(spark, tmp_path):
    files = spark.createDataFrame([("a", True, "ready"), ("b", None, "planned"), ("c", False, "ready")], "name string, included boolean, state string")
    r = sinks.write_manifest(files, f"{tmp_path}/manifest").collect()[0]
    assert (r["total"], r["included"], r["ready"]) == (3, 2, 2) and spark.read.json(f"{tmp_path}/manifest").count() == 3
    for state in ("running", "done"):
        sinks.append_log(spark.createDataFrame([("job", state)], "id string, state string"), f"{tmp_path}/log")
    log = spark.read.json(f"{tmp_path}/log")
    assert sorted(r["state"] for r in log.collect()) == ["done", "running"] and log.where("logged_at IS NULL").count() == 0
    blocks = lambda text: spark.createDataFrame([(1, 0, text), (2, 0, "x")], "doc_id long, block_no int, text string")
    sinks.write_artifacts(blocks("old"), f"{tmp_path}/blocks")
    sinks.write_artifacts(blocks("new").where("doc_id = 1"), f"{tmp_path}/blocks")  # the other document stays
    assert {(r["doc_id"], r["text"]) for r in spark.read.json(f"{tmp_path}/blocks").collect()} == {(1, "new"), (2, "x")}


def test_fixtures_and_extraction_caches(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"readings": [{"tag": "T", "value": 1.5}, {"tag": "U"}], "other": [1]}))
    assert [(r["tag"], r["value"]) for r in readers.fixture_rows(spark, str(tmp_path / "f.json"), "readings", "tag: string, value: double").collect()] == [("T", 1.5), ("U", None)]
    root = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    cache = readers.extraction_cache([root(("a", "1"), ("b", "1")), root(("a", "2"), (None, "2"))], "path")
    assert {(r["path"], r["text"]) for r in cache.select("path", "text").collect()} == {("a", "2"), ("b", "1"), (None, "2")}
    assert cache.where(F.col("text") == "1").count() == 1
