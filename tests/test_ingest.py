"""Staged ingestion: a stream that is killed between stages and started again ends with the same tables."""

import pytest
from pyspark.sql import functions as F

from doclattice.plans import ingestion
from doclattice.streaming import ingest, streams

SF = "/root/testdata/sf0.001"


class Killed(Exception):
    pass


def run(spark, source, store, checkpoint, kill=None):
    def after(number, stage):
        if kill == (number, stage):
            raise Killed

    stream = spark.readStream.schema(ingest.FILES).option("maxFilesPerTrigger", 1).parquet(source)
    streams.run_available(stream, lambda df, n: ingest.ingest(df, n, store, after), checkpoint)


def tables(spark, store):
    stages = sorted((r["doc_id"], r["stage"], r["state"], r["reason"]) for r in ingest.stages_of(spark, store).collect())
    versions = sorted((r["doc_id"], r["catalog_id"], r["status"], r["is_current"]) for r in ingest.versions_of(spark, store).collect())
    points = sorted((r["point_id"], r["chunk_index"], r["content"]) for r in spark.read.parquet(f"{store}/points").collect())
    catalog = sorted((r["catalog_id"], r["logical_key"], r["name"]) for r in spark.read.parquet(f"{store}/catalog").collect())
    return stages, versions, points, catalog


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Three files of arrivals; the last brings some of the first again, and a file without sentences."""
    source = str(tmp_path_factory.mktemp("arrivals"))
    rows = ingestion.files(spark, SF).where("doc_id < 60").withColumn("version_label", F.lit("v1"))
    again = rows.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 500).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" More."))))
    blank = rows.where("doc_id = 11").withColumn("doc_id", F.lit(600).cast("long")).withColumn("text", F.lit(" \n "))
    types = [c.split(" ") for c in ingest.FILES.split(", ")]
    for part in (rows.where("doc_id < 30"), rows.where("doc_id >= 30"), again.unionByName(blank)):
        part.select(*[F.col(n).cast(t).alias(n) for n, t in types]).coalesce(1).write.mode("append").parquet(source)
    return source


def test_a_killed_stream_ends_with_the_same_tables(spark, arrivals, tmp_path):
    run(spark, arrivals, clean := str(tmp_path / "clean"), str(tmp_path / "c1"))
    stages, versions, points, catalog = want = tables(spark, clean)
    assert {s for _, s, _, _ in stages} >= {"validate", "extract", "identity", "activate"}
    assert len(stages) == 60 + 10 + 1 and len({p for p, _, _ in points}) == len(points)
    assert {(s, r) for i, s, _, r in stages if 500 <= i < 510 and i % 2 == 0} <= {("validate", "duplicate"), ("identity", "same_content by content_hash"), ("validate", "no file"), ("activate", "active"), ("identity", "review by name"), ("identity", "review by code"), ("identity", "review by title")}
    assert [(s, st, r) for i, s, st, r in stages if i == 600] == [("extract", "error", "no content")]
    assert max(sum(st == "active" for _, c, st, _ in versions if c == entry) for entry in {c for _, c, _, _ in versions}) == 1

    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "c2")
    for kill in ((0, "chunk"), (1, "index")):
        with pytest.raises(Exception, match="Killed"):
            run(spark, arrivals, store, checkpoint, kill)
    run(spark, arrivals, store, checkpoint)
    assert tables(spark, store) == want
    run(spark, arrivals, store, checkpoint)  # nothing new has arrived
    assert tables(spark, store) == want


def test_empty_batches_are_harmless(spark, arrivals, tmp_path):
    none = spark.read.schema(ingest.FILES).parquet(arrivals).limit(0)
    ingest.ingest(none, 0, str(tmp_path))
    assert ingest.stages_of(spark, str(tmp_path)).count() == 0
