"""Sinks: partitioned tables, keyed overwrites and append logs in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="doclattice-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, by: list[str]) -> None:
    """Append rows, a folder for each value of ``by``; one writer a value, so that files stay large."""
    df.repartition(*[F.col(c) for c in by]).write.mode("append").partitionBy(*by).parquet(path)


def overwrite_keys(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df holds: a retried batch gives the same table."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_artifacts(blocks: DataFrame, path: str) -> None:
    """Extracted blocks as JSON, a folder for each document; a document's files are replaced as a whole."""
    blocks.repartition("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").json(path)


def staging_to_extract(pages: DataFrame) -> DataFrame:
    """Recognised pages (doc_id, page as text, text_normalized, text_raw, confidence) as extracted blocks: normalised text first, pages in order of number."""
    text = F.coalesce(F.nullif("text_normalized", F.lit("")), F.nullif("text_raw", F.lit("")), F.lit(""))
    return pages.select("doc_id", F.col("page").cast("int").alias("page"), text.alias("text"), "confidence", (text == "").alias("needs_ocr"))


def write_manifest(files: DataFrame, path: str) -> DataFrame:
    """Write the files of a manifest as JSON lines and return its counters: total, included, by state of extension."""
    files.write.mode("overwrite").json(path)
    return files.agg(F.count("*").alias("total"), F.count_if(F.coalesce("included", F.lit(True))).alias("included"), F.count_if(F.col("state") == "ready").alias("ready"))
