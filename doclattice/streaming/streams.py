"""Incremental forms: where documents go on, replay-safe inputs, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("validate", "extract", "chunk", "identity", "register", "embed", "index", "validate_index", "activate")


def resume_stage(rows: DataFrame) -> DataFrame:
    """Where a failed document goes on: without chunks at extract, with fewer points than chunks at embed, else at validate_index."""
    stage = F.when(F.coalesce("chunks", F.lit(0)) == 0, "extract").when(F.coalesce("points", F.lit(0)) < F.col("chunks"), "embed").otherwise("validate_index")
    return rows.withColumn("resume_at", stage)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; timestamps without zone are read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def once_only(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of files without replays of a hash inside the watermark."""
    return files.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["file_hash"])


def read_folder(spark: SparkSession, path: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived and stop; ``sink`` gets each batch with its number, which makes retries idempotent."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


DONE, STOPPED = ("ok", "skipped"), ("error", "review", "duplicate")


def next_stages(runs: DataFrame) -> DataFrame:
    """Where every document goes on, from its stage runs (doc_id, stage, state, seq): the first stage that isn't done; none and ``stopped`` if its last state stops it."""
    latest = runs.groupBy("doc_id", "stage").agg(F.max_by("state", "seq").alias("state"))
    g = latest.groupBy("doc_id").agg(F.collect_set(F.when(F.col("state").isin(*DONE), F.col("stage"))).alias("done"), F.max(F.col("state").isin(*STOPPED)).alias("stopped"))
    todo = F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: ~F.array_contains("done", s))
    return g.select("doc_id", F.size("done").alias("n_done"), "stopped", F.when(~F.col("stopped"), F.try_element_at(todo, F.lit(1))).alias("next_stage"))


def hydrate(failed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Failed documents (doc_id, status) with the chunks and points that the store has of them, and where they go on."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("point_id").alias("points"))
    return resume_stage(failed.where("status = 'failed'").join(n, "doc_id", "left"))
