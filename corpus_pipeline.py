"""Corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
``documents``; the last returns what is read back from the token files. Between stages rows are written as Parquet.

Edge cases follow the operators': null and empty texts count as empty (the quality stage ranks them last), repeated rows
stay together, a null doc_id is kept by the near-duplicate stage and matches no benchmark row, and
empty tables give empty stages. Mixing repeats a row for each time the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import stash
from doclattice.llm.decontamination import find_leaks
from doclattice.llm.jaccard_join import jaccard_classes
from doclattice.llm.mixing import mix_sources
from doclattice.llm.quality import quality_sample
from doclattice.llm.queries import word_tokenizer
from doclattice.llm.token_output import token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resample draws."""
    drawn = quality_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(F.col("doc_id").alias("drawn_id")).distinct()
    return _columns(docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, the one of least doc_id."""
    gone = jaccard_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return _columns(docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak_id")).distinct()
    return _columns(docs.join(leaks, F.col("doc_id") == F.col("leak_id"), "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of 150% of all words, a row for each copy, shuffled inside its shard."""
    return _columns(mix_sources(_columns(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the wavelet-matrix shards."""
    return token_output(docs, word_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the classifier, the edit-distance search or the tokenizer; tests/llm/test_whole_results.py compares what survives with plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
