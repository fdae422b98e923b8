"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after deleting space and control characters 0x09-0x0D.
Of equal texts the row with most code points in the original text stays, then the
smallest doc_id (a null id comes after all others).

Every grouping key holds the digest *and* the full normalised text:

1. Spark's map-side aggregation merges equal texts inside each input partition;
2. groups are merged per (digest, text, salt), so no key of a few texts fills a task;
3. at most ``salts`` salt winners per text meet in the last merge.

A digest that stands for two texts would show as two groups of one digest; those rows
alone are matched by full text instead of digest.

Edge cases: null text counts as empty; all empty and blank texts form one group; rows
that repeat a doc_id count as separate rows; empty input gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, text_of

BLANK = " \t\n\x0b\x0c\r"
_IDS = "9223372036854775807"


def normalised(text: str = "text") -> Column:
    return F.translate(text_of(text), BLANK, "")


def _rank(doc_id: Column, length: Column) -> Column:
    """Orders by length, then by falling doc_id; null id last. One decimal, so that hash aggregation can keep it."""
    wide = "decimal(38,0)"
    turned = F.coalesce(F.lit(_IDS).cast(wide) - doc_id.cast("decimal(20,0)"), F.lit(-1).cast(wide))
    return (length.cast("decimal(11,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")).cast(wide) + (turned + F.lit(1)).cast("decimal(21,0)")


def _id_of(rank: Column) -> Column:
    inverse = (rank % F.lit("100000000000000000000").cast("decimal(21,0)")) - F.lit(1)
    return F.when(inverse >= 0, (F.lit(_IDS).cast("decimal(38,0)") - inverse).cast("long"))


def exact_dedup(docs: DataFrame, digest=lambda norm: F.sha2(norm, 256), salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``digest`` is a parameter so that tests can force collisions."""
    docs = docs.select("doc_id", "text")
    texts = docs.select("doc_id", F.char_length(text_of()).alias("len"), normalised().alias("norm"))
    keyed = texts.withColumn("digest", digest(F.col("norm")))
    ranked = keyed.select("digest", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), _rank(F.col("doc_id"), F.col("len")).alias("rank"))
    merged = ranked.groupBy("digest", "norm", "salt").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
    winners = merged.groupBy("digest", "norm").agg(F.sum("n").alias("group_size"), F.max("rank").alias("rank"))
    groups = stash(winners.select("digest", F.sha2("norm", 256).alias("text_sha256"), "group_size", "rank"), "exact-groups")

    collided = groups.groupBy("digest").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("digest")
    some = not collided.isEmpty()
    narrow = keyed.select("doc_id", "digest")
    out = narrow.join(groups.join(collided, "digest", "left_anti") if some else groups, "digest")
    if some:
        by_text = winners.select("digest", "norm", F.sha2("norm", 256).alias("text_sha256"), "group_size", "rank").join(collided, "digest", "left_semi")
        out = out.unionByName(keyed.select("doc_id", "digest", "norm").join(by_text, ["digest", "norm"]).select(*out.columns))
    keep = _id_of(F.col("rank"))
    kept = F.col("doc_id").eqNullSafe(keep)
    return out.select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
