"""Importance resampling towards a target distribution: hashed n-gram gains, Gumbel noise, and a cut found by bracketing.

* Features are all runs of one to three consecutive words, repeats counted, by the CRC-32 of their bytes modulo
  ``buckets``. The CRC of a run is put together from its words' (a CRC is linear), so every word is read once.
* The raw model counts all documents, the target model all target texts. A bucket's gain is a whole number; the array of
  gains is broadcast (``buckets`` numbers) and a document's weight is the sum over its features.
* weight plus a Gumbel variate seeded by doc_id is the score; of the documents with at least ``least_words`` words the
  share ``share`` with the highest scores is drawn.
* The cut is found without sorting the scores: a quantile sketch proposes a bracket around the k-th, exact counts outside
  of it validate or widen it, and only a bracket of at most ``most_sorted`` values is sorted. Ties at the cut are settled in
  the same way by doc_id. Only drawn rows are sorted for their rank, by ranges.

Edge cases: null and empty texts have no features and weigh 0; a null doc_id is hashed as an empty string and comes after
the others among equal scores; rows of a repeated doc_id are rows of their own, equal in all that is returned but
rank; without target texts all counts of the target are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, lower_ascii, small_batches, stash, text_arrays, word_spans
from .learn import gather_counts

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SHORT = 64


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 byte table; the maps that append 0 to 63 zero bytes, and 2**k zero bytes, each as four byte tables."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    step = lambda c: table[c & 255] ^ (c >> np.uint32(8))
    maps = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])]
    for _ in range(SHORT - 1):
        maps.append(step(maps[-1]))
    powers = [maps[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return table, np.stack(maps), np.stack(powers)


def _apply(maps: np.ndarray, c: np.ndarray) -> np.ndarray:
    return maps[0][c & 255] ^ maps[1][(c >> 8) & 255] ^ maps[2][(c >> 16) & 255] ^ maps[3][c >> 24]


TABLE, MAPS, POWERS = _crc_tables()
SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC of a string that goes on for ``length`` bytes."""
    short = np.minimum(length, SHORT - 1)
    out = MAPS[short, 0, crc & 255] ^ MAPS[short, 1, (crc >> 8) & 255] ^ MAPS[short, 2, (crc >> 16) & 255] ^ MAPS[short, 3, crc >> 24]
    for i in np.flatnonzero(length >= SHORT):
        c, left, k = crc[i : i + 1], int(length[i]), 0
        while left:
            c = _apply(POWERS[k], c) if left & 1 else c
            left, k = left >> 1, k + 1
        out[i] = c[0]
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span."""
    length = ends - starts
    order = np.argsort(np.minimum(length, SHORT).astype(np.uint8), kind="stable")[::-1]
    n_long = int(np.count_nonzero(length >= SHORT))
    out = np.empty(len(starts), np.uint32)
    for i in order[:n_long]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    order = order[n_long:]
    at, size, crc = starts[order], length[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-size, -np.arange(SHORT), "left")  # how many words are longer than j
    for j in range(SHORT):
        n = more[j]
        if not n:
            break
        crc[:n] = TABLE[(crc[:n] ^ buf[at[:n] + j]) & 255] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """For blocks of documents [i, j): each document's first word (and the end), and the buckets of runs of 1 to 3 words
    by their first word, -1 where the document ends before."""
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        raw = lower_ascii(buf[offs[i] : offs[j]])
        starts, ends, first = word_spans(raw, offs[i : j + 1] - offs[i], BETWEEN)
        one = word_crcs(raw, starts, ends)
        after = shifted(np.full(len(one), SPACE, np.uint32), ends - starts) ^ one  # a blank and the word
        doc, crc, runs = np.repeat(np.arange(j - i), np.diff(first)), one, []
        for k in range(min(3, len(one))):
            if k:
                crc = shifted(crc[:-1], (ends - starts)[k:] + 1) ^ after[k:]
            bucket = np.full(len(one), -1, np.int64)
            bucket[: len(crc)] = np.where(doc[: len(crc)] == doc[k:], (crc % np.uint32(buckets)).astype(np.int64), -1)
            runs.append(bucket)
        yield i, j, first, runs


def feature_counts(rows: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batch: pa.RecordBatch, own: np.ndarray) -> None:
        for _, _, _, runs in features(batch.column(0), buckets):
            for bucket in runs:
                own += np.bincount(bucket[bucket >= 0], minlength=buckets)

    return gather_counts(rows.select(F.col(f"`{text}`").cast("string").alias("text")), count, (buckets,))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of target to raw, smoothed by one."""
    n, of_raw, of_target = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (of_raw + n) / ((s + 1.0) * (of_target + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    known = docs.sparkSession.sparkContext.broadcast(gain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.append(known.value, 0)  # bucket -1
        for batch in batches:
            for i, j, first, runs in features(batch.column(1), len(value) - 1):
                n = np.diff(first)
                total = np.zeros(first[-1] + 1, np.int64)
                for bucket in runs:
                    total[1:] += value[bucket]
                total = np.cumsum(total)
                count = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(count), pa.array(total[first[1:]] - total[first[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(scan, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, from the first 32 bits of a SHA-256 digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# ---------------------------------------------------------------- the cut


def kth_value(rows: DataFrame, key: str, k: int, accuracy: int = 10_000, most_sorted: int = 100_000) -> tuple[int, int]:
    """The k-th least value (k from 1) of a long column without nulls, and the number of rows below it."""
    value, below, part, n = F.col(key), 0, rows, rows.count()
    while True:
        slack = 2.0 / accuracy
        while True:
            ends = [max(0.0, k / n - slack), min(1.0, k / n + slack)]
            lo, hi = part.agg(F.percentile_approx(value, ends, accuracy)).first()[0]
            if slack >= 1:  # the whole of it
                lo, hi = part.agg(F.min(value), F.max(value)).first()
            under, upto = part.agg(F.count_if(value < lo), F.count_if(value <= hi)).first()
            if under < k <= upto:
                break
            slack *= 8
        if lo < hi and upto - under == n:  # ties leave nothing to cut away: halve the values instead
            mid = (lo + hi) // 2
            low = part.where(value <= mid).count()
            lo, hi, under, upto = (lo, mid, 0, low) if k <= low else (mid + 1, hi, low, n)
        if lo == hi:
            return lo, below + under
        below, k, n, part = below + under, k - under, upto - under, part.where(value.between(lo, hi))
        if n <= most_sorted:
            for r in part.groupBy(value.alias("v")).count().orderBy("v").collect():
                if k <= r["count"]:
                    return r["v"], below
                below, k = below + r["count"], k - r["count"]


def least_rows(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition that holds for the k least rows by ``keys``, long columns without nulls that tell all rows apart."""
    cut, part, left = [], rows, k
    for key in keys:
        v, under = kth_value(part, key, left)
        cut.append((key, v))
        part, left = part.where(F.col(key) == v), left - under
        if part.count() == left:  # all that tie with the cut are within
            break
    met = F.lit(True)
    for key, v in reversed(cut):
        met = (F.col(key) < v) | ((F.col(key) == v) & met)
    return met


def numbered(rows: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` with their place in the order of ``keys``: ranges are sorted apart, and a range starts where the one before ends."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stash(ranges.withColumn("at", F.monotonically_increasing_id()), "numbered")
    sizes = dict(placed.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    starts, total = [], start
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    begins = F.broadcast(spark.createDataFrame(starts or [(0, start)], "range_no long, range_start long"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("range_start")
    return placed.join(begins, F.shiftright("at", 33) == F.col("range_no")).withColumn(name, place).drop("at", "range_no", "range_start")


def target_resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight and score, with the rank of those drawn (null for others)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    keys = {"k_score": -F.col("score"), "k_null": F.col("doc_id").isNull().cast("long"), "k_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "k_row": F.monotonically_increasing_id()}
    rated = stash(weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumns(keys), "resample-scores")
    able = rated.where(F.col("n_words") >= least_words)
    n = able.count()
    k = share[0] * n // share[1]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rated.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (least_rows(able, list(keys), k) if k < n else F.lit(True))
    ranked = numbered(rated.where(drawn), list(keys), "rank")
    return rated.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*columns, F.col("rank").cast("long").alias("rank")))
