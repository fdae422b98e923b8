"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

* Two hashed n-gram models are counted: byte 4-grams in 2**16 buckets or more (``byte_buckets``), and 3-grams of recency (how
  many words ago, up to four, each word last stood), which see text that repeats itself. The raw model counts every
  document; the target model counts all those labelled good.
* A document's importance is its log ratio of target to raw, as a mean for each model. A logistic fit on the
  labelled rows turns the two means into the log-odds that a document is of the target.
* The resample draws without replacement by Gumbel top-k: the k greatest of ``sharpness`` * log-odds plus
  a Gumbel variate, seeded by doc_id. k is the expected number of target documents, the sum of
  the probabilities over all rows. The k-th value is found by counting key digits, not by sorting into one task.

Edge cases: null and empty texts have no n-grams and get the log-odds of the least mean seen in training, so
they rank last; equal keys go by doc_id; a repeated doc_id gives a row each (rows of equal text are drawn
together or by count at the edge); null doc_id is drawn last of its ties; with no usable labels (none, or of one
class) every row stays; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, stash, text_arrays, text_of, tidy, word_hashes, word_spans
from .learn import bounded, distinct_labels, fit_logistic, gather_counts

_U = np.uint64
RECENT = 125


def byte_buckets(n_bytes: int) -> int:
    """2**16 buckets up to 100 MB, then as the square root of the corpus, as the number of different n-grams grows slower than it; 2**22 at most, as tasks and driver hold them all."""
    return 1 << min(22, 16 + max(0, (max(1, n_bytes) // 100_000_000).bit_length()) // 2)


def features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks: documents [i, j); byte-gram buckets with their document; recency-gram buckets with theirs."""
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        raw, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = max(0, len(raw) - 3)
        value = sum(raw[k : n + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) if n else np.zeros(0, np.uint32)
        gram = (value * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())
        doc = np.repeat(np.arange(j - i), np.diff(at))
        own = doc[:n] == doc[3 : n + 3]
        starts, ends, first = word_spans(raw, at)
        words = word_hashes(raw, starts, ends)
        wdoc = np.repeat(np.arange(j - i), np.diff(first))
        last = np.zeros(len(words), np.int64)
        for d in (4, 3, 2, 1):
            last[d:][(words[d:] == words[:-d]) & (wdoc[d:] == wdoc[:-d])] = d
        m = max(0, len(words) - 2)
        recent = last[:m] * 25 + last[1 : m + 1] * 5 + last[2 : m + 2]
        near = wdoc[:m] == wdoc[2 : m + 2]
        yield i, j, gram[own], doc[:n][own], recent[near], wdoc[:m][near]


def _counter(buckets: int):
    def count(batch: pa.RecordBatch, own: np.ndarray) -> None:
        label = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float), nan=-1)
        for i, j, gram, doc, recent, wdoc in features(batch.column(0), buckets):
            good = label[i:j] == 1
            own[0, :buckets] += np.bincount(gram, minlength=buckets)
            own[0, buckets:] += np.bincount(recent, minlength=RECENT)
            if good.any():
                own[1, :buckets] += np.bincount(gram[good[doc]], minlength=buckets)
                own[1, buckets:] += np.bincount(recent[good[wdoc]], minlength=RECENT)

    return count


def log_ratio(counts: np.ndarray) -> np.ndarray:
    out, buckets = [], counts.shape[1] - RECENT
    for part in (counts[:, :buckets], counts[:, buckets:]):
        p = np.log(part + 1.0) - np.log(part.sum(axis=1, keepdims=True) + part.shape[1])
        out.append(p[1] - p[0])
    return np.concatenate(out).astype(np.float32)


SCORES = "doc_id long, bytes_mean double, recent_mean double, n long"


def importance(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, mean log ratio of each model, number of byte grams."""
    known = docs.sparkSession.sparkContext.broadcast(ratio)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, buckets = known.value, len(known.value) - RECENT
        for batch in batches:
            for i, j, gram, doc, recent, wdoc in features(batch.column(1), buckets):
                n, m = np.bincount(doc, minlength=j - i), np.bincount(wdoc, minlength=j - i)
                a = np.bincount(doc, w[gram], j - i) / np.maximum(n, 1)
                b = np.bincount(wdoc, w[buckets + recent], j - i) / np.maximum(m, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(a), pa.array(b), pa.array(n)], ["doc_id", "bytes_mean", "recent_mean", "n"])

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), SCORES)


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def top_k(rows: DataFrame, key: str, k: int, digits: int = 12) -> DataFrame:
    """The k rows of greatest non-negative long ``key``: its cut is found digit by digit from counts; ties go by doc_id, nulls last."""
    at, prefix, left = 64, 0, k
    total = rows.count()
    if k >= total:
        return rows
    if k <= 0:
        return rows.limit(0)
    found = rows
    while at > 0:
        step = min(digits, at)
        at -= step
        digit = F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << step) - 1))
        counts = {r[0]: r[1] for r in found.groupBy(digit.alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                break
            left -= counts[d]
        prefix = (prefix << step) | d
        found = found.where(digit == d)
    above = rows.where(F.col(key) > F.lit(prefix))
    return above.unionByName(rows.where(F.col(key) == F.lit(prefix)).orderBy(F.col("doc_id").asc_nulls_last()).limit(left))


def order_key(x: Column) -> Column:
    """A non-negative long that orders as the double x, clipped to +-2000, with 2**-40 steps."""
    return (F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), x)) * F.lit(float(1 << 40)) + F.lit(2001.0 * (1 << 40))).cast("long")


def quality_sample(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000, most_broadcast: int = 2_000_000, sharpness: float = 4.0, seed: int = 11) -> DataFrame:
    """The rows drawn: doc_id, log_odds, probability."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    every = stash(distinct_labels(labels, "quality"), "quality-labels")
    known = stash(bounded(every, most_labels), "quality-sample")
    buckets = byte_buckets(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # few labels are broadcast and the documents stay where they are; more are joined by a shuffle, and either way one scan counts both models
    few = every.count() <= most_broadcast
    marked = docs.join(F.broadcast(every) if few else every, "doc_id", "left").select("text", "label")
    counts = gather_counts(marked, _counter(buckets), (2, buckets + RECENT))
    scores = stash(importance(docs, log_ratio(counts)), "quality-scores")
    sample = scores.join(F.broadcast(known), "doc_id").where("n > 0").select("bytes_mean", "recent_mean", "n", "label").toPandas()
    x = sample[["bytes_mean", "recent_mean"]].to_numpy(float)
    y = sample["label"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        return scores.select("doc_id", F.lit(0.0).alias("log_odds"), F.lit(1.0).alias("probability"))
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    clip = lambda v: np.clip((v - mean) / std, -4, 4)
    w = fit_logistic(clip(x), y)
    lowest = float((clip(x) @ w[:2] + w[2]).min())
    term = [F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (c - F.lit(float(m))) / F.lit(float(s)))) * F.lit(float(k)) for c, m, s, k in zip((F.col("bytes_mean"), F.col("recent_mean")), mean, std, w[:2], strict=True)]
    odds = F.when(F.col("n") > 0, sum(term[1:], term[0]) + F.lit(float(w[2]))).otherwise(F.lit(lowest))
    rated = scores.select("doc_id", odds.alias("log_odds")).withColumn("probability", 1 / (1 + F.exp(-F.col("log_odds"))))
    gumbel = -F.log(-F.log(uniform(F.col("doc_id"), seed)))
    keyed = stash(rated.withColumn("key", order_key(F.col("log_odds") * sharpness + gumbel)), "quality-keys")
    k = int(round(keyed.agg(F.sum("probability")).first()[0] or 0))
    return top_k(keyed, "key", k).drop("key")
