"""Toxicity by maximum-scoring segments of token log-odds.

* Tokens are lower-cased words. Documents labelled toxic and clean are counted per hashed token at three levels: the first 5
  and 7 bytes of a word, and the whole word. A level's rate of toxic use has a Dirichlet (here
  Beta) prior, centred on the shorter prefix's rate with weight ``prior``; the first on the overall rate. A word's
  score is its log-odds against the overall rate, minus ``drift``, so that ordinary text falls;
  a word that stood among the four before it adds no evidence again.
* Every document is scanned in linear time for its maximal-scoring segments (Ruzzo and Tompa): one left-to-right
  pass in which a segment is merged with an earlier one when the sum in between doesn't fall below. The
  greatest is the document's segment score.
* Segment scores of clean documents follow an extreme-value law: P(S > s) = 1 - exp(-K n exp(-lambda s)) for n tokens.
  lambda solves E[exp(lambda x)] = 1 over the clean token scores; K is fitted on the clean documents. Segments
  with an expected number (E-value) of at most ``significant`` by chance are the toxic passages.
* The score is a logistic fit of two terms: the calibrated greatest segment, and the calibrated sum of all significant segments.

Training uses at most ``most_labels`` labelled rows, chosen by hash of doc_id; nothing but the text enters a score. The tables
have 2**19 slots a level, whatever the corpus.

Edge cases: null and empty texts have no tokens and get the least score of the calibration; without both classes in
the labels every score is the share of toxic labels (0 without labels); a repeated doc_id gets a row each; a null
doc_id is scored; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, byte_values, lower_ascii, small_batches, stash, text_arrays, text_of, word_spans
from .learn import bounded_labels, fit_logistic, gather_counts

_U = np.uint64
SLOTS = 1 << 19
PREFIXES = (5, 7, None)


def token_slots(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """For blocks: documents [i, j), the slots of every word at each level, and each document's first word."""
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        raw = lower_ascii(buf[offs[i] : offs[j]])
        starts, ends, first = word_spans(raw, offs[i : j + 1] - offs[i])
        spans = SpanHash(byte_values(raw))
        slots = []
        for p in PREFIXES:
            stop = ends if p is None else np.minimum(starts + p, ends)
            slots.append(((spans(starts, stop) + _U(0 if p is None else p)) >> _U(45)).astype(np.int64))
        yield i, j, slots, first


def _count(batch: pa.RecordBatch, own: np.ndarray) -> None:
    label = batch.column(1).to_numpy(zero_copy_only=False)
    for i, j, slots, first in token_slots(batch.column(0)):
        toxic = np.repeat(label[i:j], np.diff(first)) == 1
        for level, s in enumerate(slots):
            own[level, 0] += np.bincount(s[~toxic], minlength=SLOTS)
            own[level, 1] += np.bincount(s[toxic], minlength=SLOTS)


class TokenScores:
    def __init__(self, counts: np.ndarray, prior: float, drift: float):
        self.counts = counts.astype(np.float32)
        whole = counts[-1].sum(axis=1)
        self.base = float((whole[1] + 1) / (whole.sum() + 2))
        self.prior, self.drift = prior, drift

    def __call__(self, slots: list[np.ndarray]) -> np.ndarray:
        rate = np.full(len(slots[0]), self.base)
        for level, s in enumerate(slots):
            clean, toxic = self.counts[level, 0][s], self.counts[level, 1][s]
            rate = (toxic + self.prior * rate) / (clean + toxic + self.prior)
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        x = np.log(rate / (1 - rate)) - np.log(self.base / (1 - self.base)) - self.drift
        words, again = slots[-1], np.zeros(len(x), bool)
        for d in (1, 2, 3, 4):
            again[d:] |= words[d:] == words[:-d]
        x[again] = np.minimum(x[again], -self.drift)
        return x


def maximal_segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [a, b) with their scores, after Ruzzo and Tompa; linear in the length."""
    total, found = 0.0, []  # (start, end, sum before, sum through)
    for k, value in enumerate(x.tolist()):
        before, total = total, total + value
        if value <= 0:
            continue
        part = (k, k + 1, before, total)
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= part[2]:
                at = found[at][4]
            if at < 0 or found[at][3] >= part[3]:
                found.append((*part, at))
                break
            part = (found[at][0], part[1], found[at][2], part[3])
            del found[at:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def best_segments(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest segment sum of every document (0 at least), in one vector pass."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    n = np.diff(first)
    if not len(x):
        return np.zeros(len(n))
    # running least prefix inside each document: lift each document far below the one before
    doc = np.repeat(np.arange(len(n)), n)
    reach = float(sums.max() - sums.min()) + 1.0
    least = np.minimum.accumulate(sums[:-1] - doc * reach) + doc * reach
    gain = sums[1:] - least
    out = np.zeros(len(n))
    full = np.flatnonzero(n)
    out[full] = np.maximum(np.maximum.reduceat(gain, first[:-1][full]), 0)
    return out


def extreme_lambda(x: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(lambda x)] = 1, for scores x of negative mean that occur ``weight`` times."""
    x, weight = x[weight > 0], weight[weight > 0]
    if not len(x) or x.max() <= 0 or (x * weight).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda t: np.log((weight * np.exp(np.minimum(t * x, 700))).sum() / weight.sum())
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


SEGMENTS = "doc_id long, n long, best double, significant double, passages array<struct<first:int,last:int,score:double>>"


def segment_scan(docs: DataFrame, scores: TokenScores, lam: float, log_k: float, significant: float, lists: bool = True) -> DataFrame:
    """doc_id, tokens, greatest segment (calibrated), sum of the significant ones (calibrated), and those passages as word ranges (if ``lists``)."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value
        for batch in batches:
            for i, j, slots, first in token_slots(batch.column(1)):
                x, n = score(slots), np.diff(first)
                norm = log_k + np.log(np.maximum(n, 1))
                best = lam * best_segments(x, first) - norm
                total, passages = np.zeros(j - i), [[] for _ in range(j - i)]
                for d in np.flatnonzero(best >= -np.log(significant)).tolist():  # only these can hold a significant passage
                    for a, b, s in maximal_segments(x[first[d] : first[d + 1]]):
                        level = lam * s - norm[d]
                        if level >= -np.log(significant):
                            total[d] += level
                            if lists:
                                passages[d].append({"first": a, "last": b - 1, "score": s})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(best), pa.array(total), pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])))], ["doc_id", "n", "best", "significant", "passages"])

    return docs.mapInArrow(scan, SEGMENTS)


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000, prior: float = 4.0, drift: float = 1.0, significant: float = 0.05) -> DataFrame:
    """doc_id, score, passages (word ranges) of every row; ``labels`` has doc_id and toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = stash(bounded_labels(labels, "toxic", most_labels), "toxic-labels")
    share = known.agg(F.avg("label"), F.count("label")).first()
    if not share[1] or share[0] in (0.0, 1.0):
        return docs.select("doc_id", F.lit(float(share[0] or 0)).alias("score"), F.lit(None).cast("array<struct<first:int,last:int,score:double>>").alias("passages"))
    marked = docs.join(F.broadcast(known), "doc_id")
    # two halves: token tables from each calibrate on the other, so that words seen once don't look certain
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
    counts = [gather_counts(marked.where(half == h).select("text", "label"), _count, (len(PREFIXES), 2, SLOTS)) for h in (0, 1)]
    full = TokenScores(counts[0] + counts[1], prior, drift)
    other = [TokenScores(counts[1 - h], prior, drift) for h in (0, 1)]
    # the law of segment scores, from token scores of clean rows and the segments of all labelled rows
    bins = sum(gather_counts(marked.where(half == h).select("text", "label"), _histogram(spark, other[h]), (BINS,)) for h in (0, 1))
    lam = extreme_lambda(_centres(), bins.astype(float))
    raw = [segment_scan(marked.where(half == h).select("doc_id", "text"), other[h], 1.0, 0.0, significant, lists=False) for h in (0, 1)]
    raw = stash(raw[0].unionByName(raw[1]).select("doc_id", "n", "best").join(F.broadcast(known), "doc_id"), "toxic-raw").select("n", "best", "label").toPandas()
    # best is without law here: best + log n is the plain sum
    clean = (raw["label"] == 0) & (raw["n"] > 0)
    plain = raw["best"] + np.log(np.maximum(raw["n"], 1))
    # half of the clean documents lie below the law's median, where K n exp(-lambda s) = log 2
    log_k = float(np.median(lam * plain[clean] - np.log(raw["n"][clean])) + np.log(np.log(2))) if clean.any() else 0.0
    fit = [segment_scan(marked.where(half == h).select("doc_id", "text"), other[h], lam, log_k, significant, lists=False) for h in (0, 1)]
    fit = fit[0].unionByName(fit[1]).join(F.broadcast(known), "doc_id").select(*_terms(), "label").toPandas()
    w = fit_logistic(fit[["top", "all"]].to_numpy(float), fit["label"].to_numpy(float))
    scored = segment_scan(docs, full, lam, log_k, significant).select("doc_id", "passages", *_terms())
    z = F.lit(float(w[0])) * F.col("top") + F.lit(float(w[1])) * F.col("all") + F.lit(float(w[2]))
    return scored.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "passages")


def _terms() -> list[Column]:
    """The two inputs of the fit: greatest segment, clipped, and the logarithm of the sum of significant ones."""
    return [F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("best"))).alias("top"), F.log1p("significant").alias("all")]


BINS, LEAST, STEP = 4096, -24.0, 1 / 85.0


def _centres() -> np.ndarray:
    return LEAST + (np.arange(BINS) + 0.5) * STEP


def _histogram(spark, scores: TokenScores):
    """Counter of token scores of clean rows by bins of STEP; what lies outside goes to the end bins."""
    shared = spark.sparkContext.broadcast(scores)

    def count(batch: pa.RecordBatch, own: np.ndarray) -> None:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, slots, first in token_slots(batch.column(0)):
            x = shared.value(slots)[np.repeat(label[i:j], np.diff(first)) == 0]
            own += np.bincount(np.clip(((x - LEAST) / STEP).astype(np.int64), 0, BINS - 1), minlength=BINS)

    return count
