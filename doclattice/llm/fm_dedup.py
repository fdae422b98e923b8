"""Substring dedup of words: remove each word under a window of 35 words that also stands anywhere else.

Contexts that share an anchor but differ (see ``repeats``) are dealt into shards by anchor. Each shard is a compressed
FM-index: a wavelet matrix of the Burrows-Wheeler transform of all its contexts over the shard's own word
numbers. The contexts stream through it: backward search extends every window to the left until its interval
holds a single occurrence, its own; the matching statistic of a position is how far that goes, and windows that reach the
threshold stand elsewhere too. Equal contexts were decided while they met, so the index holds each once.

Words are compared by 64-bit hashes.

Edge cases: null and blank texts have no words; texts under 35 words are kept, their words joined by one
space; windows never cross documents; a window repeated inside its own document counts; rows of a
repeated doc_id are texts of their own (equal ones remove each other); a null doc_id is kept whole and removes
nothing; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, text_arrays, text_of, word_hashes, word_spans
from .repeats import apply_ranges, covered, removed_ranges, runs_of
from .wavelet import WaveletMatrix

LENGTH, GRAM = 35, 8
_ROUND = 1 << 19  # words of a shard


def word_units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        raw = buf[offs[i] : offs[j]]
        starts, ends, first = word_spans(raw, offs[i : j + 1] - offs[i])
        yield i, j, word_hashes(raw, starts, ends), first


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        k *= 2
        if k >= depth:
            return order
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = fresh


class FMIndex:
    """Over texts of symbols 1.., each followed by a 0; patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        order = suffix_array(text, depth)
        self.bits = max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.bwt = WaveletMatrix.build(text[order - 1], self.bits)
        self.n = len(text)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of pattern."""
        both = self.bwt.locate(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.first[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, text: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """How far left of each end position text[..end] reaches while it occurs twice, ``most`` at most."""
        size = np.zeros(len(end), np.int64)
        live, lo, hi = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), self.n)
        for step in range(most):
            lo, hi = self.extend(text[end[live] - step], lo, hi)
            twice = hi - lo > 1
            live, lo, hi = live[twice], lo[twice], hi[twice]
            if not len(live):
                break
            size[live] += 1
        return size


def standing_elsewhere(head: list[np.ndarray], body: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows, of contexts not removed yet, that stand elsewhere."""
    _, _, windows, _, kind, anchor = head
    sizes = windows + length - 1
    first = np.cumsum(sizes) - sizes
    by_anchor = np.argsort(anchor, kind="stable")
    ends = np.cumsum(runs_of(anchor[by_anchor])[1])
    words = np.cumsum(sizes[by_anchor])
    rows, found, at = [], [], 0
    while at < len(by_anchor):  # a shard takes whole anchors
        goal = (words[at - 1] if at else 0) + _ROUND
        stop = int(ends[np.searchsorted(ends, min(max(np.searchsorted(words, goal), at + 1), len(by_anchor)))])
        part, at = by_anchor[at:stop], stop
        if not (kind[part] == 1).any():
            continue
        n = sizes[part]
        begin = np.cumsum(n + 1) - (n + 1)
        text = np.zeros(int((n + 1).sum()), np.int64)
        to = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text[to] = np.unique(body[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_inverse=True)[1] + 1
        index = FMIndex(text, length + 1)
        ask = np.flatnonzero(kind[part] == 1)
        w = windows[part[ask]]
        row = np.repeat(ask, w)
        window = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        hit = index.matching(text, begin[row] + window + length - 1, length) == length
        rows.append(part[row[hit]])
        found.append(window[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *found])


def _cut(ids: pa.Array, texts: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    buf, offs = text_arrays(texts)
    ends, flat = np.asarray(lists.offsets), lists.flatten()
    at, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    out = []
    for i in range(len(ids)):
        words = buf[offs[i] : offs[i + 1]].tobytes().split()
        n, removed = len(words), 0
        a, b = int(ends[i] - ends[0]), int(ends[i + 1] - ends[0])
        if a < b and lists[i].is_valid:
            gone = covered(n, at[a:b], size[a:b])
            removed = int(gone.sum())
            words = compress(words, (~gone).tolist())
        out.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
    cols = list(zip(*out, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_word_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, their keys with removed word ranges)."""
    return removed_ranges(docs, word_units, lambda head, body: standing_elsewhere(head, body, length), length, gram, False, "<u8")


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base, ranges = repeated_word_ranges(docs, length, gram)
    return apply_ranges(docs, base, ranges, _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
