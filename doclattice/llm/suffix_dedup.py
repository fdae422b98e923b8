"""Suffix-array dedup of bytes: remove every byte under a 50-byte string that also starts in a document of a smaller doc_id.

The suffix order is built column by column over a collection of short texts: contexts that share
an anchor (see ``repeats``), aligned on it. Each round inserts one symbol of every context, from right
to left: the contexts' order (the collection's Burrows-Wheeler transform is the column of symbols in
that order) is updated by a stable sort on the new symbol, and the common prefixes by 1 + a range minimum of the
old ones. Equal windows sit in one column, as their anchor has one offset, so after each round runs
of common prefixes of 50 or more are exactly the equal windows that start there; all but those of the
least document are removed. Only contexts that differ under a shared anchor are sorted; equal ones were decided
while they met. Spark's shuffle and written tables are the sequential external files: sorting whole documents of
100,000 symbols would take as many passes over the corpus as the longest document has bytes.

Edge cases: null counts as empty; texts under 50 bytes are kept; matches never cross documents;
rows of one doc_id are one document, which removes nothing of itself, and each row of different text has its own ranges; a null doc_id is kept whole and
removes nothing; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_values, small_batches, text_arrays, text_of
from .repeats import apply_ranges, covered, removed_ranges, runs_of

LENGTH, GRAM = 50, 16
_ROUND = 1 << 15


def byte_units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        yield i, j, byte_values(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]


def raw_units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _range_min(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(lcp[lo..hi]) of each pair, lo <= hi, from doubling tables."""
    if not len(lo):
        return np.zeros(0, lcp.dtype)
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(lo), lcp.dtype)
    table, width = lcp, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def columnwise(offset: np.ndarray, sizes: np.ndarray, body: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds from the last column to the first: (column, contexts in suffix order, common prefix with the one before, at most length)."""
    first = np.cumsum(sizes) - sizes
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    ends = np.argsort(-(sizes - offset), kind="stable")  # by last column, greatest first
    last, new = (sizes - offset)[ends] - 1, 0
    for column in range(int(last[0]), -int(offset.max()) - 1, -1):
        going = column + offset[order] >= 0
        if not going.all():  # contexts that have no symbol left of here leave
            kept = np.flatnonzero(going)
            before = np.concatenate([[-1], kept[:-1]])
            lcp = _range_min(lcp, before + 1, kept)
            order = order[kept]
            lcp[:1] = 0
        stop = int(np.searchsorted(-last, -column, "right"))
        if stop > new:  # contexts that end here enter with the empty suffix
            order = np.concatenate([ends[new:stop], order])
            lcp = np.concatenate([np.zeros(stop - new, np.uint8), lcp])
            new = stop
        symbol = body[first[order] + column + offset[order]]
        to = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[to]
        same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1])
        fresh = np.zeros(len(to), np.uint8)
        fresh[same + 1] = np.minimum(_range_min(lcp, to[same] + 1, to[same + 1]), length - 1) + 1
        order, lcp = order[to], fresh
        yield column, order, lcp


def smaller_elsewhere(head: list[np.ndarray], body: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of every window that also starts in a smaller document."""
    doc, _, windows, offset, _, anchor = head
    rows, found = [], []
    by_anchor = np.argsort(anchor, kind="stable")
    sizes = windows + length - 1
    first = np.cumsum(sizes) - sizes
    at = 0
    ends = np.cumsum(runs_of(anchor[by_anchor])[1])
    while at < len(by_anchor):  # whole anchors, about _ROUND contexts at a time
        stop = int(ends[min(np.searchsorted(ends, at + _ROUND), len(ends) - 1)])
        part, at = by_anchor[at:stop], stop
        n = sizes[part]
        take = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for column, order, lcp in columnwise(offset[part], n, body[take], length):
            starts, size = runs_of(np.cumsum(lcp < length))
            if (size > 1).any():
                least = np.repeat(np.minimum.reduceat(doc[part[order]], starts), size)
                window = column + offset[part[order]]
                hit = (doc[part[order]] > least) & (window < windows[part[order]])
                rows.append(part[order[hit]])
                found.append(window[hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *found])


def _cut(ids: pa.Array, texts: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    buf, offs = text_arrays(texts)
    ends, flat = np.asarray(lists.offsets), lists.flatten()
    at, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    out = []
    for i in range(len(ids)):
        text = buf[offs[i] : offs[i + 1]]
        a, b = int(ends[i] - ends[0]), int(ends[i + 1] - ends[0])
        if a == b or not lists[i].is_valid:
            out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            continue
        gone = covered(len(text), at[a:b], size[a:b])
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, their keys with removed byte ranges)."""
    return removed_ranges(docs, byte_units, lambda head, body: smaller_elsewhere(head, body, length), length, gram, True, "<u1", raw_units)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base, ranges = suffix_ranges(docs, length, gram)
    return apply_ranges(docs, base, ranges, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
