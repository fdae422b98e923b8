"""Finding repeated windows of a fixed length across a corpus, without moving the corpus.

Shared by substring dedup over words (FM-index) and suffix-array dedup over bytes (column-wise BWT).

1. ``anchored_runs``: every window of ``length`` units has an anchor, its least ``gram``-unit hash
   (leftmost of equal ones). Neighbouring windows with the same anchor occurrence form a run, whose text is its
   context. Equal windows have equal anchors at equal offsets, so they meet under one anchor.
2. Runs are dealt by anchor hash as packed arrays. Equal contexts meet first inside each part, so a
   frequent line sends one run per part. What remains meets in the anchor's bucket: equal contexts are decided
   there; an anchor with different contexts sends the least document of each context on to be compared.
3. Those contexts are cut from their documents (joined by doc_id), dealt by anchor, and compared
   by the operator's own index, which answers with removed ranges.
4. Ranges are collected per document and applied to its text.

Rows are told apart by a key and documents by key >> shift: the doc_id itself, or, where a doc_id comes with several texts, its
rank among all ids and a number for each text (``keyed``). A document's order is its doc_id; copies of a context
are decided by ``keep_first``: True leaves the context of the least document, False none.

Buckets hold the runs of about ``BUCKET_BYTES`` of text, from the measured size of the corpus, so a worker's memory doesn't grow with
it; tasks send more at once where there are many buckets.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, mix, partitions, stash

_U = np.uint64
_SHIFT = _U(31)  # positions inside a block: 2**31 units
FLUSH_RUNS = 1 << 19
RANGE = "key long, kind byte, at int, len int, offset short, anchor long"


def anchored_runs(values: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """doc, start, windows, anchor offset from start, anchor hash, context hash of every run of a block."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(_U), none.view(_U)
    spans = SpanHash(values)
    grams = spans.grams(gram)
    key = (grams >> _SHIFT << _SHIFT) | np.arange(len(grams), dtype=_U)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    at = (key & ((_U(1) << _SHIFT) - _U(1))).astype(np.int64)  # anchor of each window
    valid = np.zeros(n - length + 2, np.int8)
    room = np.diff(offs) - length
    ok = room >= 0
    np.add.at(valid, offs[:-1][ok], 1)
    np.add.at(valid, offs[:-1][ok] + room[ok] + 1, -1)
    valid = np.cumsum(valid)[:-1].astype(bool)
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    start = np.flatnonzero(first)
    stop = np.concatenate([start[1:], [len(valid)]]) if len(start) else none
    done = np.concatenate([[0], np.cumsum(valid)])
    windows = done[stop] - done[start]
    anchor, offset = at[start], at[start] - start
    context = mix(spans(start, start + windows + length - 1) + (offset * 4096 + windows).astype(_U))
    doc = np.searchsorted(offs, start, "right") - 1
    return doc, start - offs[doc], windows, offset, grams[anchor], context


def _planes(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_runs(doc, start, windows, offset, anchor, context, copied) -> bytes:
    """Rows in order of (doc, start); anchor and context keep 6 bytes each."""
    parts = [_planes(np.diff(doc, prepend=0), "<i8"), _planes(start, "<u4"), _planes(windows.astype(np.uint16) * 2 + copied, "<u2"), _planes(offset, "<u2")]
    raw = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for x in (anchor, context)]
    return struct.pack("<IIIII", len(doc), *map(len, parts)) + b"".join(parts) + b"".join(raw)


def unpack_runs(data: bytes) -> list[np.ndarray]:
    n, *sizes = struct.unpack_from("<IIIII", data)
    at, out = 20, []
    for size, kind in zip(sizes, ("<i8", "<u4", "<u2", "<u2"), strict=True):
        out.append(_unplanes(data[at : at + size], kind))
        at += size
    doc, start, w, offset = np.cumsum(out[0]), out[1].astype(np.int64), out[2].astype(np.int64), out[3].astype(np.int64)
    raw = np.zeros((2, n, 8), np.uint8)
    for k in range(2):
        raw[k, :, :6] = np.frombuffer(data, np.uint8, 6 * n, at + 6 * n * k).reshape(n, 6)
    return [doc, start, w >> 1, offset, raw[0].view("<u8").ravel(), raw[1].view("<u8").ravel(), (w & 1).astype(bool)]


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(at, append=len(x))


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _settle(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs sorted so that equal contexts stand together, least document first: winners, whether their context is copied, the rest."""
    doc, start, _, _, anchor, context, copied = runs
    order = np.lexsort((start, doc, context, anchor))
    at, size = runs_of(anchor[order] ^ mix(context[order]))
    winner = order[at]
    twice = (size > 1) | np.logical_or.reduceat(copied[order], at) if len(at) else np.zeros(0, bool)
    rest = np.ones(len(doc), bool)
    rest[winner] = False
    return winner, twice, rest


BUCKET_BYTES = 8 << 20


def keyed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, key) of the rows with an id, the shift from keys to documents, and the bytes of all texts.

    Equal rows share a key. Only where a doc_id has different texts are ids ranked (by range partitions) and their texts numbered by hash.
    """
    base = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    hashed = base.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("b"))
    each = hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("b").alias("b"))
    size, several = each.agg(F.sum("b"), F.max(F.col("lo") != F.col("hi"))).first()
    if not several:
        return base.withColumn("key", F.col("doc_id")), 0, size or 0
    many = each.where("lo <> hi").select("doc_id")
    nth = hashed.join(many, "doc_id", "left_semi").select("doc_id", "h").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1)
    at = F.monotonically_increasing_id()
    ids = stash(each.select("doc_id").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id").select("doc_id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "repeat-ids")
    before, starts = 0, []
    for r in ids.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    ranks = ids.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, start long")), "part").select("doc_id", (F.col("start") + F.col("row")).alias("rank"))
    full = base.withColumn("h", F.xxhash64("text")).join(nth, ["doc_id", "h"], "left").join(ranks, "doc_id")
    return full.select("doc_id", "text", (F.col("rank") * (1 << 24) + F.coalesce("nth", F.lit(0))).alias("key")), 24, size or 0


def decided_and_open(docs: DataFrame, units: Callable, length: int, gram: int, keep_first: bool, buckets: int, shift: int) -> DataFrame:
    """Rows RANGE: kind 0 is a range of removed units (at, len); kind 1 a run (at, len windows, offset, anchor) to be compared.

    units(column) yields (i, j, values, offsets) for blocks of texts.
    """
    mask, room = _U((1 << 48) - 1), min(max(FLUSH_RUNS, 16 * buckets), 8 * FLUSH_RUNS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            runs = [np.concatenate(x) for x in zip(*held, strict=True)]
            runs.append(np.zeros(len(runs[0]), bool))
            winner, twice, rest = _settle(runs)
            runs[6][winner] = twice
            target = (mix(runs[4]) % _U(buckets)).astype(np.int64)
            # what a part can settle itself passes through the buckets untouched
            settled = rest & ~_same_doc_copies(runs, winner, rest, shift) if keep_first else rest
            for kind, which in ((0, ~settled), (1, settled)):
                pick = np.flatnonzero(which)
                pick = pick[np.lexsort((runs[1][pick], runs[0][pick], target[pick]))]
                at, size = runs_of(target[pick])
                data = [pack_runs(*(c[pick[a : a + k]] for c in runs)) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
                if data:
                    yield _rows("bucket kind data", target[pick[at]].astype(np.int32), np.full(len(at), kind, np.int8), pa.array(data, pa.binary()))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, values, offs in units(batch.column(1)):
                doc, start, windows, offset, anchor, context = anchored_runs(values, offs, length, gram)
                held.append((ids[i:j][doc], start, windows, offset, anchor & mask, context & mask))
                if sum(len(x[0]) for x in held) >= room:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        out = []
        fixed = [unpack_runs(x.as_py()) for x, k in zip(table["data"], kinds, strict=True) if k == 1]
        loose = [unpack_runs(x.as_py()) for x, k in zip(table["data"], kinds, strict=True) if k == 0]
        if fixed:
            r = [np.concatenate(c) for c in zip(*fixed, strict=True)]
            out.append(_removed(r[0], r[1], r[2] + length - 1))
        if loose:
            r = [np.concatenate(c) for c in zip(*loose, strict=True)]
            winner, twice, rest = _settle(r)
            alike = _same_doc_copies(r, winner, rest, shift) if keep_first else np.zeros(len(rest), bool)
            gone = rest & ~alike
            if not keep_first:
                gone[winner[twice]] = True
            pick = np.flatnonzero(gone)
            out.append(_removed(r[0][pick], r[1][pick], r[2][pick] + length - 1))
            # anchors with different contexts go on
            at, size = runs_of(r[4][winner])
            mixed = r[4][winner[at[size > 1]]]
            going = alike.copy()
            going[winner] = True
            pick = np.flatnonzero(going & np.isin(r[4], mixed))
            out.append((r[0][pick], np.where(gone[pick], 2, 1).astype(np.int8), r[1][pick], r[2][pick], r[3][pick], r[4][pick]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t)) for c, t in zip(cols, (np.int64, np.int8, np.int32, np.int32, np.int16, np.int64), strict=True)], names=["key", "kind", "at", "len", "offset", "anchor"])

    rows = docs.select("key", "text").mapInArrow(scan, "bucket int, kind byte, data binary")
    return rows.groupBy("bucket").applyInArrow(meet, RANGE)


def _removed(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    none = np.zeros(len(doc), np.int8)
    return doc, none, at, size, none, none


def _same_doc_copies(runs: list[np.ndarray], winner: np.ndarray, rest: np.ndarray, shift: int) -> np.ndarray:
    """Rows of ``rest`` in the document of their context's winner: not removed for being copies."""
    key = runs[4] ^ mix(runs[5])
    order = np.argsort(key[winner])
    least = runs[0][winner[order]][np.searchsorted(key[winner[order]], key)]
    return rest & (runs[0] >> shift == least >> shift)


def open_contexts(base: DataFrame, decided: DataFrame, units: Callable, length: int, symbol: str, buckets: int) -> DataFrame:
    """Cut the runs to be compared from their texts: rows (bucket, data), packed, dealt by anchor."""
    per_doc = decided.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("at", "len", "offset", "kind", "anchor")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            head = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
            body = np.concatenate([h[1] for h in held])
            sizes = head[2] + length - 1
            first = np.cumsum(sizes) - sizes
            to = (mix(head[5].view(_U)) >> _U(16)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            at, size = runs_of(to[order])
            data = []
            for a, k in zip(at.tolist(), size.tolist(), strict=True):
                pick = order[a : a + k]
                n = sizes[pick]
                take = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                parts = [_planes(head[c][pick], t) for c, t in enumerate(("<i8", "<u4", "<u2", "<u2", "<u2", "<i8"))] + [body[take].astype(symbol).tobytes()]
                data.append(struct.pack("<I6I", k, *map(len, parts[:6])) + b"".join(parts))
            yield _rows("bucket data", to[order][at].astype(np.int32), pa.array(data, pa.binary()))

        for batch in batches:
            lists = batch.column(2)
            ends, flat = np.asarray(lists.offsets), lists.flatten()
            cols = [flat.field(c).to_numpy() for c in range(5)]
            base_at = int(ends[0])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, values, offs in units(batch.column(1)):
                lo, hi = int(ends[i]) - base_at, int(ends[j]) - base_at
                if lo == hi:
                    continue
                row = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                start, windows, offset, kind, anchor = (c[lo:hi] for c in cols)
                fits = start.astype(np.int64) + windows + length - 1 <= np.diff(offs)[row - i]
                row, start, windows, offset, kind, anchor = (c[fits] for c in (row, start, windows, offset, kind, anchor))
                n = windows.astype(np.int64) + length - 1
                take = np.repeat(offs[row - i] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held.append(((ids[row], start.astype(np.int64), windows.astype(np.int64), offset.astype(np.int64), kind.astype(np.int64), anchor), values[take]))
            if sum(len(h[1]) for h in held) * np.dtype(symbol).itemsize >= 16 << 20:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return base.join(per_doc, "key").select("key", "text", "runs").mapInArrow(cut, "bucket int, data binary")


def unpack_contexts(column: pa.ChunkedArray, symbol: str) -> tuple[list[np.ndarray], np.ndarray]:
    """key, start, windows, offset, kind, anchor of the contexts of a bucket, and their units one after another."""
    heads, bodies = [], []
    for cell in column:
        data = cell.as_py()
        _, *sizes = struct.unpack_from("<I6I", data)
        at, head = 28, []
        for size, kind in zip(sizes, ("<i8", "<u4", "<u2", "<u2", "<u2", "<i8"), strict=True):
            head.append(_unplanes(data[at : at + size], kind).astype(np.int64))
            at += size
        heads.append(head)
        bodies.append(np.frombuffer(data, symbol, offset=at))
    return [np.concatenate(c) for c in zip(*heads, strict=True)], np.concatenate(bodies)


def window_ranges(doc: np.ndarray, start: np.ndarray, row: np.ndarray, window: np.ndarray, length: int) -> pa.Table:
    """Found windows (context row, window number) as ranges (key, at, len), neighbours merged."""
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(first)
    size = np.diff(at, append=len(row))
    return pa.table([pa.array(doc[row[at]]), pa.array((start[row[at]] + window[at]).astype(np.int32)), pa.array((size + length - 1).astype(np.int32))], names=["key", "at", "len"])


def removed_ranges(docs: DataFrame, units: Callable, compare: Callable, length: int, gram: int, keep_first: bool, symbol: str, raw: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with an id and their key, removed ranges of each key as ranges array<struct<at, len>>)."""
    base, shift, size = keyed(docs)
    buckets = max(4 * partitions(docs.sparkSession), size // BUCKET_BYTES)
    decided = stash(decided_and_open(base, units, length, gram, keep_first, buckets, shift), "repeats")
    contexts = open_contexts(base, decided, raw or units, length, symbol, buckets)

    def answer(table: pa.Table) -> pa.Table:
        head, body = unpack_contexts(table["data"], symbol)
        row, window = compare([head[0] >> shift, *head[1:]], body)
        return window_ranges(head[0], head[1], row, window, length)

    compared = contexts.groupBy("bucket").applyInArrow(answer, "key long, at int, len int")
    ranges = decided.where("kind = 0").select("key", "at", "len").unionByName(compared)
    return base, ranges.groupBy("key").agg(F.collect_list(F.struct("at", "len")).alias("ranges"))


def apply_ranges(docs: DataFrame, base: DataFrame, ranges: DataFrame, apply: Callable, schema: str) -> DataFrame:
    """apply(doc ids, texts, lists of ranges) -> rows of ``schema``, over every document; null ids are compared with nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield apply(batch.column(0), batch.column(1), batch.column(2))

    joined = base.join(ranges, "key", "left").select("doc_id", "text", "ranges")
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<struct<at:int,len:int>>").alias("ranges"))
    return joined.unionByName(nameless).mapInArrow(work, schema)


def covered(n: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mask of the units that ranges cover."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.minimum(at, n), 1)
    np.add.at(marks, np.minimum(at + size, n), -1)
    return np.cumsum(marks[:-1]) > 0
