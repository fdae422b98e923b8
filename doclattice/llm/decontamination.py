"""Benchmark decontamination: documents that hold a benchmark passage within a fifth of its words in edits.

Texts are sequences of words: runs of letters and digits in lower case (A-Z and the Latin letters of U+00C0 to U+00DE), signs and
blanks left out; each CJK character is a word. An item of n words is found in a document where some part of it is within
k = n // 5 word edits (insert, delete, substitute).

1. Embedding: the CGK walk reads a sequence, emits its current word and steps on or not by a random bit of (step, word). Two
   sequences within few edits fall back in step after each, so edit distance becomes Hamming distance. Every window of a
   document, one at each word and as long as the item it is held against, is embedded by ``walks`` walks. An item is embedded
   from each of its words on, so that a match whose first words are changed still meets it.
2. Bit sampling: each walk has ``tables`` tables. A table's key is the emitted words of the first and three more sampled steps
   (of ``steps``); windows that share ``least`` keys with an item at one shift are candidates. The numbers are set so that windows at the limit of
   k edits are met with a recall of 0.95 or more (measured in the tests at the limit: random edits, evenly spread
   substitutions).
3. Verification: exact semi-global edit distance of item and window with k words of margin, so nothing but recall depends on chance.
   A window beyond k that shares a key for each word of the item, and half of its words, is compared once more, now with words of four letters or more equal that are
   within one letter of each other; this finds items of ``SHORT`` words or more with a letter changed in many words (measured: one in four; such windows
   share more than a key a word, others a handful by chance).

Items of fewer than ``SHORT`` words leave too few steps to sample: they are cut into k + 1 pieces, of which one must stand
unchanged, and any window with a piece is verified: exact, with nothing left to chance. Items under 5 words match exactly only.

The benchmark is read in blocks of at most ``block_bytes`` of text, one after another, so what driver and tasks hold of it is
bounded (about 60 times the block); documents are read once for each block and never shuffled, whatever their text. The
work grows with documents times blocks, not items: each window costs one look-up a table.

Edge cases: null and empty texts hold nothing; items without words match nothing; equal items are all reported; repeated doc_ids
give one row each; of several matches of an item in a document the nearest, then the first, is reported; a null
doc_id or item_id is reported as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, lower_ascii, mix, small_batches, stash, text_arrays, text_of, tidy, word_hashes

_U = np.uint64
MATCHES = "doc_id long, item_id long, distance int, item_words int, end_word int"
SHORT = 10
LONGEST = 64  # letters of a word that is compared letter by letter

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and each text's first word (n + 1)."""
    n = len(buf)
    raw = lower_ascii(buf)
    after_c3 = np.flatnonzero(buf[:-1] == 0xC3) + 1
    after_c3 = after_c3[(buf[after_c3] >= 0x80) & (buf[after_c3] <= 0x9E) & (buf[after_c3] != 0x97)]
    raw[after_c3] += 0x20
    inside = _WORD[raw]
    for lead, size in ((0xC2, 2), (0xE2, 3)):  # signs of U+0080 to U+00BF and U+2000 to U+2FFF
        at = np.flatnonzero(buf == lead)
        for k in range(size):
            inside[np.minimum(at + k, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    wide = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9))
    edge[wide] = True
    edge[np.minimum(wide + 3, n)] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return raw, starts, ends, np.searchsorted(starts, offs)


def word_sequences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts with a 0 after each text, and where each text begins (n + 1)."""
    if not len(buf):
        return np.zeros(len(offs) - 1, _U), np.arange(len(offs))
    raw, starts, ends, first = word_spans(buf, offs)
    begin = first + np.arange(len(first))
    out = np.zeros(int(begin[-1]), _U)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(offs) - 1), np.diff(first))] = word_hashes(raw, starts, ends) | _U(1)
    return out, begin


class Walks:
    """CGK embeddings and sampled keys; the same for items and windows."""

    def __init__(self, walks: int, tables: int, steps: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 62, walks).astype(_U) * _U(2) + _U(1)
        self.samples = [[tuple(np.cumsum(rng.integers(2, max(3, steps // 3) + 1, 3)).tolist()) for _ in range(tables)] for _ in range(walks)]

    def positions(self, words: np.ndarray, walk: int) -> dict[int, np.ndarray]:
        """Where the walk from every word stands at each sampled step; a text's closing 0 holds it."""
        wanted = {s for steps in self.samples[walk] for s in steps}
        bits = np.where(words == 0, _U(0), mix(words * self.odd[walk]) >> _U(32)).astype(np.uint32)
        at, out = np.arange(len(words), dtype=np.int32), {}
        for step in range(max(wanted) + 1):
            if step in wanted:
                out[step] = at.copy()
            at += ((bits[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
        return out

    def keys(self, words: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """For every table: number, places of its samples after the first."""
        number = 0
        for walk, tables in enumerate(self.samples):
            at = self.positions(words, walk)
            for steps in tables:
                yield number, tuple(at[s] for s in steps)
                number += 1


_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))


def key32(words: np.ndarray, samples: tuple[np.ndarray, ...]) -> np.ndarray:
    """A 32-bit key of the words at every place and at its samples."""
    key = words * _FACTORS[0]
    for x, factor in zip(samples, _FACTORS[1:]):
        key += words[x] * factor
    return key ^ (key >> np.uint32(15))


def full_key(words: np.ndarray, at: np.ndarray, samples: tuple[np.ndarray, ...]) -> np.ndarray:
    key = words[at]
    for x in samples:
        key = mix(key) * _U(3) + words[x[at]]
    return mix(key)


class Table:
    """Sorted 64-bit keys with their item and offset, behind a bitmap of 32-bit keys."""

    def __init__(self, small: np.ndarray, full: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(full, kind="stable")
        self.full, self.item, self.offset = full[order], item[order].astype(np.int32), offset[order].astype(np.int32)
        self.shift = np.uint32(32 - min(28, max(16, int(len(full) * 32).bit_length())))
        self.hit = np.zeros(1 << (32 - int(self.shift)), bool)
        self.hit[small >> self.shift] = True

    def find(self, small: np.ndarray, full) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """place, item, offset of equal keys; full(places) gives their 64-bit keys."""
        at = np.flatnonzero(self.hit[small >> self.shift])
        key = full(at)
        lo, hi = np.searchsorted(self.full, key, "left"), np.searchsorted(self.full, key, "right")
        n = hi - lo
        which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[which], self.offset[which]


class Items:
    """The index of a block of items: rows of (item_id, text)."""

    def __init__(self, rows: list, walks: int = 4, tables: int = 8, steps: int = 15, least: int = 4, seed: int = 5):
        self.ids = [r[0] for r in rows]
        self.raw = raw = [(r[1] or "").encode() for r in rows]
        self.spelled: dict[int, tuple[list[str], dict[str, set[int]]]] = {}
        words, begin = word_sequences(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        self.words, self.begin, self.sizes = words, begin, np.diff(begin) - 1
        self.walks, self.least = Walks(walks, tables, steps, seed), least
        item = np.repeat(np.arange(len(rows)), np.diff(begin))
        offset = np.arange(len(words)) - begin[:-1][item]
        low = (words >> _U(32)).astype(np.uint32)
        self.tables = []
        if (self.sizes >= SHORT).any():
            for _, samples in self.walks.keys(words):  # the last sample lies inside the item
                good = np.flatnonzero((words[samples[-1]] != 0) & (self.sizes[item] >= SHORT))
                self.tables.append(Table(key32(low, samples)[good], full_key(words, good, samples), item[good], offset[good]))
        spans, pieces = SpanHash(words), {}
        for i, n in enumerate(self.sizes.tolist()):
            if 0 < n < SHORT:
                cuts = [j * n // (n // 5 + 1) for j in range(n // 5 + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    pieces.setdefault(b - a, []).append((int(spans(begin[i : i + 1] + a, begin[i : i + 1] + b)[0]), i, a))
        self.pieces = {size: Table(*(lambda key, i, a: ((key >> _U(32)).astype(np.uint32), key, i, a))(*(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (_U, np.int64, np.int64), strict=True)))) for size, rows in pieces.items()}

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, start (place in ``words`` that meets the item's first word) and number of shared keys of distinct candidate windows."""
        low, found = (words >> _U(32)).astype(np.uint32), []
        if self.tables:
            for number, samples in self.walks.keys(words):
                at, item, offset = self.tables[number].find(key32(low, samples), lambda p: full_key(words, p, samples))  # noqa: B023
                found.append((item.astype(np.int64), at - offset))
        spans = SpanHash(words)
        for size, table in self.pieces.items():
            key = spans.grams(size)
            at, item, offset = table.find((key >> _U(32)).astype(np.uint32), lambda p: key[p])  # noqa: B023
            found.append((item.astype(np.int64), at - offset))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, start = (np.concatenate(c) for c in zip(*found, strict=True))
        key, hits = np.unique(item * (1 << 40) + start + (1 << 39), return_counts=True)
        some = (hits >= self.least) | (self.sizes[key >> 40] < SHORT)
        key, hits = key[some], hits[some]
        return key >> 40, (key & ((1 << 40) - 1)) - (1 << 39), hits

    def letters(self, item: int) -> tuple[list[str], dict[str, set[int]]]:
        """Words of an item, and the places of those that are one deletion from a spelling."""
        if item not in self.spelled:
            spelled, near = spell(np.frombuffer(self.raw[item], np.uint8)), {}
            for i, w in enumerate(spelled):
                for v in spellings(w):
                    near.setdefault(v, set()).add(i)
            self.spelled[item] = spelled, near
        return self.spelled[item]

    def near_misses(self, words: np.ndarray, item: int, lo: int, hi: int, window: Callable[[], list[str]]) -> tuple[int, int]:
        """Distance and end of a window whose words are off by a letter here and there; only windows with half of the item's words are looked at."""
        n = int(self.sizes[item])
        own = self.words[self.begin[item] : self.begin[item] + n]
        if 2 * np.count_nonzero(np.isin(own, words[lo:hi])) < n:
            return 1 << 30, 0
        spelled, near = self.letters(item)
        equal = own[:, None] == words[None, lo:hi]
        for j, w in enumerate(window()):
            for i in set().union(*(near.get(v, ()) for v in spellings(w))):
                equal[i, j] = equal[i, j] or one_letter(spelled[i], w)
        best, end = semiglobal(np.arange(1, n + 1)[None], np.array([n]), equal, np.array([n // 5]))
        return int(best[0]), int(end[0])

    def matches(self, words: np.ndarray, begin: np.ndarray, window: Callable[[int, int, int], list[str]] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """text, item, distance, end word of every verified window of texts that begin at ``begin``; window(text, lo, hi) spells the words there; without it words are equal or not, and none are compared letter by letter."""
        item, start, hits = self.candidates(words)
        n = self.sizes[item]
        k = n // 5
        # the text of a candidate: that of the window's middle, which lies inside any match
        text = np.searchsorted(begin, np.clip(start + n // 2, 0, max(0, len(words) - 1)), "right") - 1
        lo, hi = np.maximum(start - k, begin[text]), np.minimum(start + n + k, begin[text + 1] - 1)
        same = np.zeros(len(n), bool)
        for i in np.flatnonzero((n > 256) & (lo <= start) & (hi >= start + n)).tolist():  # long exact copies need no table of distances
            same[i] = np.array_equal(words[start[i] : start[i] + n[i]], self.words[self.begin[item[i]] : self.begin[item[i]] + n[i]])
        if same.any():
            yield text[same], item[same], np.zeros(int(same.sum()), np.int64), (start + n - begin[text])[same]
        some = np.flatnonzero((hi - lo >= n - k) & ~same)
        order = some[np.argsort(-n[some], kind="stable")]
        at = 0
        while at < len(order):  # batches of about 2 million cells
            width = int(n[order[at]] + 2 * k[order[at]])
            pick = order[at : at + max(1, (1 << 21) // max(1, width))]
            at += len(pick)
            cells = lo[pick][:, None] + np.arange(width)
            rows = np.where(cells < hi[pick][:, None], words[np.minimum(cells, len(words) - 1)], _U(0))
            width = int(n[pick[0]])
            cells = self.begin[item[pick]][:, None] + np.arange(width)
            patterns = self.words[np.minimum(cells, len(self.words) - 1)]
            best, end = semiglobal(patterns, n[pick], rows, k[pick])
            for c in np.flatnonzero((best > k[pick]) & (n[pick] >= SHORT) & (hits[pick] >= n[pick])).tolist() if window else []:  # others share a few keys by chance
                p = pick[c]
                best[c], end[c] = self.near_misses(words, int(item[p]), int(lo[p]), int(hi[p]), lambda: window(int(text[p]), int(lo[p]), int(hi[p])))  # noqa: B023
            near = best <= k[pick]
            pick = pick[near]
            yield text[pick], item[pick], best[near], lo[pick] + end[near] - begin[text[pick]]


def spell(buf: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> list[str]:
    """Words as lower-case strings: all of a text, or those of the given spans of bytes that are lower case already."""
    if starts is None:
        buf, starts, ends, _ = word_spans(buf, np.array([0, len(buf)])) if len(buf) else (buf, np.zeros(0, np.int64), np.zeros(0, np.int64), None)
    return [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]


def spellings(word: str) -> list[str]:
    """A word and what is left of it without one letter: two words within one letter share one of them. Words under four letters have none."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))] if 4 <= len(word) <= LONGEST else []


def one_letter(a: str, b: str) -> bool:
    """Whether one insertion, deletion or substitution of a letter at most makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def semiglobal(patterns: np.ndarray, sizes: np.ndarray, rows: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each pattern (of ``sizes``) to any part of its row, and where the first such part ends; any value above
    ``most`` where it is greater. A 0 in a row equals nothing. With one pattern, ``rows`` may be a table of which of its words equals which.
    """
    table = rows if rows.dtype == bool else None
    m, width = (1, rows.shape[1]) if table is not None else rows.shape
    ramp = np.arange(width + 1, dtype=np.int16 if width < 1 << 14 else np.int32)
    live, prev = np.arange(m), np.zeros((m, width + 1), ramp.dtype)
    best, end = np.full(m, 1 << 30), np.zeros(m, np.int64)
    for i in range(1, int(sizes.max(initial=0)) + 1):
        now = np.empty_like(prev)
        now[:, 0] = i
        np.minimum(prev[:, :-1] + (rows != patterns[:, i - 1 : i] if table is None else ~table[i - 1 : i]), prev[:, 1:] + ramp.dtype.type(1), out=now[:, 1:])
        now -= ramp
        prev = np.minimum.accumulate(now, axis=1, out=now)
        prev += ramp
        done = sizes == i
        if done.any():
            best[live[done]], end[live[done]] = prev[done].min(axis=1), prev[done].argmin(axis=1)
        if done.any() or i % 6 == 0:  # the least value of a row never falls
            keep = ~done & (prev.min(axis=1) <= most)
            live, prev, patterns, sizes, most = live[keep], prev[keep], patterns[keep], sizes[keep], most[keep]
            rows = rows[keep] if table is None else rows
            if not len(live):
                break
    return best, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, walks: int = 4, tables: int = 8, steps: int = 15, least: int = 4, seed: int = 5, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, distance, item_words, end_word (words of the document up to the match's end): the best match of each item in each document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * size // block_bytes))
    out = None
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, walks, tables, steps, least, seed))
        found = docs.mapInArrow(tidy(_scanner(shared)), MATCHES)
        if n_blocks > 1:  # one block at a time
            found = stash(found, "leaks")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            buf, offs = text_arrays(batch.column(1))
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for i, j in blocks(offs):
                part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                words, begin = word_sequences(part, at)
                spans: list = []

                def window(text: int, lo: int, hi: int) -> list[str]:
                    if not spans:
                        spans.extend(word_spans(part, at))  # noqa: B023
                    return spell(spans[0], spans[1][lo - text : hi - text], spans[2][lo - text : hi - text])  # noqa: B023

                for doc, item, distance, end in known.matches(words, begin, window):
                    for d, t, e, p in zip((doc + i).tolist(), item.tolist(), distance.tolist(), end.tolist(), strict=True):
                        best[d, t] = min(best.get((d, t), (1 << 30, 0)), (e, p))
            if best:
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for (d, _), _ in rows])), pa.array([known.ids[t] for (_, t), _ in rows], pa.int64()), pa.array([e for _, (e, _) in rows], pa.int32()), pa.array([int(known.sizes[t]) for (_, t), _ in rows], pa.int32()), pa.array([p for _, (_, p) in rows], pa.int32())], ["doc_id", "item_id", "distance", "item_words", "end_word"])

    return scan
