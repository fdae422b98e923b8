"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 0.8 or more.

Method (token-combination prefixes):

* ``summary`` gives each document's set size and set digest; documents of one digest are one node.
* Document frequencies of all shingles are counted exactly in hash buckets of packed arrays.
  A shingle of frequency 1 can't be shared, so only shared ones return to their documents.
* Shingles are ordered by frequency class, rare first. At most e = n // 5 shingles of a set of n
  may be missing in a partner; its unshared ones use up part of that. The prefix is extended until
  it holds e + 1 - unshared more: rare shingles (at most ``rare`` documents) count one each and
  are indexed alone; frequent ones fall by hash into classes, whose number depends on the
  size band, count one less than their number in each class, and are indexed as pairs. Whichever
  of two similar sets has the earlier prefix end, some rare shingle or pair then lies in both.
* Lists of a rare shingle hold at most ``rare`` documents: all their pairs are verified. In the lists of
  pairs, one pivot is verified against all members. Lists that then hold several components are settled by ``rest_links``: documents outside the largest component are compared with
  all of their group in blocks, so no link between different texts of different components stays unseen and no
  pair of a group becomes a row.
* Verification counts the exact overlap of the shared shingles (56-bit hashes of shingles).

Hash buckets hold about ``BUCKET`` hashes each, from the measured number of all shingles, so that a worker's memory
doesn't grow with the corpus; tasks send more at once where there are many buckets. Shingles of more than a thousandth of all
documents, the ``MAX_HOT`` most frequent of them at most, are found first, are broadcast, and don't enter the buckets.

Edge cases: null and blank texts have an empty set and link with nothing; fewer than five words
make one shingle of the whole sequence; words are lower-cased for A-Z only; repeated rows
of a document get the same result; a doc_id that comes with different texts is one document that links by each of them; a null doc_id gets a null component; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, blocks, discard, lower_ascii, mix, partitions, small_batches, stash, text_arrays, text_of, tidy, tidy_group, tidy_groups, word_hashes, word_spans
from .components import components

_U = np.uint64
FLUSH = 1 << 19  # hashes held by a task before they are sorted and sent
BUCKET = 1 << 20  # hashes of a bucket
MAX_HOT = 4_000_000  # 32 MB of hashes
OWN_IDS = -(1 << 62)  # ids of rows whose doc_id has several texts go down from here


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of texts: first text, end, sorted distinct 56-bit shingle hashes, and each text's offsets in them."""
    buf, offs = text_arrays(column)
    for i, j in blocks(offs):
        raw, at = lower_ascii(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(raw, at)
        words = SpanHash(word_hashes(raw, starts, ends))
        n = np.diff(first)
        sizes = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(j - i), sizes)
        s = first[:-1][doc] + np.arange(begin[-1]) - begin[doc]
        h = (words(s, np.minimum(s + width, first[1:][doc])) + np.minimum(n, width)[doc].astype(_U)) >> _U(8)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield i, j, h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=j - i))])


def _digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1234567, 0x89ABCDEF0):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h + _U(salt)), dtype=_U)])
        out.append(mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(_U)).view(np.int64))
    return out[0], out[1]


def _batch(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names.split())


def summary(docs: DataFrame) -> DataFrame:
    """kind 0: id, n, d1, d2 of every row; kind 1: a shingle (d1) that n documents of some part share, if that is a good part of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs = [], 0

        def counts() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, n_docs / 2000)
            k = int(often.sum())
            if k:
                yield _batch("kind id n d1 d2", np.ones(k, np.int8), pa.nulls(k, pa.int64()), n[often].astype(np.int64), h[often].view(np.int64), np.zeros(k, np.int64))

        for batch in batches:
            for i, j, h, off in shingle_sets(batch.column(1)):
                d1, d2 = _digests(h, off)
                yield _batch("kind id n d1 d2", np.zeros(j - i, np.int8), batch.column(0).slice(i, j - i), np.diff(off), d1, d2)
                held.append(h)
                n_docs += j - i
                if sum(map(len, held)) >= FLUSH:
                    yield from counts()
                    held, n_docs = [], 0
        if held:
            yield from counts()

    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(tidy(scan), "kind byte, id long, n long, d1 long, d2 long")


def _pack(ids: np.ndarray, counts: np.ndarray, h: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Documents (rising ids as deltas), how many hashes each has, the hashes as 7 bytes, and a byte with each."""
    z = zstandard.ZstdCompressor(level=1)
    delta = np.diff(ids, prepend=0)
    a, b = z.compress(delta.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()), z.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    c = b"" if extra is None else extra.astype(np.uint8).tobytes()
    return struct.pack("<IIII", len(ids), len(a), len(b), len(h)) + a + b + np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes() + c


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each hash, the hashes, and the bytes (empty if none)."""
    n, a, b, k = struct.unpack_from("<IIII", data)
    z, at = zstandard.ZstdDecompressor(), 16
    ids = np.cumsum(np.ascontiguousarray(np.frombuffer(z.decompress(data[at : at + a]), np.uint8).reshape(8, n).T).view("<i8").ravel())
    counts = np.ascontiguousarray(np.frombuffer(z.decompress(data[at + a : at + a + b]), np.uint8).reshape(4, n).T).view("<u4").ravel()
    at += a + b
    h = np.zeros((k, 8), np.uint8)
    h[:, :7] = np.frombuffer(data, np.uint8, 7 * k, at).reshape(k, 7)
    return np.repeat(ids, counts), h.view("<u8").ravel(), np.frombuffer(data, np.uint8, offset=at + 7 * k)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal runs."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(at, append=len(x))


def _deal(ids: np.ndarray, h: np.ndarray, to: np.ndarray, extra: np.ndarray | None, kind: int, names: str) -> Iterator[pa.RecordBatch]:
    """Rows (to, kind, payload), one for each target."""
    order = np.lexsort((ids, to))
    ids, h, to = ids[order], h[order], to[order]
    extra = None if extra is None else extra[order]
    at, size = _runs(to)
    data = []
    for a, n in zip(at.tolist(), size.tolist(), strict=True):
        d, c = _runs(ids[a : a + n])
        data.append(_pack(ids[a : a + n][d], c, h[a : a + n], None if extra is None else extra[a : a + n]))
    yield _batch(names, to[at].astype(np.int32), np.full(len(at), kind, np.int8), pa.array(data, pa.binary()))


def frequency_class(df: np.ndarray) -> np.ndarray:
    return np.minimum(4 * np.log2(df), 250).astype(np.uint8)


HOT_CLASS = 255


def shared_shingles(docs: DataFrame, hot: np.ndarray, buckets: int, parts: int) -> DataFrame:
    """Rows (part, kind, data): packed shared shingles with their frequency classes, dealt by document."""
    spread = docs.sparkSession.sparkContext.broadcast(hot)
    room = min(max(FLUSH, 16 * buckets), 4 * FLUSH)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, h, sizes, d1, d2 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, d2, d1))  # of equal sets in this part only the least id goes on
            again = np.zeros(len(ids), bool)
            again[order[1:]] = (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
            ids, h = np.repeat(ids, np.where(again, 0, sizes)), h[np.repeat(~again, sizes)]
            if not len(h):
                return
            top = spread.value
            known = top[np.minimum(np.searchsorted(top, h), len(top) - 1)] == h if len(top) else np.zeros(len(h), bool)
            if known.any():  # passed through, spread by document
                yield from _deal(ids[known], h[known], (mix(ids[known].view(_U)) % _U(buckets)).astype(np.int64), None, 1, "bucket kind data")
            if not known.all():
                yield from _deal(ids[~known], h[~known], (h[~known] % _U(buckets)).astype(np.int64), None, 0, "bucket kind data")

        for batch in batches:
            for i, j, h, off in shingle_sets(batch.column(1)):
                ids = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                held.append((ids, h, np.diff(off), *_digests(h, off)))
                if sum(len(x[1]) for x in held) >= room:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            rows = [_unpack(x.as_py()) for x, k in zip(table["data"], table["kind"].to_pylist(), strict=True) if k == kind]
            if not rows:
                continue
            ids, h = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            cls = np.full(len(h), HOT_CLASS, np.uint8)
            if kind == 0:
                order = np.argsort(h, kind="stable")
                ids, h = ids[order], h[order]
                _, size = _runs(h)
                df = np.repeat(size, size)
                ids, h, cls = ids[df > 1], h[df > 1], frequency_class(df[df > 1])
            if len(h):
                out += _deal(ids, h, (mix(ids.view(_U)) >> _U(20)).astype(np.int64) % parts, cls, 0, "part kind data")
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    rows = docs.select("doc_id", "text").mapInArrow(tidy(scan), "bucket int, kind byte, data binary")
    return rows.groupBy("bucket").applyInArrow(tidy_group(count), "part int, kind byte, data binary")


def band(n: int) -> int:
    return n.bit_length() - 1


def signatures(n: int, h: np.ndarray, cls: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Single-shingle and pair signatures of a set of n with the shared shingles h, ordered by class and hash."""
    need = n // 5 + 1 - (n - len(h))
    none = np.zeros(0, np.int64)
    if need <= 0 or n < 4:  # sets of 3 or less link with equal ones only
        return none, none
    n_rare = int(np.searchsorted(cls, frequency_class(np.array([rare]))[0], "right"))
    ones = h[: min(n_rare, need)]
    if need <= n_rare:
        return ones.view(np.int64), none
    need, often = need - n_rare, h[n_rare:]
    pairs = []
    for b in sorted({band(n), band(-(-4 * n // 5))}):
        if b < 3:
            pairs.append(mix(often[:need] + _U(0x5EED)))
            continue
        group = (mix(often) % _U(1 << (b - 3))).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at, size = _runs(group[order])
        first = np.zeros(len(often), bool)
        first[order[at]] = True  # the first of each class doesn't count
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        order = order[order < end]
        at, size = _runs(group[order])
        for a, k in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            x = often[order[a : a + k]]
            i, j = np.triu_indices(k, 1)
            pairs.append(mix(mix(x[i]) * _U(3) + x[j] + _U(b)))
    return ones.view(np.int64), (np.unique(np.concatenate(pairs)).view(np.int64) if pairs else none)


def candidates(shared: DataFrame, reps: DataFrame, buckets: int, rare: int) -> DataFrame:
    """Sets that can have a partner: id, n, shingles (packed), ones, pairs."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary()), ("ones", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64()))])
        rows = [_unpack(x.as_py()) for x in left["data"]]
        if not rows or not right.num_rows:
            return schema.empty_table()
        ids, h, cls = (np.concatenate([r[k] for r in rows]) for k in range(3))
        r_id, r_n = right["id"].to_numpy(), right["n"].to_numpy()
        r_order = np.argsort(r_id)
        r_id, r_n = r_id[r_order], r_n[r_order]
        order = np.lexsort((h, cls, ids))
        ids, h, cls = ids[order], h[order], cls[order]
        at, size = _runs(ids)
        out: list[tuple] = []
        where = np.searchsorted(r_id, ids[at])
        for a, k, w in zip(at.tolist(), size.tolist(), where.tolist(), strict=True):
            if w == len(r_id) or r_id[w] != ids[a]:
                continue
            x, c, n = h[a : a + k], cls[a : a + k], int(r_n[w])
            ones, pairs = signatures(n, x, c, rare)
            if len(ones) or len(pairs):
                out.append((int(ids[a]), n, np.sort(x).astype("<u8").tobytes(), ones, pairs))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    keyed = reps.select("id", "n", F.lit(None).cast("int").alias("part")).mapInArrow(lambda it: _with_part(it, buckets), "part int, id long, n long")
    return shared.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(tidy_groups(build), "id long, n int, shingles binary, ones array<long>, pairs array<long>")


def _with_part(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        part = (mix(b.column(0).to_numpy(zero_copy_only=False).view(_U)) >> _U(20)).astype(np.int64) % buckets
        yield _batch("part id n", part.astype(np.int32), b.column(0), b.column(1))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of u, v, their set sizes and their shared shingles: the pairs that link."""
    for batch in batches:
        keep = []
        for nu, nv, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
            common = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
            keep.append(100 * common >= 80 * (nu + nv - common))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that link, by exact overlap."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(tidy(_overlaps), "u long, v long")


def _fits(a: str, b: str) -> str:
    return f"5 * {a} >= 4 * {b} AND 5 * {b} >= 4 * {a}"


def rare_pairs(sets: DataFrame) -> DataFrame:
    """All pairs of the lists of rare shingles, each of which holds at most ``rare`` documents by its frequency."""
    lists = sets.select("id", "n", F.explode("ones").alias("sig")).groupBy("sig").agg(F.collect_list(F.struct("id", "n")).alias("m")).where("size(m) > 1")
    return lists.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where(f"x.id < y.id AND {_fits('x.n', 'y.n')}").select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))


def pivot_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of the least document of every list with its other members."""
    pivots = postings.groupBy("sig").agg(F.min_by(F.struct("id", "n"), "id").alias("p"))
    return postings.join(pivots, "sig").where(f"id <> p.id AND {_fits('n', 'p.n')}").select(F.col("p.id").alias("u"), F.col("id").alias("v"))


def with_labels(postings: DataFrame, stars: DataFrame) -> DataFrame:
    return postings.join(stars.select(F.col("u").alias("id"), "v"), "id", "left").select("sig", "id", "n", F.coalesce("v", "id").alias("label"))


def rest_links(postings: DataFrame, stars: DataFrame, sets: DataFrame, buckets: int, block: int = 250_000) -> DataFrame:
    """All links left between members of lists that hold several components.

    Documents that such lists connect form a group. Of two documents in different components one at least is outside
    the group's largest component, so these outsiders are compared with the whole group, in blocks of about ``block`` shingles
    by matrix products. No pair becomes a row: each outsider returns one link for each component it meets in a block.
    """
    labelled = with_labels(postings, stars)
    several = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("head")).where("lo <> hi").select("sig", "head")
    member = stash(labelled.join(several, "sig").groupBy("id", "label", "n", "head").count().drop("count"), "jaccard-open")
    groups = components(member.select(F.col("id").alias("u"), F.col("head").alias("v")))
    docs = member.select("id", "label", "n").distinct().join(groups.select(F.col("u").alias("id"), F.col("v").alias("g")), "id", "left").withColumn("g", F.coalesce("g", "id"))
    docs = stash(docs, "jaccard-grouped")
    sizes = docs.groupBy("g", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    sizes = sizes.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("t").alias("t"), F.max_by("t", F.struct("c", "label")).alias("main_t"))
    sizes = sizes.select("g", "main", F.ceil(F.col("t") / block).cast("int").alias("nj"), F.ceil(F.greatest(F.lit(1), F.col("t") - F.col("main_t")) / block).cast("int").alias("ni"))
    full = docs.join(sizes, "g").join(sets.select("id", "shingles"), "id")
    block_of = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    outer = full.where("label <> main").select("*", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), block_of(1, "ni").alias("i"), F.lit(True).alias("out"))
    inner = full.select("*", block_of(2, "nj").alias("j"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.lit(False).alias("out"))
    rows = outer.unionByName(inner).select(F.pmod(F.xxhash64("g", "i", "j"), F.lit(buckets)).cast("int").alias("bucket"), "g", "i", "j", "out", "id", "label", "n", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        at = np.lexsort([table[c].to_numpy() for c in ("j", "i", "g")])
        table = table.take(pa.array(at))
        g, i, j = (table[c].to_numpy() for c in ("g", "i", "j"))
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])).tolist()
        for a, b in zip(new, [*new[1:], len(g)], strict=True):
            part, out = table.slice(a, b - a), table["out"].slice(a, b - a)
            found.update(block_links(part.filter(out), part.filter(pc.invert(out))))
        u, v = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = stash(rows.groupBy("bucket").applyInArrow(tidy_group(compare), "u long, v long").distinct(), "jaccard-links")
    discard(member, groups, docs)
    return links


def block_links(a: pa.Table, b: pa.Table, columns: int = 4096) -> list[tuple[int, int]]:
    """Links of the documents a with b, one for each component of b."""
    if not len(a) or not len(b):
        return []
    tokens = [[np.frombuffer(x, "<u8") for x in side["shingles"].to_pylist()] for side in (a, b)]
    sizes = [np.array([len(t) for t in side]) for side in tokens]
    flat = [np.concatenate(side) for side in tokens]
    both = np.intersect1d(flat[0], flat[1])
    rows, cols = [], []
    for f, n in zip(flat, sizes, strict=True):
        where = np.searchsorted(both, f)
        where[where == len(both)] = 0
        hit = both[where] == f if len(both) else np.zeros(len(f), bool)
        rows.append(np.repeat(np.arange(len(n)), n)[hit])
        cols.append(where[hit])
    (na, la, ia), (nb, lb, ib) = ([side[c].to_numpy() for c in ("n", "label", "id")] for side in (a, b))
    first = {}
    for top in range(0, len(a), 1024):  # rows of a at a time, so that a block of many small sets stays small
        common = np.zeros((min(1024, len(a) - top), len(b)), np.float32)
        for lo in range(0, len(both), columns):
            part = []
            for r, c, n, base in ((rows[0], cols[0], len(common), top), (rows[1], cols[1], len(b), 0)):
                m = np.zeros((n, min(columns, len(both) - lo)), np.float32)
                inside = (c >= lo) & (c < lo + columns) & (r >= base) & (r < base + n)
                m[r[inside] - base, c[inside] - lo] = 1
                part.append(m)
            common += part[0] @ part[1].T
        common = np.rint(common).astype(np.int64)
        i, j = np.nonzero((100 * common >= 80 * (na[top : top + len(common), None] + nb[None, :] - common)) & (la[top : top + len(common), None] != lb[None, :]))
        for x, y in zip((i + top).tolist(), j.tolist(), strict=True):
            first.setdefault((x, int(lb[y])), (int(ia[x]), int(ib[y])))
    return list(first.values())


def link_components(sets: DataFrame, buckets: int) -> DataFrame:
    """Stars (u, v) of the components of all links between the candidate sets."""
    postings = sets.select("id", "n", F.explode("pairs").alias("sig"))
    crowded = postings.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    postings = stash(postings.join(crowded, "sig"), "jaccard-postings")
    stars = components(verify(rare_pairs(sets).unionByName(pivot_pairs(postings)).distinct(), sets))
    links = rest_links(postings, stars, sets, buckets)
    out = components(stars.unionByName(links))
    discard(postings, stars, links)
    return out


def jaccard_classes(docs: DataFrame, rare: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = stash(summary(docs), "jaccard-summary")
    rows = found.where("kind = 0").select("id", "n", "d1", "d2")
    n_rows, n_shingles = rows.agg(F.count("*"), F.sum("n")).first()
    parts = max(partitions(spark), (n_shingles or 0) // BUCKET)
    buckets = 2 * parts
    floor = max(1000, n_rows / 1000)
    hot = found.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).orderBy(F.desc("n"), "d1").select("d1").limit(MAX_HOT).collect()
    hot = np.sort(np.array([r[0] for r in hot], np.int64).view(_U))

    many = stash(rows.where("id IS NOT NULL").groupBy("id").agg(F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2")).where("a1 <> b1 OR a2 <> b2").select("id"), "jaccard-aside")
    if not many.isEmpty():
        return repeated_ids(docs, many, rare)
    discard(many)

    # the least id stands for all of one set
    classes = stash(rows.where("id IS NOT NULL AND n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")).select("rep", "d1", "d2", "n"), "jaccard-reps")
    shared = shared_shingles(docs.where("doc_id IS NOT NULL"), hot, buckets, parts)
    sets = stash(candidates(shared, classes.where("n >= 4").select(F.col("rep").alias("id"), "n"), parts, rare), "jaccard-sets")
    stars = link_components(sets, buckets)
    named = stash(classes.join(stars.select(F.col("u").alias("rep"), "v"), "rep", "left").select("d1", "d2", "n", F.coalesce("v", "rep").alias("component")), "jaccard-named")
    discard(sets, stars, classes)
    out = rows.join(named, ["d1", "d2", "n"], "left").select("id", "n", "component")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def repeated_ids(docs: DataFrame, many: DataFrame, rare: int) -> DataFrame:
    """The classes where ids (``many``) come with several texts: their rows are joined under ids of their own, and the components that a document's rows are in become one."""
    own = stash(docs.join(many, F.col("doc_id") == F.col("id")).select("doc_id", "text", (F.lit(OWN_IDS) - F.monotonically_increasing_id()).alias("own_id")), "jaccard-own")
    apart = docs.join(many, F.col("doc_id") == F.col("id"), "left_anti").unionByName(own.select(F.col("own_id").alias("doc_id"), "text"))
    names = own.select("own_id", F.col("doc_id").alias("real_id"))
    found = jaccard_classes(apart, rare).join(names, F.col("doc_id") == F.col("own_id"), "left")
    found = stash(found.select(F.coalesce("real_id", "doc_id").alias("doc_id"), "n_shingles", F.col("component_id").alias("c"), F.col("real_id").isNotNull().alias("again")), "jaccard-apart")
    pairs = found.where("again").groupBy("doc_id").agg(F.min("c").alias("v")).join(found.where("again").select("doc_id", "c"), "doc_id")
    roots = components(pairs.select(F.col("c").alias("u"), "v"))
    joined = found.join(roots.select(F.col("u").alias("c"), "v"), "c", "left").withColumn("c", F.coalesce("v", "c"))
    least = joined.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "c", "left").select("doc_id", "n_shingles", "component_id")
