"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

* ``prefixes`` names every prefix of every conversation by its length and four polynomial hashes of its turns' digests, modulo
  primes below 2**31. Rows are sorted by ranges, each range runs over its own rows and hands its last values on to the
  next, so a conversation of any length is spread over as many tasks as it needs. Equal names are one node.
* ``contract`` finds the totals: rounds rake all leaves into their parents, then compress unary chains by splicing out nodes no
  two of which are neighbours: those with bit r of their depth set, in round r, where their child has it unset,
  and by a hash of the round once depths have no more bits. A round leaves a fraction of a chain, so there are about
  log(depth) rounds; each is a few joins of what is left, written to the shared folder. ``totals`` re-expands the
  rounds from the last to the first: a spliced node's total is its own sum, its child's total, and the sums of the nodes
  spliced out between the two before (which the child carries as its edge).
* The digest of the conversations that end in a node reads their ids in order as a stream; its memory does not grow with
  them (SHA-256 itself goes on from byte to byte).

Edge cases: rows with a null conv_id are left out; null role and text are empty; turns go by number, null first, then role,
then digest; repeated turns are turns of their own; empty table: no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_batches, stash

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1812433253, 1664525029, 1566083941)
LANES = len(PRIMES)
MOST_SHARED = 3
ORDER = ["conv_id", "part", "turn", "role", "turn_sha", "row"]
UPTO, BEFORE = [f"h{k}" for k in range(LANES)], [f"g{k}" for k in range(LANES)]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the rows (conv_id, part, turn, role, turn_sha, row, words) of the rebuilt conversations: shared
    turns (part 0), then own ones (part 1).

    Shared turns are the first of a conversation, found by a window that keeps ``MOST_SHARED`` rows of each task."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    turns = stash(turns.select("conv_id", "turn", "role", digest.alias("turn_sha"), words.alias("words"), F.monotonically_increasing_id().alias("row")), "trie-turns")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*_in_order(ORDER[2:])))
    first = stash(turns.withColumn("place", place).where(F.col("place") <= MOST_SHARED), "trie-first")
    ids = stash(turns.select("conv_id").distinct(), "trie-ids")
    base = first.withColumnRenamed("conv_id", "base_id")
    shared = ids.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base_id").where(F.col("place") <= shared_turns(F.col("conv_id")))
    taken = first.where(F.col("place") <= shared_turns(F.col("conv_id"))).select("row")
    own = turns.join(taken, "row", "left_anti")
    columns = [*ORDER, "words"]
    return ids, shared.withColumn("part", F.lit(0)).select(*columns).unionByName(own.withColumn("part", F.lit(1)).select(*columns))


def _in_order(names: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def _add(a: tuple, b: tuple) -> tuple:
    """Count and hashes of one run of turns after another."""
    return (a[0] + b[0], *((x + pow(base, a[0], p) * y) % p for x, y, base, p in zip(a[1:], b[1:], BASES, PRIMES, strict=True)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and hash of each turn's prefix, and of the one before, within one range of rows."""
    power = [np.ones(1, np.uint64) for _ in PRIMES]
    last, count, held = None, 0, [np.uint64(0)] * LANES
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        at = np.arange(len(conv))
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, at, -1))
        goes_on = start < 0  # rows of the conversation that the batch before ended with
        start = np.maximum(start, 0)
        place = at - start + np.where(goes_on, count, 0)
        upto, before = [], []
        for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            p = np.uint64(p)
            while len(power[k]) <= place.max():
                step = power[k][-1] * np.uint64(base) % p
                power[k] = np.concatenate([power[k], power[k] * step % p])
            value = batch.column(1 + k).to_numpy().astype(np.uint64) * power[k][place] % p
            sums = np.cumsum(value, dtype=np.uint64)
            into = np.where(goes_on, np.uint64(0), sums[start] - value[start])
            upto.append((sums - into + np.where(goes_on, held[k], np.uint64(0))) % p)
            before.append((upto[k] + p - value) % p)
        last, count, held = conv[-1], int(place[-1]) + 1, [x[-1] for x in upto]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place + 1), *[pa.array(x.astype(np.int64)) for x in upto + before], batch.column(1 + LANES)], ["conv_id", "place", *UPTO, *BEFORE, "words"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, words) of every rebuilt turn: the names of the prefix that it ends and of the one before."""
    spark = turns.sparkSession
    values = [(F.conv(F.substring("turn_sha", 1 + 8 * k, 8), 16, 10).cast("long") % F.lit(p)).alias(f"v{k}") for k, p in enumerate(PRIMES)]
    ranges = turns.repartitionByRange(*_in_order(ORDER)).sortWithinPartitions(*_in_order(ORDER))
    schema = ", ".join(f"{c} long" for c in ("conv_id", "place", *UPTO, *BEFORE, "words"))
    local = stash(ranges.select("conv_id", *values, "words").mapInArrow(_run, schema).withColumn("range_no", F.spark_partition_id()), "trie-prefixes")

    # what a range's first conversation has behind it: two rows of each range tell
    ends = local.groupBy("range_no").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max(F.struct("conv_id", "place", *UPTO)).alias("to")).orderBy("range_no").collect()
    nothing = (0, *[0] * LANES)
    carried, open_id, state = [], None, nothing
    for r in ends:
        state = state if r["first"] == open_id else nothing
        carried.append((r["range_no"], r["first"], *state, *[pow(base, state[0], p) for base, p in zip(BASES, PRIMES, strict=True)]))
        to = tuple(r["to"])[1:]
        state, open_id = (_add(state, to) if r["last"] == r["first"] else to), r["last"]
    carry, by = [f"carry{k}" for k in range(LANES)], [f"by{k}" for k in range(LANES)]
    table = spark.createDataFrame(carried or [(0, 0, 0, *[0] * (2 * LANES))], ", ".join(["c_range int", "c_id long"] + [f"{c} long" for c in ("c_place", *carry, *by)]))
    joined = local.join(F.broadcast(table), (F.col("range_no") == F.col("c_range")) & (F.col("conv_id") == F.col("c_id")), "left")
    whole = lambda names: [F.when(F.col("c_id").isNull(), F.col(x)).otherwise((F.col(c) + F.col(m) * F.col(x)) % F.lit(p)) for x, c, m, p in zip(names, carry, by, PRIMES, strict=True)]
    pair = lambda x, y: F.shiftleft(x, 31) + y
    h, g = whole(UPTO), whole(BEFORE)
    return joined.select("conv_id", (F.col("place") + F.coalesce("c_place", F.lit(0))).alias("depth"), pair(h[0], h[1]).alias("a"), pair(h[2], h[3]).alias("b"), pair(g[0], g[1]).alias("up_a"), pair(g[2], g[3]).alias("up_b"), "words")


# ---------------------------------------------------------------- contraction


def contract(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(id, and the totals of ``sums`` over every node's subtree). tree: id, parent (null at roots), depth, kids and the long columns ``sums``.

    Every round reads and writes only what is left of the tree."""
    edges = [f"edge_{s}" for s in sums]
    base = [F.col("id"), F.col("parent"), F.col("depth"), F.col("kids"), *[F.col(s) for s in sums]]
    alive = stash(tree.select(*base, *[F.lit(0).cast("long").alias(e) for e in edges]), "trie-alive")
    bits, done, spliced = (alive.agg(F.max("depth")).first()[0] or 0).bit_length(), [], []
    while not alive.isEmpty():
        r = len(done)
        leaves = alive.where("kids = 0")
        done.append(leaves.select("id", *sums))
        raked = leaves.groupBy(F.col("parent").alias("r_parent")).agg(*[F.sum(F.col(s) + F.col(e)).alias(f"r_{s}") for s, e in zip(sums, edges, strict=True)])
        inner = alive.where("kids > 0").join(raked, F.col("id") == F.col("r_parent"), "left").select("id", "parent", "depth", *[(F.col(s) + F.coalesce(f"r_{s}", F.lit(0))).alias(s) for s in sums], *edges)
        below = inner.where("parent IS NOT NULL").groupBy(F.col("parent").alias("b_parent")).agg(F.count("*").alias("b_kids"), F.max(F.struct("id", "depth", *edges)).alias("child"))
        seen = stash(inner.join(below, F.col("id") == F.col("b_parent"), "left").select("id", "parent", "depth", F.coalesce("b_kids", F.lit(0)).alias("kids"), "child", *sums, *edges), "trie-seen")
        coin = (lambda i, d, r=r: F.shiftright(d, r).bitwiseAND(F.lit(1))) if r < bits else (lambda i, d, r=r: F.xxhash64(i, F.lit(r)).bitwiseAND(F.lit(1)))
        out = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & (coin(F.col("id"), F.col("depth")) == 1) & (coin(F.col("child.id"), F.col("child.depth")) == 0), F.lit(False))
        gone = seen.where(out).select(F.col("id").alias("u"), F.col("child.id").alias("w"), F.col("parent").alias("u_parent"), *[F.col(s).alias(f"u_{s}") for s in sums], *[F.col(e).alias(f"u_{e}") for e in edges], *[F.col(f"child.{e}").alias(f"w_{e}") for e in edges])
        spliced.append(gone)
        linked = F.col("w").isNotNull()
        after = seen.where(~out).join(gone, F.col("id") == F.col("w"), "left")
        alive = stash(after.select("id", F.when(linked, F.col("u_parent")).otherwise(F.col("parent")).alias("parent"), "depth", "kids", *sums, *[(F.col(e) + F.coalesce(F.col(f"u_{s}") + F.col(f"u_{e}"), F.lit(0))).alias(e) for s, e in zip(sums, edges, strict=True)]), "trie-alive")
    known = None
    for leaves, gone in zip(reversed(done), reversed(spliced), strict=True):
        if known is None:
            known = leaves
            continue
        later = known.select(F.col("id").alias("k_id"), *[F.col(s).alias(f"k_{s}") for s in sums])
        opened = stash(gone.join(later, F.col("w") == F.col("k_id")).select(F.col("u").alias("id"), *[(F.col(f"u_{s}") + F.col(f"w_{e}") + F.col(f"k_{s}")).alias(s) for s, e in zip(sums, edges, strict=True)]), "trie-opened")
        known = known.unionByName(opened).unionByName(leaves)
    return alive.select("id", *sums) if known is None else known


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each run of rows of one node, read as a stream."""
    names, key, digest = ["e_depth", "e_a", "e_b", "ends_sha256"], None, None
    for batch in batches:
        d, a, b, ids = (batch.column(i).to_numpy() for i in range(4))
        if not len(d):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out = []
        for i, j in zip(cut, [*cut[1:], len(d)], strict=True):
            text = ",".join(map(str, ids[i:j].tolist()))
            if (now := (int(d[i]), int(a[i]), int(b[i]))) == key:
                digest.update(f",{text}".encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = now, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in out], pa.string())], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in key] + [pa.array([digest.hexdigest()])], names)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    ids, turns = rebuilt(conversations)
    rows = stash(prefixes(turns), "trie-rows")
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("words"), zero.alias("up_a"), zero.alias("up_b"))
    nodes = stash(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("p_depth"), F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(parents, (F.col("depth") == F.col("p_depth")) & (F.col("up_a") == F.col("p_a")) & (F.col("up_b") == F.col("p_b")), "left").select("id", "parent", "depth", "a", "b", "conv_id", "parent_conv_id", "n_convs", "words")
    named = stash(named, "trie-named")
    kids = named.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"))
    named = stash(named.join(kids, F.col("id") == F.col("of"), "left").withColumn("kids", F.coalesce("n", zero)).drop("of", "n"), "trie-kids")
    totals = contract(named.select("id", "parent", "depth", "kids", (F.col("kids") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    ends = ids.join(ends, "conv_id", "left").select(*[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in ("depth", "a", "b")], "conv_id")
    digests = ends.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "conv_id").mapInArrow(_digests, "e_depth long, e_a long, e_b long, ends_sha256 string")
    whole = named.join(totals.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id")).join(digests, (F.col("depth") == F.col("e_depth")) & (F.col("a") == F.col("e_a")) & (F.col("b") == F.col("e_b")), "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
