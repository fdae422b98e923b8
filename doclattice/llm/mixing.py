"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Source i of total size S_i with weight w_i gets the target
w_i / sum(w) * factor * sum(S), but at most ``max_epochs`` * S_i; what lies above is
shared again by weight among the others until none is above.

Each source is cut into blocks by a seeded hash of (source, doc_id): the hash order is a
random permutation, so consecutive blocks are disjoint permuted draws. A pass over all
blocks is one epoch; the last, partial epoch takes the first blocks of the permutation, then the first of ``parts`` parts of the
block where the target falls, then documents of one part in hash order until the target is nearest. The block quotas of
all sources are then split exactly among the output shards: a tree halves the shards and draws each half's quotas from a
multivariate hypergeometric distribution, seeded by the node, until every shard knows its range of every source's
block sequence. ``mix_sources`` brings each shard together and shuffles its rows by hash.

Shards hold about ``shard_words`` words (``least_shards`` at least), and a source has four blocks for each shard, 256 at least, so
neither shards nor blocks grow with the corpus. The driver holds a number for each block: ``most_blocks`` in all, and one for each
source at least.

Edge cases: null text has size 0; sources are ordered by code point, null last, and a null
source is a source of its own; documents of size 0 are taken in the block they fall in,
adding nothing; rows that repeat a doc_id of a source are taken together; empty input gives no rows; extra columns are passed
through, but for those named mix_*, which the result replaces.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, text_of

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: list[float], weights: list[float], factor: float, max_epochs: float) -> list[float]:
    """Targets by weight, none above max_epochs times its size; the excess is shared again."""
    total, out, free = factor * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        share = sum(weights[i] for i in free)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        over = {i for i in free if left * weights[i] / share > max_epochs * sizes[i]}
        for i in over or free:
            out[i] = float(max_epochs * sizes[i]) if over else left * weights[i] / share
        free = free - over if over else set()
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block counts; column sums are the quotas, shard totals differ by rounding only."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        draw = int(round(q.sum() * (mid - lo) / (hi - lo)))
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(q)
        rest_pop, rest = int(q.sum()), draw
        for i, n in enumerate(q):  # one hypergeometric draw per source: exact at any size
            rest_pop -= int(n)
            left[i] = rng.hypergeometric(int(n), rest_pop, rest) if rest and n else 0
            rest -= int(left[i])
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """A row of ``docs`` for each time the mix takes it, with mix_size, mix_source_size, mix_target, mix_copy, mix_shard and mix_order; each shard stands together, shuffled."""
    plan = mix_plan(docs, **options)
    names = [F.col(f"`{c}`") for c in _own_columns(docs)]
    rows = plan.select(*names, "mix_size", "mix_source_size", "mix_target", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"), "mix_order")
    return rows.repartition(F.col("mix_shard")).sortWithinPartitions("mix_shard", F.xxhash64("mix_order", "mix_copy"))


def _own_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if not c.lower().startswith("mix_")]


def _prefix(sizes: dict[int, int], n: int, room: float) -> tuple[int, float]:
    """How many of n parts in turn fit into ``room``, and what is left of it."""
    k = 0
    while k < n and sizes.get(k, 0) <= room:
        room -= sizes.get(k, 0)
        k += 1
    return k, room


def mix_plan(docs: DataFrame, factor: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS, shard_words: int = 1 << 26, least_shards: int = 64, most_blocks: int = 1 << 23, parts: int = 1024, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with the shards that take it (mix_shards: one entry per copy, none if not taken)."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))
    sized = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), order.alias("ord")), "mix-sizes")

    rows = sized.groupBy("source").agg(F.sum("size").alias("total")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["total"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], factor, max_epochs)
    shards = max(least_shards, int(-(-sum(goal) // shard_words)))
    blocks = max(1, min(max(256, 4 * shards), most_blocks // max(1, len(rows))))
    block = F.pmod(F.shiftrightunsigned("ord", 20), F.lit(blocks)).cast("int")
    part = F.pmod(F.col("ord"), F.lit(parts)).cast("int")

    sizes: list[dict[int, int]] = [{} for _ in rows]
    number = {r["source"]: i for i, r in enumerate(rows)}
    for r in sized.groupBy("source", block.alias("b")).agg(F.sum("size").alias("size")).toLocalIterator():
        sizes[number[r["source"]]][r["b"]] = r["size"]
    quotas, facts = [], []
    for r, t, of in zip(rows, goal, sizes, strict=True):
        full = int(t // r["total"]) if r["total"] else 0
        cut, room = _prefix(of, blocks, t - full * r["total"]) if t and r["total"] else (0, 0.0)
        quotas.append(full * blocks + min(cut + 1, blocks) if t else 0)
        facts.append([r["source"], r["total"], t, full, cut, room])

    # the block in which the target falls is taken in parts, and the part in which it falls by document, up to a last hash
    cuts = spark.createDataFrame([f[:1] + f[4:5] for f in facts] or [[None, 0]], "s string, cut int")
    at_cut = sized.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("s"))).where(block == F.col("cut")).select("source", "doc_id", "ord", "size", part.alias("part"))
    pieces: list[dict[int, int]] = [{} for _ in rows]
    for r in at_cut.groupBy("source", "part").agg(F.sum("size").alias("size")).toLocalIterator():
        pieces[number[r["source"]]][r["part"]] = r["size"]
    for f, of in zip(facts, pieces, strict=True):
        f += _prefix(of, parts, f[5])
    edge = spark.createDataFrame([[f[0], f[6], f[7]] for f in facts] or [[None, 0, 0.0]], "s string, edge int, room double")
    at_edge = at_cut.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s"))).where("part = edge")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = at_edge.withColumn("run", running).where("run - size / 2.0 <= room").groupBy("source").agg(F.max("ord").alias("last"))
    lasts = {r["source"]: r["last"] for r in last.collect()}

    # copy c of block b is number c * blocks + b of its source's sequence, which the shards divide in turn
    ends = np.cumsum(split_quotas(np.array(quotas, np.int64), shards, seed), axis=0) if quotas else np.zeros((shards, 0), np.int64)
    dims = []
    for i, (f, q) in enumerate(zip(facts, quotas, strict=True)):
        of = np.searchsorted(ends[:, i], np.arange(q), "right").tolist()
        dims.append([f[0], f[1], f[2], f[3], f[4], f[6], lasts.get(f[0]), [of[b::blocks] for b in range(blocks)]])
    dims = spark.createDataFrame(dims or [[None, 0, 0.0, 0, 0, 0, None, []]], "mix_s string, mix_total long, mix_goal double, mix_full int, mix_cut int, mix_edge int, mix_last long, mix_lists array<array<int>>")

    base = docs.select(*[F.col(f"`{c}`") for c in _own_columns(docs)], word_count().alias("mix_size"), order.alias("mix_order"))
    base = base.withColumns({"mix_block": F.pmod(F.shiftrightunsigned("mix_order", 20), F.lit(blocks)).cast("int"), "mix_part": F.pmod(F.col("mix_order"), F.lit(parts)).cast("int")})
    base = base.join(F.broadcast(dims), F.col("source").cast("string").eqNullSafe(F.col("mix_s")))
    in_edge = (F.col("mix_part") == F.col("mix_edge")) & F.coalesce(F.col("mix_order") <= F.col("mix_last"), F.lit(False))
    more = (F.col("mix_block") < F.col("mix_cut")) | (F.col("mix_block") == F.col("mix_cut")) & ((F.col("mix_part") < F.col("mix_edge")) | in_edge)
    taken = F.slice(F.element_at("mix_lists", F.col("mix_block") + 1), F.lit(1), F.col("mix_full") + more.cast("int"))
    names = [F.col(f"`{c}`") for c in _own_columns(docs)]
    return base.select(*names, "mix_size", F.col("mix_total").alias("mix_source_size"), F.col("mix_goal").alias("mix_target"), F.coalesce(taken, F.array().cast("array<int>")).alias("mix_shards"), "mix_order")
