"""Batch retrieval: BM25 and dense rankings, rank fusion, boosts, lexical rerank, enrichment.

Queries are a table, so all of them run in one plan. Postings are counted once and joined by term;
the side of the queries is small by nature, but the planner decides whether to broadcast it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_tags, is_token, longest_run, token_rows, tokenize
from ..sources.sinks import written

K1, B, RRF_K = 1.2, 0.75, 60
SAFETY_BOOST, CURRENT_BOOST = 1.5, 1.1


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer parts than there are, as a small file does; a large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tokens:
    """The tokens of a corpus (doc_id, text), made and written once: ``table`` has doc_id, t (all tokens, with repeats); ``n`` documents of ``avgdl`` tokens."""

    def __init__(self, docs: DataFrame):
        words = spread(docs.select("doc_id", "text")).select("doc_id", F.filter(token_rows(F.coalesce("text", F.lit(""))), is_token).alias("t"))
        self.table = written(words)
        self.n, lengths = self.table.agg(F.count("*"), F.sum(F.size("t"))).first()
        self.avgdl = (lengths or 0) / max(self.n, 1)

    def postings(self, terms: DataFrame) -> DataFrame:
        """term, doc_id, tf, dl for the given terms (term) alone: they are matched before anything is counted."""
        words = self.table.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
        return words.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))

    def impacts(self, terms: DataFrame) -> DataFrame:
        """term, doc_id, w: the BM25 weight of every posting of the given terms, written."""
        post = written(self.postings(terms))
        idf = post.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return post.join(idf, "term").select("term", "doc_id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl)))).alias("w"))

    def vectors(self) -> DataFrame:
        """doc_id, vec: token counts by slot; documents without tokens have none."""
        slots = self.table.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", slot_of(F.col("term")).alias("slot")).agg(F.count("*").cast("double").alias("n"))
        return _slot_sums(slots, ["doc_id"]).withColumnRenamed("vector", "vec")


SLACK = 1e-6


def bm25_candidates(impacts: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """q_id, doc_id, part: pairs that may be among the k best, with what their essential terms add up to.

    impacts: term, doc_id, w; terms: q_id, term. The k documents of greatest weight for each term are scored in full; a query's k-th best of them is a
    score that the result can't fall below. Terms that can't reach it together, at their greatest weights, are not essential: a document that holds none but
    those is no candidate, so that a frequent term makes no row for every document. The second result has the other terms (q_id, term)."""
    most = impacts.groupBy("term").agg(F.max("w").alias("mx"))
    heads = top(impacts, ["term"], [F.desc("w"), F.asc("doc_id")], k).select("term", "doc_id")
    tried = terms.join(heads, "term").select("q_id", "doc_id").distinct()
    full = tried.join(terms, "q_id").join(impacts, ["term", "doc_id"]).groupBy("q_id", "doc_id").agg(F.sum("w").alias("score"))
    floor = top(full, ["q_id"], [F.desc("score"), F.asc("doc_id")], k).where(F.col("rank") == k).select("q_id", (F.col("score") - SLACK).alias("floor"))
    bounds = terms.join(most, "term").join(floor, "q_id", "left")
    upto = F.sum("mx").over(Window.partitionBy("q_id").orderBy("mx", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = bounds.withColumn("upto", upto).withColumn("essential", F.col("floor").isNull() | (F.col("upto") >= F.col("floor")))
    rest = bounds.groupBy("q_id").agg(F.coalesce(F.max(F.when(~F.col("essential"), F.col("upto"))), F.lit(0.0)).alias("rest"), F.max("floor").alias("floor"))
    part = bounds.where("essential").select("q_id", "term").join(impacts, "term").groupBy("q_id", "doc_id").agg(F.sum("w").alias("part"))
    kept = part.join(rest, "q_id").where(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor"))).select("q_id", "doc_id", "part")
    return kept, bounds.where(~F.col("essential")).select("q_id", "term")


def bm25_top(corpus: Tokens, queries: DataFrame, k: int) -> DataFrame:
    """q_id, doc_id, score, rank: the k best documents of every query (q_id, q_text) by BM25."""
    terms = written(queries.select("q_id", F.explode(F.array_distinct(tokenize(F.col("q_text")))).alias("term")))
    impacts = corpus.impacts(terms.select("term").distinct())
    found, others = bm25_candidates(impacts, terms, k)
    found = written(found)
    more = found.select("q_id", "doc_id").join(others, "q_id").join(impacts, ["term", "doc_id"]).groupBy("q_id", "doc_id").agg(F.sum("w").alias("more"))
    return ranked(found.join(more, ["q_id", "doc_id"], "left").select("q_id", "doc_id", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score")), k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    return top(scores.withColumn("score", F.round("score", 6)), ["q_id"], [F.desc("score"), F.asc("doc_id")], k)


RANKED = "q_id long, doc_id long, score double"


MATRIX_BYTES = 64 << 20


def _best(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, others: bool, met: np.ndarray | None = None) -> pa.RecordBatch:
    """The k most similar rows of x for every query; ``others`` leaves out the query's own id, ``met`` (rows, queries) tells which pairs count. Similarities are made in blocks of a fixed size."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    x, q, out = unit(x), unit(q), []
    step = max(1, MATRIX_BYTES // (8 * max(1, len(ids))))
    for a in range(0, len(q_ids), step):
        sim = np.round(x @ q[a : a + step].T, 6)
        for j in range(sim.shape[1]):
            s, q_id = sim[:, j], q_ids[a + j]
            mine = np.flatnonzero((ids != q_id if others else np.ones(len(ids), bool)) & (met[:, a + j] if met is not None else True))
            if len(mine) > 4 * k:
                mine = mine[s[mine] >= np.partition(s[mine], -k)[-k]]
            mine = mine[np.lexsort((ids[mine], -s[mine]))][:k]
            out.append((np.full(len(mine), q_id), ids[mine], s[mine]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_id", "doc_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _blocks(queries: DataFrame, block: int):
    """Queries (q_id, ...) in blocks of about ``block`` rows on the driver, one at a time."""
    n = max(1, -(-queries.count() // block))
    for b in range(n):
        yield (queries.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == b) if n > 1 else queries).toPandas()


def dense_ranked(vectors: DataFrame, queries: DataFrame, k: int, block: int = 10_000, others: bool = True) -> DataFrame:
    """Top k of (doc_id, vec) for each of (q_id, qvec) by cosine. Queries go out in blocks of a checked size; each batch of vectors is one matrix product, of which
    k rows for each query reach the sort."""
    out = None
    for q in _blocks(queries, block):
        q_ids, qm = q["q_id"].to_numpy(), np.array([np.asarray(v, float) for v in q["qvec"]])

        def run(batches, q_ids=q_ids, qm=qm):
            for batch in batches:
                if len(q_ids) and batch.num_rows:
                    yield _best(batch.column(0).to_numpy(), _matrix(batch.column(1)), q_ids, qm, k, others)

        found = vectors.select(F.col("doc_id").cast("long"), "vec").mapInArrow(run, RANKED)
        out = found if out is None else out.unionByName(found)
    return top(out, ["q_id"], [F.desc("score"), F.asc("doc_id")], k)


class Projections:
    """Signs of random projections: ``tables`` buckets of ``bits`` bits for each vector; a query also probes the buckets that differ in one of its ``probes`` least certain bits."""

    def __init__(self, dims: int, tables: int, bits: int, probes: int, seed: int = 17):
        self.planes = np.random.default_rng(seed).normal(size=(dims, tables * bits))
        self.tables, self.bits, self.probes = tables, bits, probes

    def sides(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes).reshape(len(x), self.tables, self.bits)

    def buckets(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ (1 << np.arange(self.bits))

    def probed(self, q: np.ndarray) -> np.ndarray:
        """(tables, buckets, queries): whether a query looks into a bucket."""
        sides = self.sides(q)
        own, weak = self.buckets(sides), np.argsort(np.abs(sides), axis=2)[:, :, : self.probes]
        out = np.zeros((self.tables, 1 << self.bits, len(q)), bool)
        each, at = np.arange(len(q)), np.arange(self.tables)[:, None]
        out[at, own.T, each] = True
        for p in range(self.probes):
            out[at, (own ^ (1 << weak[:, :, p])).T, each] = True
        return out

    def met(self, x: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """(rows, queries): pairs that share a probed bucket in some table."""
        own = self.buckets(self.sides(x))
        out = np.zeros((len(x), probed.shape[2]), bool)
        for t in range(self.tables):
            out |= probed[t, own[:, t]]
        return out


def projected_ranked(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 12, bits: int = 8, probes: int = 2, block: int = 2_000, others: bool = True) -> DataFrame:
    """As ``dense_ranked``, but a vector is compared only with the queries that probe one of its buckets: one scan of the vectors, no shuffle of them and no row for a pair.
    Rows of a batch are sorted into buckets first, and only those that some query probes are scored."""
    out = None
    for q in _blocks(queries, block):
        if not len(q):
            continue
        q_ids, qm = q["q_id"].to_numpy(), np.array([np.asarray(v, float) for v in q["qvec"]])
        planes = Projections(qm.shape[1], tables, bits, probes)
        probed = planes.probed(qm)

        def run(batches, q_ids=q_ids, qm=qm, planes=planes, probed=probed):
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                step = max(1, MATRIX_BYTES // (8 * len(q_ids)))
                for a in range(0, len(ids), step):
                    met = planes.met(x[a : a + step], probed)
                    some = met.any(axis=1)
                    yield _best(ids[a : a + step][some], x[a : a + step][some], q_ids, qm, k, others, met[some])

        found = vectors.select(F.col("doc_id").cast("long"), "vec").mapInArrow(run, RANKED)
        out = found if out is None else out.unionByName(found)
    return dense_ranked(vectors, queries, k) if out is None else top(out, ["q_id"], [F.desc("score"), F.asc("doc_id")], k)


DIMS = 64


def slot_of(term: Column) -> Column:
    """The slot of a term's hashed vector: the first four hex digits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 4), 16, 10).cast("int") % DIMS


def slot_vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vector) of texts: a deterministic stand-in for an embedding service, token counts by slot."""
    words = texts.select(*keys, F.explode_outer(token_rows(F.coalesce("text", F.lit("")))).alias("term"))
    return _slot_sums(words.groupBy(*keys, F.when(is_token(F.col("term")), slot_of(F.col("term"))).alias("slot")).agg(F.count("*").cast("double").alias("n")), keys)


def _slot_sums(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, n) to one vector of sums; no group is held as a whole."""
    sums = counts.groupBy(*keys).agg(*[F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0.0)).alias(f"s{i}") for i in range(DIMS)])
    return sums.select(*keys, F.array(*[f"s{i}" for i in range(DIMS)]).alias("vector"))


def hashed_ranked(corpus: Tokens, queries: DataFrame, k: int) -> DataFrame:
    """The dense ranking of a corpus for (q_id, q_text) by hashed vectors; texts without tokens aren't ranked, nor are those without a common slot."""
    asked = slot_vectors(queries.select("q_id", F.col("q_text").alias("text")), ["q_id"]).withColumnRenamed("vector", "qvec")
    found = dense_ranked(corpus.vectors(), asked.where(F.exists("qvec", lambda x: x > 0)), k, others=False)
    return found.where("score > 0")


def rrf(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (q_id, doc_id, rank); either side may be empty."""
    a = first.select("q_id", "doc_id", F.col("rank").alias("r1"))
    b = second.select("q_id", "doc_id", F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return a.join(b, ["q_id", "doc_id"], "full").select("q_id", "doc_id", F.round(part("r1") + part("r2"), 9).alias("score"))


def boost(score: Column, safety_query: Column, safety_text: Column, current: Column) -> Column:
    return score * F.when(safety_query & safety_text, SAFETY_BOOST).otherwise(1.0) * F.when(current, CURRENT_BOOST).otherwise(1.0)


def active_only(hits: DataFrame) -> DataFrame:
    return hits.where("coalesce(is_current, true) AND coalesce(nullif(version_status, ''), 'active') = 'active'")


def dedup_sections(hits: DataFrame, keys: tuple | list = ("q_id", "doc_id", "section")) -> DataFrame:
    """The first hit of each document and section in retrieval order; a null section is one section."""
    return top(hits, list(keys), [F.asc("rank"), F.asc("hit_id")], 1, "_rn").drop("_rn")


def pool_sizes(k: int, prefetch: int = 0, rerank_pool: int = 0) -> tuple[int, int]:
    """(rerank pool, prefetch) of a search for k hits."""
    pool = rerank_pool or max(prefetch, 4 * k)
    return pool, max(pool, prefetch)


def tag_boost(query_text: Column, title: Column, content: Column, citation: Column, codes: Column) -> Column:
    """0.18 for every exact tag of the query in title, content or citation, 0.22 for every asset code of the hit in the query."""
    haystack = F.upper(F.concat_ws(" ", title, content, citation))
    tags = F.size(F.filter(exact_tags(query_text), lambda t: F.contains(haystack, F.upper(t))))
    named = F.size(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: (c != "") & F.contains(F.upper(query_text), F.upper(c))))
    return 0.18 * tags + 0.22 * named


def title_boost(query: Column, title: Column) -> Column:
    """0.25 if the head of the query stands in the title, else 0.2 or 0.1 for runs of three or two of its tokens."""
    low = F.lower(F.coalesce(title, F.lit("")))
    run = longest_run(query, low)
    head = F.substring(F.array_join(query, " "), 1, 24)
    return F.when((F.size(query) < 2) | (low == ""), 0.0).when(F.contains(low, head), 0.25).when(run >= 3, 0.2).when(run >= 2, 0.1).otherwise(0.0)


#: Ids that are held with one text at most, and the parts that the hits of a group are dealt to.
HELD, PARTS = 1_000_000, 16


def pair_boosts(queries: DataFrame, hits: DataFrame, by: str) -> DataFrame:
    """(q_id, hit_id, titled, tagged): title and tag boost, to six places, of every query (q_id, ``by``, q_text) for every hit (hit_id, ``by``, title, content) of its group; ids are numbers.

    Ids are held with their texts, so that equal texts are scored once, and come apart after: no pair is shuffled, and a task holds the queries and a part of the hits of a group."""
    held = lambda df, key, *texts: df.groupBy(by, *texts, F.floor(F.col(key) / HELD).alias("at")).agg(F.collect_list(F.struct(key)).alias(f"{key}s")).drop("at")
    asked = held(queries, "q_id", "q_text").withColumns({"words": tokenize(F.col("q_text")), "part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))})
    found = held(hits, "hit_id", "title", "content").withColumn("part", F.pmod(F.xxhash64("title", "content"), F.lit(PARTS)).cast("int"))
    scored = written(asked).join(found, [by, "part"])
    none = F.lit(None).cast("array<string>")
    scored = scored.select("q_ids", "hit_ids", F.round(title_boost(F.col("words"), F.col("title")), 6).alias("titled"), F.round(tag_boost(F.col("q_text"), F.col("title"), F.col("content"), F.lit(""), none), 6).alias("tagged"))
    apart = scored.select("hit_ids", "titled", "tagged", F.explode("q_ids").alias("q")).select("q.q_id", F.explode("hit_ids").alias("h"), "titled", "tagged")
    return apart.select("q_id", "h.hit_id", "titled", "tagged")


def rerank_score(base: Column, query: Column, text: Column, title: Column, tags: Column) -> Column:
    """0.35 base + 0.45 overlap + tag boost (0.8 at most) + title boost; query is the token array."""
    # the text's tokens are bound by a transform of one element, so that they are made once and not for each query token
    matched = F.transform(F.array(tokenize(text)), lambda words: F.size(F.filter(query, lambda t: F.array_contains(words, t))))
    overlap = F.element_at(matched, 1) / F.greatest(F.size(query), F.lit(1))
    return 0.35 * base + 0.45 * overlap + F.least(tags, F.lit(0.8)) + title_boost(query, title)


def neighbours(vectors: DataFrame, seeds: DataFrame, least: float, k: int) -> DataFrame:
    """Nearest vectors of every seed (q_id, qvec) at ``least`` similarity or more, seeds left out."""
    found = dense_ranked(vectors.join(seeds.select(F.col("q_id").alias("doc_id")), "doc_id", "left_anti"), seeds, k)
    return found.where(F.col("score") >= least)
