"""Rankings and selections that scale: pruned sparse top k, projected neighbours, exact percentiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclattice.operators import reports, retrieval
from doclattice.sources.sinks import written


def naive(corpus, queries, k):
    terms = queries.select("q_id", F.explode(F.array_distinct(retrieval.tokenize(F.col("q_text")))).alias("term"))
    scores = terms.join(corpus.impacts(terms.select("term").distinct()), "term").groupBy("q_id", "doc_id").agg(F.sum("w").alias("score"))
    return {(r["q_id"], r["doc_id"]): (r["score"], r["rank"]) for r in retrieval.ranked(scores, k).collect()}


def test_pruned_top_k_is_the_whole_one_with_fewer_rows(spark):
    rng = random.Random(8)
    rare = [f"rare{i}" for i in range(300)]
    texts = [" ".join(["common", "frequent"] * rng.randrange(1, 5) + rng.choices(rare, k=rng.randrange(0, 12))) for _ in range(1500)] + ["", None, "de la"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"common frequent {rng.choice(rare)} {rng.choice(rare)}") for i in range(12)] + [(90, "common"), (91, "unknown words"), (92, "")], "q_id long, q_text string")
    corpus = retrieval.Tokens(docs)
    for k in (1, 10, 5000):
        got = {(r["q_id"], r["doc_id"]): (r["score"], r["rank"]) for r in retrieval.bm25_top(corpus, asked, k).collect()}
        assert got == naive(corpus, asked, k)
    terms = written(asked.where("q_id < 90").select("q_id", F.explode(F.array_distinct(retrieval.tokenize(F.col("q_text")))).alias("term")))
    impacts = corpus.impacts(terms.select("term").distinct())
    kept, others = retrieval.bm25_candidates(impacts, terms, 10)
    every = terms.join(impacts, "term").count()
    assert every >= 12 * 2 * 1500 and kept.count() * 20 < every  # a frequent term makes no row for every document
    assert {r["term"] for r in others.select("term").distinct().collect()} == {"common", "frequent"}
    assert retrieval.bm25_top(retrieval.Tokens(docs.limit(0)), asked, 5).count() == 0


def recall(spark, x, q, **options):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in q], "q_id long, qvec array<double>")
    pairs = lambda df: {(r["q_id"], r["doc_id"]) for r in df.collect()}
    exact = pairs(retrieval.dense_ranked(vectors, queries, 10))
    return len(exact & pairs(retrieval.projected_ranked(vectors, queries, 10, **options))) / len(exact)


def test_projected_neighbours_find_nine_of_ten_and_score_few_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([c + 0.5 * rng.normal(size=(40, 64)) for c in centres])
    q = [(int(i), x[i]) for i in rng.choice(len(x), 50, replace=False)]
    assert recall(spark, x, q) >= 0.9
    planes = retrieval.Projections(64, 12, 8, 2)
    met = planes.met(x, planes.probed(np.array([v for _, v in q])))
    assert met.mean() < 0.35
    loose = rng.normal(size=(1500, 64))  # without any structure more and wider buckets are needed
    assert recall(spark, loose, [(i, loose[i]) for i in range(0, 1500, 50)], tables=24, bits=4, probes=1) >= 0.9
    one = np.ones((400, 8))  # copies of one vector
    assert recall(spark, one, [(0, one[0])], tables=4, bits=4, probes=1) == 1.0


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles_are_exact(spark, accuracy):
    rng = random.Random(2)
    groups = {"wide": [rng.uniform(-5, 5) for _ in range(3000)], "ties": [1.0] * 2000 + [2.0] * 10, "one": [7.5], "two": [1.0, 2.0], None: [float(i) for i in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r["g"], r["p"]): r["x"] for r in reports.exact_percentiles(table, "g", "v", (0.0, 0.5, 0.95, 0.99, 1.0), accuracy).collect()}
    assert got == pytest.approx({(g, p): float(np.quantile(vs, p)) for g, vs in groups.items() for p in (0.0, 0.5, 0.95, 0.99, 1.0)})
