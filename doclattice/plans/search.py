"""Registered queries on retrieval, conflicts, graph, sensors and streams, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import insight, limits, motor, reports, retrieval
from ..sources.sinks import written
from ..streaming import streams
from .corpus import LINES, TOKENS, order_lines, part_texts, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Every benchmark passage is a query, some with a hazard and an asset code or with a guide number; documents that hold its head are the relevant ones.
Q_TEXT = "text || CASE item_id % 4 WHEN 0 THEN ' riesgo FT-' || (100 + item_id % 5) WHEN 1 THEN ' GUIGS-' || (item_id % 9) ELSE '' END"
ASK = f"q AS (SELECT item_id AS q_id, {Q_TEXT} AS text, text AS passage FROM benchmark)"
HEAD = 60

# Documents as points of an index: those of superseded or unknown currency are no hits. Columns are SQL that both engines read.
POINT = {
    "document": "source",
    "section": "'S' || (n_chars % 5)",
    "title": "coalesce(source, '') || ' GUIGS-' || (doc_id % 9) || ' ' || substr(text, 1, 40)",
    "code": "'FT-' || (100 + doc_id % 5)",
    "criticality": "CASE WHEN doc_id % 3 = 0 THEN 'seguridad' ELSE 'normal' END",
    "version_status": "CASE WHEN doc_id % 11 = 0 THEN 'superseded' WHEN doc_id % 2 = 0 THEN 'active' END",
    "is_current": "CASE WHEN doc_id % 17 <> 0 THEN doc_id % 13 <> 0 END",
    "version_label": "'Rev ' || (doc_id % 3)",
    "page_start": "CASE WHEN doc_id % 2 = 0 THEN doc_id % 40 + 1 END",
}
POINTS = f"pt AS (SELECT doc_id, text, {', '.join(f'{x} AS {c}' for c, x in POINT.items())} FROM documents)"


def bm25_sql(of: str) -> str:
    return f"""{ASK}, {POINTS}, terms AS (SELECT DISTINCT q_id, unnest({TOKENS}) AS term FROM q), d AS (SELECT doc_id, {TOKENS} AS t FROM {of}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats GROUP BY term, n),
bm AS (SELECT q_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN post USING (term) JOIN idf USING (term), stats GROUP BY q_id, doc_id)"""


BM25 = bm25_sql("documents")
BM25_CURRENT = bm25_sql("(SELECT * FROM pt WHERE is_current)")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.expr(Q_TEXT).alias("q_text"), F.col("text").alias("passage"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *[F.expr(x).alias(c) for c, x in POINT.items()])


@query(f"WITH {BM25} SELECT q_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieval.bm25_top(retrieval.Tokens(table(spark, d, "documents")), asked(spark, d), 10)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def seeds(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))


DENSE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS q_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {DENSE} SELECT q_id, doc_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark, d):
    return retrieval.dense_ranked(vectors(spark, d), seeds(spark, d), 10)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS q_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0)
SELECT q_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 12 AND score >= 0.3""")
def neighbours_threshold(spark, d):
    return retrieval.neighbours(vectors(spark, d), seeds(spark, d), 0.3, 12).select("q_id", "doc_id", "score")


@query()
def neighbours_projected(spark, d):
    """The nearest vectors of every seed among those that share a bucket of random projections with it; the vectors have no structure, so buckets are wide."""
    return retrieval.projected_ranked(vectors(spark, d), seeds(spark, d), 10, tables=24, bits=4, probes=1)


# The dense ranking: cosine of hashed token counts, a stand-in for an embedding service.
SLOT = "CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64"
OVERLAP = f"""qv AS (SELECT q_id, {SLOT} AS slot, count(*)::DOUBLE AS c FROM (SELECT q_id, unnest({TOKENS}) AS term FROM q) GROUP BY ALL), dv AS (SELECT doc_id, {SLOT} AS slot, sum(tf)::DOUBLE AS c FROM post GROUP BY ALL),
qn AS (SELECT q_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY q_id), dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM dv GROUP BY doc_id),
ov AS (SELECT q_id, doc_id, round(sum(qv.c * dv.c) / (any_value(qn.n) * any_value(dn.n)), 6) AS score FROM qv JOIN dv USING (slot) JOIN qn USING (q_id) JOIN dn USING (doc_id) GROUP BY q_id, doc_id)"""
def ranks_sql(bm25: str) -> str:
    return f"""{bm25}, {OVERLAP}, r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20), r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM ov) WHERE rank <= 20),
fused AS (SELECT q_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + r1.rank), 0) + coalesce(1.0::DOUBLE / (60 + r2.rank), 0), 9) AS score FROM r1 FULL JOIN r2 USING (q_id, doc_id))"""


def fused(spark, d, docs, n):
    corpus, q = retrieval.Tokens(docs), asked(spark, d)
    return retrieval.rrf(retrieval.bm25_top(corpus, q, n), retrieval.hashed_ranked(corpus, q, n))


@query(f"WITH {ranks_sql(BM25)} SELECT q_id, doc_id, score FROM fused")
def rrf_fusion(spark, d):
    return fused(spark, d, table(spark, d, "documents"), 20)


LIMIT = 5
HITS = f"""{ranks_sql(BM25_CURRENT)}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 20),
hits AS (SELECT q_id, f.doc_id, f.rank, pt.* EXCLUDE (doc_id), f.score * CASE WHEN regexp_matches(q.text, '(?i){T.SAFETY_QUERY}') AND criticality = 'seguridad' THEN 1.5 ELSE 1 END * 1.1 AS score FROM pool f JOIN pt USING (doc_id) JOIN q USING (q_id) WHERE coalesce(version_status, 'active') = 'active'),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, document, section ORDER BY rank) AS rn FROM hits) WHERE rn = 1)"""


def hits(spark, d):
    """Hits of all queries over current points: the pool of the fused lists, without versions that aren't active, boosted; the first of each document and section in retrieval order."""
    pool, prefetch = retrieval.pool_sizes(LIMIT, 20)
    docs = points(spark, d)
    best = written(retrieval.top(fused(spark, d, docs.where("is_current").select("doc_id", "text"), prefetch), ["q_id"], [F.desc("score"), F.asc("doc_id")], pool))
    rows = retrieval.active_only(best.join(docs, "doc_id")).join(asked(spark, d), "q_id").withColumn("hit_id", F.col("doc_id"))
    score = retrieval.boost(F.col("score"), T.is_safety_query(F.col("q_text")), F.col("criticality") == "seguridad", F.coalesce("is_current", F.lit(False)))
    return retrieval.dedup_sections(rows.withColumn("score", score), ["q_id", "document", "section"])


@query(f"WITH {HITS} SELECT q_id, document, section, doc_id, round(score, 6) AS score FROM kept")
def boost_dedup(spark, d):
    return hits(spark, d).select("q_id", "document", "section", "doc_id", F.round("score", 6).alias("score"))


_FLAGS = "array_to_string(list_transform(qt, lambda t: CASE WHEN contains(lower(title), t) THEN '1' ELSE '0' END), '')"
_TAGS = "list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(qtext, '{p}')" for p in (T.QUERY_TAG, T.DOC_CODE, T.ACRONYM)) + ", lambda t: upper(t)))"
RERANK = f"""{HITS}, qt AS (SELECT q_id, text AS qtext, {TOKENS} AS qt FROM q),
parts AS (SELECT kept.*, qt, {_FLAGS} AS flags, len(list_filter(qt, lambda t: list_contains(x.t, t))) / greatest(len(qt), 1) AS overlap, len(list_filter({_TAGS}, lambda t: contains(upper(concat_ws(' ', title, kept.text)), t))) AS n_tags, CASE WHEN contains(upper(qtext), upper(code)) THEN 1 ELSE 0 END AS n_codes FROM kept JOIN qt USING (q_id) JOIN d x USING (doc_id)),
rr AS (SELECT *, round(0.35 * score + 0.45 * overlap + least(0.18 * n_tags + 0.22 * n_codes, 0.8) + CASE WHEN len(qt) < 2 THEN 0 WHEN contains(lower(title), substr(array_to_string(qt, ' '), 1, 24)) THEN 0.25 WHEN contains(flags, '111') THEN 0.2 WHEN contains(flags, '11') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS final FROM parts)"""


def reranked(spark, d):
    """All hits with their final score, written once."""
    query_tokens, none = T.tokenize(F.col("q_text")), F.lit("")
    tags = retrieval.tag_boost(F.col("q_text"), F.col("title"), F.col("text"), none, F.array("code"))
    score = retrieval.rerank_score(F.col("score"), query_tokens, F.col("text"), F.col("title"), tags)
    relevant = F.contains("text", F.substring("passage", 1, HEAD))
    rows = hits(spark, d).withColumns({"final": F.round(score, 6), "relevant": relevant, "n_text": F.length("text").cast("long")})
    return written(rows.drop("text", "q_text", "passage"))


@query(f"WITH {RERANK} SELECT q_id, doc_id, final FROM rr")
def rerank_score(spark, d):
    return reranked(spark, d).select("q_id", "doc_id", "final")


BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY final DESC, doc_id) AS pos FROM rr) WHERE pos <= {LIMIT})"


def best_hits(spark, d):
    return retrieval.top(reranked(spark, d).drop("rank"), ["q_id"], [F.desc("final"), F.asc("doc_id")], LIMIT)


@query(f"WITH {RERANK}, {BEST} SELECT q_id, pos AS rank, doc_id, final AS score, title || ' (' || version_label || ') — ' || CASE WHEN page_start IS NOT NULL THEN 'pág. ' || page_start ELSE section END AS citation FROM best")
def hybrid_search(spark, d):
    none = F.lit(None).cast("int")
    return best_hits(spark, d).select("q_id", "rank", "doc_id", F.col("final").alias("score"), T.citation(F.col("title"), F.col("version_label"), F.col("page_start"), none, F.col("section"), F.lit(0)).alias("citation"))


@query(f"WITH {RERANK}, {BEST} SELECT q_id, doc_id, lang, coalesce(quality, -1) AS quality, length(best.text) AS n_text, criticality FROM best JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def search_enriched(spark, d):
    best = best_hits(spark, d).select("q_id", "doc_id", "n_text", "criticality")
    enriched = best.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return enriched.select("q_id", "doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), "n_text", "criticality")


JUDGED = "j AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY {by}, doc_id) AS rank, contains(rr.text, substr(passage, 1, 60)) AS relevant FROM rr JOIN (SELECT q_id, passage FROM q) USING (q_id)), per AS (SELECT q_id, min(rank) FILTER (relevant) AS best, count(*) FILTER (relevant AND rank <= 1) AS n1, count(*) FILTER (relevant AND rank <= 3) AS n3, count(*) FILTER (relevant AND rank <= 5) AS n5, count(*) FILTER (relevant AND rank <= 8) AS n8 FROM j GROUP BY q_id)"
METRICS = "count(*) AS n_cases, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN best <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate_at_{k}, round(avg(coalesce(n{k}, 0) / {k}.0::DOUBLE), 6) AS precision_at_{k}" for k in (1, 3, 5, 8))


def judged(rows, order):
    """Places of all hits of a query by an order; a pool has at most 20 of them."""
    return retrieval.top(rows.withColumnRenamed("rank", "first_rank"), ["q_id"], [order, F.asc("doc_id")], 20).select("q_id", "rank", "relevant")


def cases(spark, d):
    return asked(spark, d).select("q_id", (F.col("q_id") % 4).alias("category"))


@query(f"WITH {RERANK}, {JUDGED.format(by='final DESC')} SELECT q_id % 4 AS category, {METRICS} FROM q LEFT JOIN per USING (q_id) GROUP BY ROLLUP (q_id % 4)")
def golden_metrics(spark, d):
    return reports.retrieval_metrics(judged(reranked(spark, d), F.desc("final")), cases(spark, d), "category")


@query(f"WITH {RERANK}, {JUDGED.format(by='rr.rank')}, a AS (SELECT {METRICS} FROM q LEFT JOIN per USING (q_id)), {JUDGED.format(by='final DESC').replace('j AS', 'j2 AS', 1).replace('per AS', 'per2 AS').replace('FROM j GROUP', 'FROM j2 GROUP')}, b AS (SELECT {METRICS} FROM q LEFT JOIN per2 USING (q_id)) SELECT a.mrr AS mrr_off, b.mrr AS mrr_on, round(b.mrr - a.mrr, 6) AS delta FROM a, b")
def rerank_delta(spark, d):
    """The mean reciprocal rank without and with the rerank, from one run of the search."""
    rows, asked_ = reranked(spark, d), cases(spark, d)
    both = judged(rows, F.asc("first_rank")).withColumn("category", F.lit("off")).unionByName(judged(rows, F.desc("final")).withColumn("category", F.lit("on")))
    per = both.groupBy("category", "q_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"))
    wide = asked_.join(per.groupBy("q_id").agg(*[F.max(F.when(F.col("category") == c, F.col("best"))).alias(c) for c in ("off", "on")]), "q_id", "left")
    means = wide.agg(*[F.round(F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0))), 6).alias(f"mrr_{c}") for c in ("off", "on")])
    return means.withColumn("delta", F.round(F.col("mrr_on") - F.col("mrr_off"), 6))


@query(f"SELECT document_key, count(DISTINCT v) AS n_versions, string_agg(DISTINCT v, ', ' ORDER BY v) AS versions FROM (SELECT p_brand AS document_key, 'Rev ' || (p_size % 5) AS v FROM part) GROUP BY document_key HAVING count(DISTINCT v) >= 2")
def version_conflicts(spark, d):
    rows = part_texts(spark, d).select(F.col("p_brand").alias("document_key"), F.regexp_extract("text", r"^(Rev \d)", 1).alias("version_label"))
    return insight.version_conflicts(rows)


@query("""SELECT document_key, metric, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(DISTINCT v) AS n_values FROM (SELECT p_brand AS document_key, 'temp_c' AS metric, p_size + 60 AS v FROM part UNION ALL SELECT p_brand, 'rpn', p_size * 3 FROM part UNION ALL SELECT p_brand, 'limit_c', p_size + 60 FROM part) GROUP BY ALL HAVING max(v) > min(v) AND (max(v) - min(v)) / max(v) > 0.02""")
def numeric_conflicts(spark, d):
    rows = part_texts(spark, d).select(F.col("p_brand").alias("document_key"), F.col("p_partkey").alias("doc_id"), "text")
    return insight.numeric_conflicts(insight.metrics(rows))


@query("SELECT l_partkey AS document_key, l_returnflag AS metric, min(l_tax) AS lo, max(l_tax) AS hi, count(DISTINCT l_tax) AS n_values FROM lineitem GROUP BY ALL HAVING max(l_tax) > min(l_tax) AND (max(l_tax) - min(l_tax)) / max(l_tax) > 0.02")
def numeric_spread(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("document_key"), F.col("l_returnflag").alias("metric"), F.col("l_tax").alias("value"))
    return insight.numeric_conflicts(rows)


@query("SELECT p_brand AS document_key, list_sort(list_distinct(list(p_size * 3)))[1]::INT AS least_rpn, list_sort(list_distinct(list(p_size * 3)))[-1]::INT AS most_rpn FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) >= 2")
def rpn_spread(spark, d):
    rows = part_texts(spark, d).select(F.col("p_brand").alias("document_key"), F.col("p_partkey").alias("doc_id"), "text")
    rpn = insight.metrics(rows).where("metric = 'rpn'")
    return insight.numeric_conflicts(rpn, 0.0).select("document_key", F.col("lo").cast("int").alias("least_rpn"), F.col("hi").cast("int").alias("most_rpn"))


@query("""WITH v AS (SELECT p_brand AS k, count(DISTINCT p_size % 5) AS n FROM part GROUP BY p_brand), x AS (SELECT 0 AS g, 'warn' AS severity, 'version' AS kind, 'conflict in ' || k AS text FROM v WHERE n >= 2 UNION ALL SELECT 1, 'info', 'numeric', 'conflict in ' || p_brand FROM part GROUP BY p_brand HAVING max(p_size) > min(p_size) UNION ALL SELECT 1, 'info', 'numeric', 'spread in ' || p_type FROM part GROUP BY p_type HAVING max(p_size) > min(p_size))
SELECT severity, kind, text, CASE severity WHEN 'warn' THEN 0 ELSE 1 END AS urgency FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY g, kind) AS rn FROM x) WHERE rn = 1""")
def conflicts_merged(spark, d):
    p = table(spark, d, "part")
    found = lambda df, sev, kind, what: df.select(F.lit(sev).alias("severity"), F.lit(kind).alias("kind"), F.concat(F.lit(what), F.col("k")).alias("text"))
    versions = p.groupBy(F.col("p_brand").alias("k")).agg(F.count_distinct(F.col("p_size") % 5).alias("n")).where("n >= 2")
    brand = p.groupBy(F.col("p_brand").alias("k")).agg(F.min("p_size").alias("a"), F.max("p_size").alias("b")).where("b > a")
    kind = p.groupBy(F.col("p_type").alias("k")).agg(F.min("p_size").alias("a"), F.max("p_size").alias("b")).where("b > a")
    return insight.merge_findings([found(versions, "warn", "version", "conflict in "), found(brand, "info", "numeric", "conflict in ").unionByName(found(kind, "info", "numeric", "spread in "))])


GRAPH = "h AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS doc_id, l_discount * 10 AS score, 'p' || (l_partkey % 97) AS a FROM lineitem), kept AS (SELECT * FROM h WHERE score >= 0.72)"


def mention_hits(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") * 10).alias("score"), F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 97).cast("string"))).alias("asset_codes"))


@query(f"WITH {GRAPH} SELECT DISTINCT 'chunk:' || chunk_id AS node_id, 'chunk' AS kind FROM kept UNION SELECT 'doc:' || doc_id, 'document' FROM kept UNION SELECT 'asset:' || upper(a), 'asset' FROM kept")
def graph_nodes(spark, d):
    return insight.nodes_and_edges(mention_hits(spark, d))[0]


@query(f"WITH {GRAPH} SELECT DISTINCT 'chunk:' || chunk_id AS source, 'doc:' || doc_id AS target, 'part_of' AS kind, 1.0::DOUBLE AS weight FROM kept UNION SELECT 'chunk:' || chunk_id, 'asset:' || upper(a), 'mentions_asset', 0.9 FROM kept")
def graph_edges(spark, d):
    return insight.nodes_and_edges(mention_hits(spark, d))[1]


ASKED_NODE = "CASE o_orderkey % 4 WHEN 0 THEN 'chunk:' || (o_orderkey * 1000 + 1 + o_orderkey % 3) WHEN 1 THEN 'doc:' || o_orderkey || ' ' || o_orderpriority WHEN 2 THEN 'asset:p-' || (o_custkey % 90) ELSE 'page:' || o_orderkey END"


@query(f"""WITH a AS (SELECT DISTINCT {ASKED_NODE} AS node_id FROM orders), h AS (SELECT line_id, l_orderkey, 'line ' || l_linenumber AS title FROM {LINES})
SELECT node_id, 'chunk' AS kind, title AS label, l_orderkey::VARCHAR AS doc_id FROM a JOIN h ON node_id = 'chunk:' || line_id UNION ALL SELECT node_id, 'document', substr(node_id, 5, 48), substr(node_id, 5) FROM a WHERE starts_with(node_id, 'doc:') UNION ALL SELECT node_id, 'asset', upper(substr(node_id, 7)), NULL FROM a WHERE starts_with(node_id, 'asset:')""")
def node_lookup(spark, d):
    hits_ = order_lines(spark, d).select(F.col("line_id").alias("chunk_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title"))
    return insight.found_nodes(table(spark, d, "orders").select(F.expr(ASKED_NODE).alias("node_id")), hits_)


@query(f"WITH {GRAPH} SELECT kind, count(*) AS n_edges FROM (SELECT DISTINCT 'part_of' AS kind, chunk_id, doc_id::VARCHAR AS t FROM kept WHERE doc_id % 2 = 0) GROUP BY kind")
def graph_views(spark, d):
    nodes, edges = insight.nodes_and_edges(mention_hits(spark, d))
    even = nodes.where("kind = 'chunk' OR kind = 'document' AND CAST(substring(node_id, 5) AS BIGINT) % 2 = 0")
    return insight.keep_inner_edges(edges, even).groupBy("kind").agg(F.count("*").alias("n_edges"))


@query("SELECT document_key, source, target, 0.85::DOUBLE AS weight FROM (SELECT source AS document_key, doc_id AS source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS target FROM documents) WHERE target IS NOT NULL")
def graph_same_key_edges(spark, d):
    return insight.same_key_edges(table(spark, d, "documents").select(F.col("source").alias("document_key"), F.col("doc_id").alias("chunk_id")))


@query(f"WITH {DENSE}, t AS (SELECT * FROM dense WHERE rank <= 10) SELECT a.q_id, a.doc_id AS da, b.doc_id AS db, least(a.score, b.score) AS weight FROM t a JOIN t b ON a.q_id = b.q_id AND b.rank BETWEEN a.rank + 1 AND a.rank + 3 WHERE least(a.score, b.score) >= 0.3")
def graph_rank_edges(spark, d):
    return insight.rank_band_edges(dense_topk(spark, d), 0.3)


@query(f"WITH {DENSE} SELECT DISTINCT doc_id FROM dense WHERE rank <= 5 AND doc_id % 50 <> 0")
def graph_expand(spark, d):
    found = dense_topk(spark, d).where("rank <= 5").select(F.col("doc_id").cast("string").alias("node_id")).distinct()
    existing = seeds(spark, d).select(F.col("q_id").cast("string").alias("node_id"))
    merged = insight.merge_nodes(existing, found)
    return merged.join(existing, "node_id", "left_anti").select(F.col("node_id").cast("long").alias("doc_id"))


@query(f"SELECT DISTINCT p_partkey AS chunk_id, 'failure_mode' AS kind, p_type AS label FROM part UNION SELECT p_partkey, 'rpn', CAST(p_size * 3 AS VARCHAR) FROM part")
def graph_concepts(spark, d):
    rows = part_texts(spark, d).select(F.col("p_partkey").alias("chunk_id"), "text", F.lit("otro").alias("tipo"))
    return insight.concepts(rows).select("chunk_id", "kind", "label")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, p_brand AS asset FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT a.asset, b.asset AS other, count(*) AS n_docs FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.asset < b.asset GROUP BY ALL HAVING count(*) >= 3")
def cooccurrence(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    m = li.join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_brand").alias("asset"))
    return insight.cooccurrence(m, 3)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOURS GROUP BY event_type")
def sensor_window(spark, d):
    kept = motor.sensor_window(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "7d", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


LIMITS = """l AS (SELECT event_type AS limit_tag, min(event_id) AS limit_id, quantile_cont(value, 0.9) AS limit_value FROM events GROUP BY event_type), r AS (SELECT event_id AS reading_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN 20.0::DOUBLE END AS nominal FROM events),
m AS (SELECT r.*, limit_id, CASE WHEN event_type < 'd' THEN 'max_temp' ELSE 'min_flow' END AS kind, limit_value FROM r JOIN l ON limit_tag = event_type)"""


def matched(spark, d):
    e = table(spark, d, "events")
    found = e.groupBy(F.col("event_type").alias("limit_tag")).agg(F.min("event_id").alias("limit_id")).join(reports.exact_percentiles(e, "event_type", "value", (0.9,)).select(F.col("event_type").alias("limit_tag"), F.col("x").alias("limit_value")), "limit_tag")
    found = found.withColumns({"limit_unit": F.lit("°C"), "kind": F.when(F.col("limit_tag") < "d", "max_temp").otherwise("min_flow")})
    readings = e.select(F.col("event_id").alias("reading_id"), F.col("event_type").alias("tag"), F.lit("°C").alias("unit"), "value", F.when(F.col("event_id") % 2 == 0, 20.0).alias("nominal"))
    return limits.match_limits(readings, found)


# Limits of suppliers with and without tags, with equal, partial, blank and other units, against readings of several units; the oracle tries every pair.
UNITS = ["°C", "C", "mm/s", "mm", "L/min", "l/min", "bar", ""]
LIMIT_PAIRS = f"""u AS (SELECT {UNITS} AS u), r AS (SELECT line_id AS reading_id, 'T-' || (l_suppkey % 23) AS tag, u[1 + l_partkey % 8] AS unit FROM {LINES}, u),
m AS (SELECT s_suppkey AS limit_id, CASE WHEN s_suppkey % 2 = 0 THEN 't-' || (s_suppkey % 31) END AS limit_tag, u[1 + s_suppkey % 8] AS limit_unit, ['max_temp', 'max_vibration', 'nominal_flow', 'generic_limit'][1 + s_suppkey % 4] AS kind FROM supplier, u),
rr AS (SELECT DISTINCT tag, unit FROM r), j AS (SELECT rr.tag, rr.unit, m.*, CASE WHEN limit_tag IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN unit <> '' AND limit_unit <> '' AND contains(lower(limit_unit), lower(unit)) THEN 2 ELSE 0 END + CASE WHEN contains(unit, '°') AND kind = 'max_temp' THEN 1 WHEN contains(lower(unit), 'l/min') AND kind = 'nominal_flow' THEN 1 WHEN contains(lower(unit), 'mm') AND kind = 'max_vibration' THEN 1 ELSE 0 END AS match_score
FROM rr JOIN m ON (limit_tag IS NULL OR upper(limit_tag) = upper(tag)) AND (contains(lower(limit_unit), lower(unit)) OR contains(lower(unit), lower(limit_unit))))"""


@query(f"WITH {LIMIT_PAIRS} SELECT reading_id, limit_id, match_score FROM r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tag, unit ORDER BY match_score DESC, limit_id) AS rn FROM j) b ON b.tag = r.tag AND b.unit = r.unit AND rn = 1")
def limit_match(spark, d):
    u = F.array(*[F.lit(x) for x in UNITS])
    readings = order_lines(spark, d).select(F.col("line_id").alias("reading_id"), F.concat(F.lit("T-"), (F.col("l_suppkey") % 23).cast("string")).alias("tag"), F.element_at(u, (1 + F.col("l_partkey") % 8).cast("int")).alias("unit"))
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in ("max_temp", "max_vibration", "nominal_flow", "generic_limit")])
    found = table(spark, d, "supplier").select(k.alias("limit_id"), F.when(k % 2 == 0, F.concat(F.lit("t-"), (k % 31).cast("string"))).alias("limit_tag"), F.element_at(u, (1 + k % 8).cast("int")).alias("limit_unit"), F.element_at(kinds, (1 + k % 4).cast("int")).alias("kind"), F.lit(1.0).alias("limit_value"))
    return limits.match_limits(readings, found).select("reading_id", "limit_id", "match_score")


@query(f"WITH {LIMITS} SELECT event_type AS tag, count(*) FILTER (CASE WHEN kind = 'min_flow' THEN value < limit_value ELSE value > limit_value END) AS n_over, sum(least(98, 90 + CASE WHEN nominal IS NOT NULL THEN 5 ELSE 0 END))::BIGINT AS confidence FROM m GROUP BY event_type")
def limit_exceeded(spark, d):
    over = motor.exceeded(F.col("kind"), F.col("value"), F.col("limit_value"), F.col("nominal"))
    rows = matched(spark, d).withColumn("over", over)
    c = motor.fact_confidence(F.col("limit_id").isNotNull(), F.col("over").isNotNull(), F.col("nominal").isNotNull())
    return rows.groupBy("tag").agg(F.count_if("over").alias("n_over"), F.sum(c).cast("long").alias("confidence"))


@query("""SELECT event_type, least(98, CAST(round_even(avg(c) + least(3 * count(DISTINCT user_id), 9) + CASE WHEN bool_or(value > 50) THEN 5 ELSE 0 END, 0) AS INT)) AS confidence_pct FROM (SELECT *, event_id % 90 AS c FROM events) GROUP BY event_type""")
def aggregate_confidence(spark, d):
    facts = table(spark, d, "events").select("event_type", (F.col("event_id") % 90).alias("confidence"), F.col("user_id").alias("source_doc"), (F.col("value") > 50).alias("exceeded"))
    return motor.aggregate_confidence(facts, ["event_type"]).select("event_type", "confidence_pct")


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS days, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 365 THEN 'warn' ELSE 'info' END AS severity FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 365 OR o_totalprice / 50000 > 5")
def calibration_overdue(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("last_calibration"), F.lit(365).alias("interval_days"), F.lit(5.0).alias("tolerance_pct"), (F.col("o_totalprice") / 50000).alias("drift_pct"))
    return motor.calibration_findings(rows, F.lit("1998-08-02").cast("date")).select("o_orderkey", F.col("days").cast("long").alias("days"), "severity")


SYMPTOM = "CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END"


@query(f"""SELECT c, order_id, nth FROM (SELECT o_custkey AS c, o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN best > 0 THEN s ELSE 0 END DESC, o_orderdate DESC, o_orderkey) AS nth FROM (SELECT *, {SYMPTOM} AS s, max({SYMPTOM}) OVER (PARTITION BY o_custkey) AS best FROM orders)) WHERE nth <= 3""")
def work_order_topk(spark, d):
    score = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"), "o_orderpriority")
    return motor.top_work_orders(rows, "c", score).select("c", "order_id", "nth")


@query("SELECT o_orderkey, o_totalprice AS mtbf_hours FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice < 0.85 * abs(c_acctbal) * 20")
def mtbf_low(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("mtbf_hours"), (F.abs("c_acctbal") * 20).alias("mtbf_expected_hours"))
    return motor.mtbf_findings(rows).select("o_orderkey", "mtbf_hours")


@query("""SELECT s_nationkey AS asset, 'H' || nth AS code, title, pct AS confidence_pct FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY pct DESC, title) AS nth FROM (SELECT s_nationkey, s_name AS title, greatest(0, least(100, CAST(round_even(s_acctbal / 90, 0) AS INT))) AS pct FROM supplier WHERE s_suppkey % 5 > 0)) WHERE nth <= 3""")
def hypotheses_ranked(spark, d):
    rows = table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("title"), F.lit("limit exceeded").alias("rationale"), (F.col("s_acctbal") / 90).alias("confidence"), (F.col("s_suppkey") % 5).alias("n_facts"))
    return motor.rank_hypotheses(rows, "s_nationkey").select(F.col("s_nationkey").alias("asset"), "code", "title", "confidence_pct")


@query("""WITH c AS (SELECT n_regionkey AS a, n_nationkey % 3 AS origin, n_name AS text, n_nationkey % 4 = 0 AS urgent, n_nationkey % 2 = 0 AS alarm, CASE n_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS crit FROM nation UNION ALL SELECT c_nationkey % 5, 2, c_mktsegment, FALSE, TRUE, 'C' FROM customer GROUP BY ALL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, lower(text) ORDER BY origin, text) AS rn FROM c) WHERE rn = 1), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY origin, lower(text)) AS nth FROM o)
SELECT a AS asset, text, urgent OR (alarm AND crit IN ('A', 'B')) AS urgent FROM n WHERE origin = 0 OR nth <= 3""")
def checks_prioritized(spark, d):
    k = F.col("n_nationkey")
    first = table(spark, d, "nation").select(F.col("n_regionkey").alias("asset"), (k % 3).alias("origin"), F.col("n_name").alias("text"), (k % 4 == 0).alias("urgent"), (k % 2 == 0).alias("alarm"), F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").otherwise("C").alias("criticality"))
    more = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("asset"), F.lit(2).alias("origin"), F.col("c_mktsegment").alias("text")).distinct().withColumns({"urgent": F.lit(False), "alarm": F.lit(True), "criticality": F.lit("C")})
    return motor.prioritise_checks(first.unionByName(more), "asset").select("asset", "text", "urgent")


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'extract' WHEN count(*) FILTER (role = 'assistant') < count(*) FILTER (role = 'user') THEN 'embed' ELSE 'validate_index' END AS resume_at FROM conversations GROUP BY conv_id")
def resume_stages(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("chunks"), F.count_if(F.col("role") == "assistant").alias("points"))
    return streams.resume_stage(rows).select("conv_id", "resume_at")
