"""Contradictions between hits, and the graph of documents, chunks, assets and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import concept_slug, decimal_comma

# Patterns of quantities in texts.
METRICS = {
    "temp_c": r"(?i)(\d+(?:[.,]\d+)?)\s*°?\s*C\b",
    "rpn": r"(?i)\bRPN\s*[:=]?\s*(\d+)\b",
    "criticidad": r"(?i)\bcriticidad\s*[:=]?\s*(\d+)\b",
    "limit_c": r"(?i)(?:l[ií]mite|m[aá]x(?:ima)?|alarma|umbral)\s*[^.\n]{0,25}?(\d+(?:[.,]\d+)?)\s*°?\s*C\b",
}
FAILURE = r"(?i)modo\s+de\s+falla[:\s\-]+([^\n.;]{4,72})"
EFFECT = r"(?i)efecto[s]?\s+(?:del\s+)?(?:modo\s+de\s+)?falla[:\s\-]+([^\n.;]{4,72})"


def metrics(hits: DataFrame) -> DataFrame:
    """document_key, doc_id, metric, value of every quantity in the texts."""
    found = F.concat(*[_values(m, p) for m, p in METRICS.items()])
    return hits.select("document_key", "doc_id", F.explode(found).alias("x")).select("document_key", "doc_id", F.col("x.metric").alias("metric"), F.col("x.value").alias("value"))


def _values(metric: str, pattern: str):
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda v: F.struct(F.lit(metric).alias("metric"), decimal_comma(v).alias("value")))


def numeric_conflicts(values: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Groups (document_key, metric) whose greatest and least values differ by more than the tolerance."""
    g = values.groupBy("document_key", "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("n_values"))
    return g.where((F.col("hi") > F.col("lo")) & ((F.col("hi") <= 0) | ((F.col("hi") - F.col("lo")) / F.col("hi") > tolerance)))


def version_conflicts(hits: DataFrame) -> DataFrame:
    """Document keys seen with two version labels or more."""
    g = hits.where("coalesce(version_label, '') <> ''").groupBy("document_key").agg(F.array_sort(F.collect_set("version_label")).alias("v"))
    return g.where(F.size("v") >= 2).select("document_key", F.size("v").alias("n_versions"), F.array_join("v", ", ").alias("versions"))


def merge_findings(groups: list[DataFrame]) -> DataFrame:
    """Findings (severity, kind, text) of rule groups; of texts that are equal in lower case the earlier group's stays; warnings first, then by kind."""
    every = None
    for i, g in enumerate(groups):
        g = g.select("severity", "kind", "text", F.lit(i).alias("grp"))
        every = g if every is None else every.unionByName(g)
    w = Window.partitionBy(F.lower("text")).orderBy("grp", "kind", "text")
    kept = every.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return kept.select("severity", "kind", "text", F.when(F.col("severity") == "warn", 0).otherwise(1).alias("urgency"))


def nodes_and_edges(hits: DataFrame, least: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """Chunk, document and asset nodes; part_of (1.0) and mentions_asset (0.9) edges of hits with enough score.

    hits: chunk_id, doc_id, score, asset_codes.
    """
    kept = hits.where(F.col("score") >= least)
    assets = kept.select("chunk_id", F.explode("asset_codes").alias("a")).select("chunk_id", F.upper("a").alias("asset"))
    nodes = kept.select(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("node_id"), F.lit("chunk").alias("kind"))
    nodes = nodes.unionByName(kept.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("document").alias("kind")))
    nodes = nodes.unionByName(assets.select(F.concat(F.lit("asset:"), "asset").alias("node_id"), F.lit("asset").alias("kind"))).distinct()
    chunk = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("source")
    edges = kept.select(chunk, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("target"), F.lit("part_of").alias("kind"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(assets.select(chunk, F.concat(F.lit("asset:"), "asset").alias("target"), F.lit("mentions_asset").alias("kind"), F.lit(0.9).alias("weight"))).distinct()
    return nodes, edges


# What a graph view may be filtered by.
FILTERS = {"domain": ("mantenibilidad", "confiabilidad", "seguridad", "ingenieria"), "kind": ("norma", "guia", "sop", "manual_oem", "tabla", "presentacion", "plano", "otro"), "version_label": ("vigente", "Rev 6", "REV02", "Rev 15"), "view": ("global", "documents", "concepts")}


def found_nodes(ids: DataFrame, hits: DataFrame) -> DataFrame:
    """(node_id, kind, label, doc_id) of the asked node ids: a chunk if there is a hit of it (chunk_id, doc_id, title), a document or an asset by its name; others aren't found."""
    name = lambda prefix: F.substring("node_id", len(prefix) + 1, 1 << 20)
    asked = ids.select("node_id").distinct()
    chunks = asked.where(F.col("node_id").startswith("chunk:")).join(hits, name("chunk:") == F.col("chunk_id").cast("string")).select("node_id", F.lit("chunk").alias("kind"), F.col("title").alias("label"), F.col("doc_id").cast("string").alias("doc_id"))
    named = F.when(F.col("node_id").startswith("doc:"), F.struct(F.lit("document").alias("kind"), F.substring(name("doc:"), 1, 48).alias("label"), name("doc:").alias("doc_id"))).when(F.col("node_id").startswith("asset:"), F.struct(F.lit("asset").alias("kind"), F.upper(name("asset:")).alias("label"), F.lit(None).cast("string").alias("doc_id")))
    return chunks.unionByName(asked.withColumn("x", named).where("x IS NOT NULL").select("node_id", "x.*"))


def rank_band_edges(hits: DataFrame, least: float, reach: int = 3) -> DataFrame:
    """similar_to edges between hits of different documents at most ``reach`` ranks apart, weighted by the lesser score."""
    a = hits.select("q_id", F.col("rank").alias("ra"), F.col("doc_id").alias("da"), F.col("score").alias("sa"))
    b = hits.select("q_id", F.col("rank").alias("rb"), F.col("doc_id").alias("db"), F.col("score").alias("sb"))
    near = a.withColumn("rb", F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.col("ra") + d))).join(b, ["q_id", "rb"])
    return near.where("da <> db").select("q_id", "da", "db", F.least("sa", "sb").alias("weight")).where(F.col("weight") >= least)


def same_key_edges(rows: DataFrame) -> DataFrame:
    """same_document_key edges (0.85) along each key: neighbours in order of id, so a key of m rows has m - 1 edges and one component."""
    w = Window.partitionBy("document_key").orderBy("chunk_id")
    return rows.withColumn("target", F.lead("chunk_id").over(w)).where("target IS NOT NULL").select("document_key", F.col("chunk_id").alias("source"), "target", F.lit(0.85).alias("weight"))


def concepts(hits: DataFrame) -> DataFrame:
    """Failure modes, effects and RPN of FMECA texts: chunk_id, kind, label, slug."""
    gate = F.col("text").rlike(r"(?i)\bFMECA\b") | F.lower("tipo").isin("tabla", "guia", "presentacion")
    kinds = {"failure_mode": FAILURE, "effect": EFFECT, "rpn": METRICS["rpn"]}
    found = F.concat(*[_labels(k, p) for k, p in kinds.items()])
    return hits.where(gate).select("chunk_id", F.explode(found).alias("x")).select("chunk_id", F.col("x.kind").alias("kind"), F.col("x.label").alias("label"), concept_slug(F.col("x.label")).alias("slug")).distinct()


def _labels(kind: str, pattern: str):
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("label")))


def cooccurrence(mentions: DataFrame, least: int) -> DataFrame:
    """Pairs of assets named in the same document, with the number of documents: (doc_id, asset)."""
    m = mentions.distinct()
    pairs = m.join(m.withColumnRenamed("asset", "other"), "doc_id").where("asset < other")
    return pairs.groupBy("asset", "other").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def keep_inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def merge_nodes(existing: DataFrame, found: DataFrame) -> DataFrame:
    return existing.unionByName(found.join(existing.select("node_id"), "node_id", "left_anti"))


VIEWS = {"documents": ("chunk", "document"), "concepts": ("asset", "concept")}


def view(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and inner edges of a view: global, documents or concepts."""
    if name not in VIEWS:
        return nodes, edges
    kept = nodes.where(F.col("kind").isin(*VIEWS[name]))
    return kept, keep_inner_edges(edges, kept)


def concept_edges(found: DataFrame) -> DataFrame:
    """co_occurs edges (0.75) of chunks and their concepts (chunk_id, kind, label)."""
    return found.select(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("source"), F.concat(F.lit("concept:"), "kind", F.lit(":"), "label").alias("target"), F.lit(0.75).alias("weight")).distinct()


def conflict_edges(chunks: DataFrame, conflicts: DataFrame) -> DataFrame:
    """conflicts_with edges (1.0) between chunks (chunk_id, document_key) of documents in conflict, each to the next: m - 1 for m chunks."""
    bad = chunks.join(conflicts.select("document_key").distinct(), "document_key", "left_semi")
    after = F.lead("chunk_id").over(Window.partitionBy("document_key").orderBy("chunk_id"))
    name = lambda c: F.concat(F.lit("chunk:"), F.col(c).cast("string"))
    return bad.withColumn("after", after).where("after IS NOT NULL").select(name("chunk_id").alias("source"), name("after").alias("target"), F.lit(1.0).alias("weight"))
