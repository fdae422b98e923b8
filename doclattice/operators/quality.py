"""Extraction quality: OCR rules and their roll-up, drawing detection, page quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LEAST, BLOCK_LEAST, FIELD_LEAST = 0.75, 0.60, 0.90

# Words that speak for a drawing or a document, in names and in texts.
NAME_DRAWING = r"(?i)\b(plano|planos|dwg|layout|isom|isometric|elevaci[oó]n|elevacion|corte|detalle|diagrama|p&id|pid|lamina|lámina|ga-|me-|el-|ln-|piping|arranque|tuberia)\b"
NAME_DOCUMENT = r"(?i)\b(instructivo|procedimiento|gu[ií]a|guia|norma|ncc|contabilidad|financier|manual|sop|progs|check\s*list|fmeca|rcm|capacitaci[oó]n|taller)\b"
DRAWING_NUMBER = r"(?i)\b\d{6,}-\d{5}-(?:\d{3}[A-Z]{2})-\d{5}\b"
TEXT_DRAWING = r"(?i)\b(plano|escala\s*1\s*:\s*\d+|detalle|corte|elevaci[oó]n|vista|nivel\s*\d+|revision\s*de\s*plano|drawing|sheet)\b"
TEXT_DOCUMENT = r"(?i)\b(instructivo|contabilidad|gerencia|procedimiento|activo\s+fijo|propiedad\s+planta\s+y\s+equipo|tabla\s+de\s+contenidos|vigencia:)\b"
SCALE = r"\b1\s*:\s*\d{1,4}\b"

RANK = {"pass": 0, "review": 1, "reject": 2}


def block_findings(blocks: DataFrame) -> DataFrame:
    """Rule rows (doc_id, page, rule, status) of OCR blocks (doc_id, page, block, text_raw, text_norm, confidence): low confidence, changed by
    normalising, empty."""
    rules = F.array(
        F.when(F.col("confidence") < BLOCK_LEAST, F.struct(F.lit("block_confidence").alias("rule"), F.lit("review").alias("status"))),
        F.when(F.col("text_raw") != F.col("text_norm"), F.struct(F.lit("raw_differs").alias("rule"), F.lit("review").alias("status"))),
        F.when(F.coalesce("text_norm", F.lit("")) == "", F.struct(F.lit("empty_block").alias("rule"), F.lit("reject").alias("status"))),
    )
    return blocks.select("doc_id", "page", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("doc_id", "page", "r.rule", "r.status")


def worst(status: Column) -> Column:
    """Roll-up: reject over review over pass."""
    rank = F.max(F.when(status == "reject", 2).when(status == "review", 1).otherwise(0))
    return F.when(rank == 2, "reject").when(rank == 1, "review").otherwise("pass")


def page_status(blocks: DataFrame) -> DataFrame:
    """Mean confidence (nulls left out) and status of every page."""
    g = blocks.groupBy("doc_id", "page").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n_blocks"))
    return g.withColumn("status", F.when(F.col("confidence").isNull(), "reject").when(F.col("confidence") < PAGE_LEAST, "review").otherwise("pass"))


def normalise_ocr(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"[ \t]+", " "))


def drawing_scores(files: DataFrame) -> DataFrame:
    """Drawing or document: (name, text, pages, empty_pages, avg_chars) to scores, kind, confidence and whether OCR is blocked."""
    name, text = F.col("name"), F.substring("text", 1, 8000)
    words = F.regexp_count(text, F.lit(r"\S+"))
    ratio = F.col("empty_pages") / F.greatest(F.col("pages"), F.lit(1))
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    drawing = add(name.rlike(NAME_DRAWING), 0.35) + add(name.rlike(DRAWING_NUMBER), 0.45) + add(text.rlike(TEXT_DRAWING), 0.25) + add(text.rlike(SCALE), 0.2) + add(ratio >= 0.5, 0.35) + add((F.col("avg_chars") < 250) & (ratio >= 0.3), 0.25)
    document = add(name.rlike(NAME_DOCUMENT), 0.45) + add(text.rlike(TEXT_DOCUMENT), 0.5) + add(words > 180, 0.25) + F.when((ratio <= 0.1) & (F.col("avg_chars") > 500), 0.45).when((ratio <= 0.25) & (F.col("avg_chars") > 800), 0.35).otherwise(0.0)
    d, t = F.round(drawing, 6), F.round(document, 6)
    rows = files.withColumns({"drawing_score": d, "document_score": t})
    gap = F.round(F.col("drawing_score") - F.col("document_score"), 6)
    kind = F.when(gap >= 0.15, "plano").when(gap <= -0.15, "documento").when(F.greatest("drawing_score", "document_score") > 0, "mixto").otherwise("desconocido")
    win, lose = F.greatest("drawing_score", "document_score"), F.least("drawing_score", "document_score")
    confidence = F.when(F.abs(gap) >= 0.15, F.least(F.lit(0.98), 0.45 + win - 0.5 * lose)).otherwise(0.4 + F.abs(gap))
    return rows.withColumn("kind", kind).withColumn("confidence", F.round(confidence, 3)).withColumn("block_ocr", (F.col("kind") != "plano") & (F.col("document_score") >= 0.35))


def document_quality(pages: DataFrame) -> DataFrame:
    """reject without any text, review with more than 5 % of empty pages: (doc_id, chars)."""
    g = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("chars", F.lit(0)) == 0).alias("empty_pages"))
    return g.withColumn("quality", F.when(F.col("empty_pages") == F.col("pages"), "reject").when(F.col("empty_pages") > 0.05 * F.col("pages"), "review").otherwise("pass"))
