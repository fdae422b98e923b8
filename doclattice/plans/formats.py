"""Registered queries of parsers, headings and the chunkers of all formats, with their oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import chunking
from .corpus import order_lines, query, table

#: Blocks of a page: tag and text up to the next tag.
TAG = r"<(h1|p|li)[^>]*>([^<]*)"
PAGE_BLOCKS = f"""r AS (SELECT page_id AS doc_id, regexp_extract_all(html, '{TAG}', 1) AS tags, regexp_extract_all(html, '{TAG}', 2) AS texts FROM pages),
u AS (SELECT doc_id, unnest(range(len(tags))) AS block_no, unnest(tags) AS tag, unnest(texts) AS text FROM r),
b AS (SELECT *, CASE WHEN tag = 'h1' OR length(text) % 5 = 0 THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN tag = 'h1' THEN 1 WHEN length(text) % 5 = 0 THEN 1 + length(text) % 4 END AS level FROM u)"""


def page_blocks(spark, d):
    """Headings, list items and paragraphs of pages in order; texts of some lengths count as headings of several levels."""
    pairs = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(TAG), F.lit(i)).alias(c) for i, c in ((1, "tag"), (2, "text"))])
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(pairs).alias("block_no", "x")).select("doc_id", "block_no", "x.tag", "x.text")
    n, titled = F.length("text"), (F.col("tag") == "h1") | (F.length("text") % 5 == 0)
    return rows.withColumns({"kind": F.when(titled, "heading").when(F.col("tag") == "li", "list").otherwise("paragraph"), "level": F.when(F.col("tag") == "h1", 1).when(titled, 1 + n % 4)})


@query(f"""WITH RECURSIVE {PAGE_BLOCKS},
s AS (SELECT doc_id, -1::BIGINT AS block_no, ['x'][1:0] AS stack FROM b WHERE block_no = 0
UNION ALL SELECT b.doc_id, b.block_no, CASE WHEN kind = 'heading' THEN list_append(stack[1:level - 1], b.text) ELSE stack END FROM s JOIN b ON b.doc_id = s.doc_id AND b.block_no = s.block_no + 1)
SELECT doc_id, block_no, kind, array_to_string(stack, ' | ') AS section FROM s JOIN b USING (doc_id, block_no)""")
def heading_sections(spark, d):
    return chunking.heading_paths(page_blocks(spark, d)).select("doc_id", "block_no", "kind", "section")


def parse_page(path: str, content: bytes) -> list[dict]:
    return [{"text": text, "section": tag} for tag, text in re.findall(TAG, content.decode("utf-8", "replace"))]


@query(f"""WITH {PAGE_BLOCKS} SELECT 'p' || doc_id || '.HTML' AS path, block_no, tag AS section, text FROM b""")
def parsed_blocks(spark, d):
    """Pages as files, read by the parser of their extension inside a lateral join."""
    tables.register_parsers(spark, {".html": parse_page, ".none": lambda path, content: []})
    table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".HTML")).alias("path"), F.col("html").cast("binary").alias("content")).createOrReplaceTempView("page_files")
    return spark.sql("SELECT path, b.block_no, b.section, b.text FROM page_files, LATERAL parse_blocks(path, content) b")


def mixed_rows(spark, d):
    """Documents as pdf segments, conversations as slides, pages as word files, orders as spreadsheets: rows of one table, by document and place."""
    cut = lambda df, i, form, kind: df.withColumns({"doc_id": F.col("doc_id") * 4 + i, "format": F.lit(form), "kind": F.lit(kind)}).select("doc_id", "seq", "format", "kind", "text", "section", "mark", "safety")
    no = F.lit(False)
    pdf = chunking.segments(table(spark, d, "documents")).select("doc_id", (F.col("line_no") * F.lit(1 << 20) + F.col("part")).alias("seq"), F.col("segment").alias("text"), "section", F.col("is_heading").alias("mark"), T.is_safety(F.col("segment")).alias("safety"))
    talks = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    slides = talks.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("seq"), "text", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("section"), (F.col("turn") % 2 == 0).alias("mark"), no.alias("safety"))
    word = chunking.document_blocks(chunking.heading_paths(page_blocks(spark, d))).select("doc_id", F.col("block_no").alias("seq"), "text", "section", F.col("whole").alias("mark"), no.alias("safety"))
    sheet = order_lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("nth_line").cast("long").alias("seq"), F.concat_ws(" | ", F.col("l_partkey").cast("string"), "l_returnflag").alias("text"), F.lit("Hoja 1").alias("section"), no.alias("mark"), no.alias("safety"))
    return cut(pdf, 0, "pdf", "otro").unionByName(cut(slides, 1, "pptx", "presentacion")).unionByName(cut(word, 2, ".DOCX", "guia")).unionByName(cut(sheet, 3, "xlsx", "tabla"))


@query()
def chunks_by_format(spark, d):
    """Chunks of documents of four formats, each cut through its rows in order."""
    return tables.cut_rows(mixed_rows(spark, d), "seq")
