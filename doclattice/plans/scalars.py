"""Registered queries of hashes, numbers and labels over parts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assets, identity
from .corpus import query, table


@query("""SELECT p_partkey, sha256(concat_ws(chr(10), p_type, p_name, '', p_brand || '|' || p_type, p_name || '|' || p_size || chr(10) || p_brand)) AS block_hash,
    sha256(concat_ws(chr(10), p_name, '', p_brand, '', p_type || chr(10) || p_size || chr(10) || p_name)) AS slide_hash FROM part""")
def extraction_hashes(spark, d):
    s = F.col("p_size").cast("string")
    none = F.lit(None).cast("string")
    block = T.block_hash(F.col("p_type"), F.col("p_name"), none, F.array("p_brand", "p_type"), F.array(F.array(F.col("p_name"), s), F.array("p_brand")))
    slide = T.slide_hash(F.col("p_name"), none, F.col("p_brand"), none, F.array(F.array(F.col("p_type"), s), F.array("p_name")))
    return table(spark, d, "part").select("p_partkey", block.alias("block_hash"), slide.alias("slide_hash"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (1000000 + p_partkey) || '-' || (10000 + p_size) || '-' || (100 + p_size) || 'AB-' || (20000 + p_size) END AS number,
    CASE p_size % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 WHEN 2 THEN p_size + 2 WHEN 3 THEN p_size + 3 ELSE p_size END AS n,
    CASE p_size % 4 WHEN 0 THEN 'OK — listo' WHEN 1 THEN 'Rechazado' WHEN 2 THEN 'Excluido' ELSE 'new' END AS label FROM part""")
def file_facts(spark, d):
    """Engineering number, effective count and status label of files made of parts."""
    n = F.col("p_size")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("dwg "), F.when(n % 2 == 0, F.concat(s(F.col("p_partkey") + 1000000), F.lit("-"), s(n + 10000), F.lit("-"), s(n + 100), F.lit("AB-"), s(n + 20000))).otherwise("7-1"), F.lit(" rev.pdf"))
    extension = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".pptx", ".docx", ".xlsx", ".dwg")]), (n % 5 + 1).cast("int"))
    state = F.element_at(F.array(*[F.lit(x) for x in ("pass", "reject", "excluido", "new")]), (n % 4 + 1).cast("int"))
    count = T.effective_count(extension, n, n + 1, n + 2, n + 3)
    return table(spark, d, "part").select("p_partkey", T.engineering_number(name).alias("number"), count.alias("n"), T.status_label(state).alias("label"))


@query(r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN sha256(trim(regexp_replace(lower(p_name || '  X'), '\s+', ' ', 'g'))) WHEN 1 THEN sha256(trim(regexp_replace(lower('xlsx ' || p_brand || ' sheet_count:' || p_size || ' ' || p_name), '\s+', ' ', 'g'))) END AS content_hash FROM part""")
def extraction_content(spark, d):
    """The content hash of extractions: of the text, else of what else is known of them, else none."""
    m, none = F.col("p_size") % 3, F.lit(None).cast("string")
    known = lambda c: F.when(m == 1, c)
    rows = table(spark, d, "part").withColumns({
        "markdown": F.when(m == 0, F.concat("p_name", F.lit("  X"))), "format": known(F.lit("xlsx")), "quality": none, "source_path": known(F.col("p_brand")),
        "counts": F.when(m == 1, F.array(F.struct(F.lit("sheet_count").alias("name"), F.col("p_size").cast("long").alias("value")), F.struct(F.lit("page_count").alias("name"), F.lit(None).cast("long").alias("value")))),
        "parts": F.when(m == 1, F.array(F.struct(F.col("p_name").alias("name"), none.alias("title"), F.lit("").alias("text"), none.alias("markdown")))),
    })
    return rows.select("p_partkey", identity.content_of_extraction().alias("content_hash"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'tenant is missing' WHEN c_custkey % 5 = 0 THEN 'document key is missing' WHEN c_custkey % 3 = 0 THEN 'document type is missing' END AS missing FROM customer")
def missing_metadata(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", assets.missing_metadata(F.when(k % 7 != 0, "t"), F.when(k % 5 != 0, F.col("c_name")).otherwise("  "), F.when(k % 3 != 0, "guia").otherwise("")).alias("missing"))
