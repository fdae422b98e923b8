"""Scans: manifests, extraction caches, directories, logs, grids, and page merging; parsers of binary formats are ports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_FILE = "struct<id:string,name:string,relative_path:string,source:string,extension:string,ready:boolean,include_in_analysis:boolean,processed:boolean,process_quality:string,phase0:string,document_key:string,revision:string,is_current:boolean,suggested_tipo:string,asset_tag:string,modulo:string>"

# Extension, reader, state.
FILE_TYPES = (
    (".pdf", "pdf", "ready"),
    (".xlsx", "excel", "ready"),
    (".xls", "excel", "partial"),
    (".pptx", "pptx", "ready"),
    (".docx", "docx", "ready"),
    (".doc", "doc", "partial"),
    (".csv", "excel", "planned"),
    (".txt", "text", "unsupported"),
    (".md", "text", "unsupported"),
    (".jpg", "ocr", "planned"),
    (".jpeg", "ocr", "planned"),
    (".png", "ocr", "planned"),
    (".tif", "ocr", "planned"),
    (".tiff", "ocr", "planned"),
)


def file_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILE_TYPES, "extension string, phase0 string, state string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``files`` array of JSON manifests."""
    return spark.read.schema(f"files array<{MANIFEST_FILE}>").json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")


def fixture_rows(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """Rows of one array of a JSON document (readings, calibrations, work_orders, cases)."""
    return spark.read.schema(f"{array} array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(array).alias("r")).select("r.*")


def extraction_cache(roots: list[DataFrame], key: str) -> DataFrame:
    """One row a key from several roots; a later root wins."""
    every = None
    for i, r in enumerate(roots):
        r = r.withColumn("_root", F.lit(i))
        every = r if every is None else every.unionByName(r)
    w = Window.partitionBy(key).orderBy(F.desc("_root"))
    return every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_root")


def directory(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """Files under a path: path, name, size, modified, file_id (16 hex digits of SHA-1 of the path), without their bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.substring(F.sha1(F.encode("path", "UTF-8")), 1, 16).alias("file_id"))
    rows = rows.where("NOT startswith(name, '.')")
    return rows if most is None else rows.orderBy("path").limit(most)


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, file_hash and content of files, for the ports below."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.sha2("content", 256).alias("file_hash"), "content")


BLOCKS = "path string, block_no int, text string, page int, sheet string, section string, needs_ocr boolean"


def extract_with(files: DataFrame, parse: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Blocks of binary files by an injected parser (PDF, Office, OCR services): path and bytes in, block dicts out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "block_no": i, "text": "", "page": 0, "sheet": None, "section": None, "needs_ocr": False, **b} for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, b in enumerate(parse(p, bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "block_no", "text", "page", "sheet", "section", "needs_ocr"])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def not_extracted(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path and hash aren't in the cache: what an extraction run has to do."""
    return files.join(cache.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def merge_ocr_pages(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native page texts, with OCR where they are empty: (doc_id, page, text)."""
    o = ocr.select("doc_id", "page", F.col("text").alias("ocr_text"))
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return native.join(o, ["doc_id", "page"], "left").select("doc_id", "page", F.when(empty, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), (empty & F.col("ocr_text").isNotNull()).alias("from_ocr"))


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def _carry(cells: Column) -> Column:
    """Blank cells take the one before."""
    step = lambda acc, c: F.concat(acc, F.array(F.when(c != "", c).otherwise(F.coalesce(F.element_at(F.reverse(acc), 1), F.lit("")))))
    return F.aggregate(cells, F.array().cast("array<string>"), step)


def _joined(parent: Column, child: Column) -> Column:
    return F.regexp_replace(F.concat(parent, F.lit(" > "), child), "^[ >]+|[ >]+$", "")


def grid_headers(grids: DataFrame, search: int = 40) -> DataFrame:
    """Header of every sheet of rows (sheet_id, row_no from 0, cells array<string>): sheet_id, header_row, data_row, names.

    The header is the fullest of the first ``search`` rows with two cells at least (the first of equals), blanks filled from the left. A row above with two cells
    gives "parent > child" names. A row below of mostly (60 %) values up to four characters is a sub-header, whose values join too. Of
    equal names all but the first get a number.
    """
    clean = F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit("")))
    head = grids.where(F.col("row_no") <= search).select("sheet_id", "row_no", clean.alias("cells")).withColumn("n", _filled(F.col("cells")))
    of = head.groupBy("sheet_id").agg(F.max_by("row_no", F.when((F.col("row_no") < search) & (F.col("n") >= 2), F.struct("n", -F.col("row_no")))).alias("h"), F.map_from_entries(F.collect_list(F.struct("row_no", "cells"))).alias("rows")).where("h IS NOT NULL")
    none = F.array().cast("array<string>")
    at = lambda d: F.coalesce(F.try_element_at("rows", F.col("h") + d), none)
    wide = of.select("sheet_id", "h", _carry(at(0)).alias("main"), at(-1).alias("above"), at(1).alias("below"))
    top = F.when(_filled(F.col("above")) >= 2, _carry(F.col("above"))).otherwise(none)
    blank = lambda c: F.coalesce(c, F.lit(""))
    wide = wide.withColumn("main", F.when(F.size(top) > 0, F.zip_with(top, "main", lambda t, m: F.when((blank(t) != "") & (blank(t) != blank(m)), _joined(blank(t), blank(m))).otherwise(F.when(blank(m) != "", m).otherwise(blank(t))))).otherwise(F.col("main")))
    said = F.filter("below", lambda c: c != "")
    sub = (F.size(said) >= 2) & (F.size(F.filter(said, lambda c: F.length(c) <= 4)) >= 0.6 * F.size(said))
    wide = wide.withColumns({"sub": sub, "main": F.when(sub, F.slice(F.zip_with("main", "below", lambda m, s: F.when(blank(s) != "", _joined(blank(m), s)).otherwise(blank(m))), F.lit(1), F.size("main"))).otherwise(F.col("main"))})
    same = lambda n, i: F.size(F.filter(F.slice("main", F.lit(1), i), lambda m: m == n))
    names = F.transform("main", lambda n, i: F.when((n != "") & (same(n, i) > 0), F.concat(n, F.lit("_"), (same(n, i) + 1).cast("string"))).otherwise(n))
    return wide.select("sheet_id", F.col("h").alias("header_row"), (F.col("h") + F.when(F.col("sub"), 2).otherwise(1)).alias("data_row"), names.alias("names"))


def grid_records(grids: DataFrame, search: int = 40) -> DataFrame:
    """Non-empty rows below the header (``grid_headers``) as "name: value | ...", null where a cell is empty; columns without name and value in the whole sheet are left out, others without a name are col_n."""
    rows = grids.select("sheet_id", "row_no", F.transform("cells", lambda c: F.coalesce(F.trim(c), F.lit(""))).alias("cells"))
    body = rows.join(grid_headers(grids, search), "sheet_id").where((F.col("row_no") >= F.col("data_row")) & (_filled(F.col("cells")) > 0))
    used = body.select("sheet_id", F.posexplode("cells").alias("c", "v")).where("v <> ''").groupBy("sheet_id").agg(F.collect_set("c").alias("used"))
    cell = lambda n, i: F.when((n != "") | F.array_contains("used", i), F.concat(F.when(n != "", n).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))), F.lit(": "), F.coalesce(F.nullif(F.try_element_at("cells", i + 1), F.lit("")), F.lit("null"))))
    line = F.array_join(F.filter(F.transform("names", cell), lambda x: x.isNotNull()), " | ")
    return body.join(used, "sheet_id").select("sheet_id", "row_no", line.alias("text_line"))


def sheet_states(grids: DataFrame, search: int = 40) -> DataFrame:
    """ok, template_only (a header without data rows) or no_table for every sheet, with its data rows."""
    n = grid_records(grids, search).groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    heads = grid_headers(grids, search).select("sheet_id", "header_row")
    rows = grids.select("sheet_id").distinct().join(heads, "sheet_id", "left").join(n, "sheet_id", "left")
    return rows.select("sheet_id", "header_row", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("header_row").isNull(), "no_table").when(F.col("n_rows").isNull(), "template_only").otherwise("ok").alias("status"))


def staging_pages(pages: DataFrame) -> DataFrame:
    """Recognised pages with their number as such; order by it where order matters."""
    return pages.withColumn("page", F.col("page").cast("int"))


def retrieve(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """The points of the given ids."""
    return points.join(ids.select(key).distinct(), key, "left_semi")


def extract_formats(files: DataFrame, parsers: dict[str, Callable[[str, bytes], list[dict]]]) -> DataFrame:
    """Blocks of binary files by the parser of their extension, united; files without one give none."""
    out = None
    for extension, parse in parsers.items():
        one = extract_with(files.where(F.lower("path").endswith(extension)), parse)
        out = one if out is None else out.unionByName(one)
    return out


def log_progress(lines: DataFrame, pattern: str, fields: list[str]) -> DataFrame:
    """The last line of every log that matches: (source, line_no, line) to the pattern's groups."""
    hit = lines.where(F.col("line").rlike(pattern))
    last = hit.groupBy("source").agg(F.max_by("line", "line_no").alias("line"), F.max("line_no").alias("line_no"))
    return last.select("source", "line_no", *[F.regexp_extract("line", pattern, i + 1).alias(f) for i, f in enumerate(fields)])


def provider(url: Column) -> Column:
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    return F.when(F.contains(host, F.lit("sharepoint")), "sharepoint").when(F.contains(host, F.lit("onedrive")) | F.contains(host, F.lit("1drv.ms")), "onedrive").otherwise("other")
