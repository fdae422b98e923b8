"""Registered queries on texts, identity, chunks, changes and reports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assets, chunking, dml, identity, quality, reports
from ..sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
#: Order lines with a number of their own in their order and over all (line numbers repeat).
LINES = f"(SELECT *, nth_line + 1000 * l_orderkey AS line_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS nth_line FROM lineitem))"


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    return table(spark, d, "lineitem").withColumn("nth_line", nth).withColumn("line_id", F.col("l_orderkey") * 1000 + F.col("nth_line"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
NORM = r"trim(regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g'))"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda x: length(x) > 2 AND x NOT IN ({STOP}))"
STATUS = "CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'reject' END"
FILES = f"files AS (SELECT d.doc_id AS file_id, 'doc ' || d.doc_id || ' rev ' || (d.doc_id % 7) AS name, source AS folder, lang, n_chars AS n_tokens, {STATUS} AS status, coalesce(toxic, 1) = 0 AS indexed, lang || ' text below the quality gate' AS reason FROM documents d LEFT JOIN labels l USING (doc_id))"


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a corpus: source is the folder, a label of quality the extraction status, clean ones are indexed."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.drop("text").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "reject")
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" rev "), (F.col("doc_id") % 7).cast("string"))
    return rows.select(F.col("doc_id").alias("file_id"), name.alias("name"), F.col("source").alias("folder"), "lang", F.col("n_chars").alias("n_tokens"), status.alias("status"), (F.coalesce("toxic", F.lit(1)) == 0).alias("indexed"), F.concat("lang", F.lit(" text below the quality gate")).alias("reason"))


@query(f"SELECT doc_id, sha256({NORM}) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT h AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256({NORM}) AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    hashed = content_hash(spark, d)
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = T.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i){T.SAFETY_TERMS}') AS hazard FROM documents")
def safety_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_safety(F.col("text")).alias("hazard"))


PART_TEXT = "'Rev ' || (p_size % 5) || ' FMECA p-' || p_partkey || ' ' || upper(substr(p_type, 1, 2)) || '-' || (100 + p_size) || ' RPN ' || (p_size * 3) || ' limite ' || (60 + p_size) || ' °C modo de falla: ' || p_type || '. GUIGS-' || p_size"


def part_texts(spark: SparkSession, d: str) -> DataFrame:
    """Maintenance-like text of every part: revision, tags, RPN, limit and failure mode from its columns."""
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Rev "), (F.col("p_size") % 5).cast("string"), F.lit(" FMECA p-"), s("p_partkey"), F.lit(" "), F.upper(F.substring("p_type", 1, 2)), F.lit("-"), (F.col("p_size") + 100).cast("string"), F.lit(" RPN "), (F.col("p_size") * 3).cast("string"), F.lit(" limite "), (F.col("p_size") + 60).cast("string"), F.lit(" °C modo de falla: "), "p_type", F.lit(". GUIGS-"), s("p_size"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", text.alias("text"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[A-Z]{{2,4}}-\\d{{2,5}}\\b'))), ',') AS tags, regexp_matches(text, '(?i)\\bRPN\\b') AS has_rpn FROM (SELECT p_partkey, {PART_TEXT} AS text FROM part)")
def asset_codes(spark, d):
    return part_texts(spark, d).select("p_partkey", F.array_join(T.asset_tags(F.col("text")), ",").alias("tags"), F.col("text").rlike(r"(?i)\bRPN\b").alias("has_rpn"))


@query(f"""SELECT p_partkey, list_contains(x, upper(substr(p_type, 1, 2)) || '-' || (100 + p_size)) AS has_tag, list_contains(x, 'GUIGS-' || p_size) AS has_code, list_contains(x, 'FMECA') AS has_acronym
FROM (SELECT p_partkey, p_type, p_size, list_transform(regexp_extract_all(text, '\\b[A-Z]{{1,4}}-\\d{{2,5}}[A-Z0-9]*\\b') || regexp_extract_all(text, '(?i)\\bGUIGS-\\d+\\b') || regexp_extract_all(text, '(?i)\\b(?:FMECA|GUIGS)\\b'), lambda t: upper(t)) AS x FROM (SELECT *, {PART_TEXT} AS text FROM part))""")
def exact_tags(spark, d):
    x = T.exact_tags(F.col("text"))
    return part_texts(spark, d).select("p_partkey", F.array_contains(x, F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("-"), (F.col("p_size") + 100).cast("string"))).alias("has_tag"), F.array_contains(x, F.concat(F.lit("GUIGS-"), F.col("p_size").cast("string"))).alias("has_code"), F.array_contains(x, F.lit("FMECA")).alias("has_acronym"))


@query("""SELECT page_id, host, CASE WHEN contains(host, 'sharepoint') THEN 'sharepoint' WHEN contains(host, 'onedrive') OR contains(host, '1drv.ms') THEN 'onedrive' ELSE 'other' END AS provider
FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)""")
def url_provider(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), readers.provider(F.col("url")).alias("provider"))


@query("""SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (CASE h[17:17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END) || h[18:20] || '-' || h[21:32] AS point_id
FROM (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('d' || p_partkey || ':0')) AS h FROM part)""")
def point_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", T.uuid5_url(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(":0"))).alias("point_id"))


@query("""SELECT p_partkey, p_brand || ' (Rev ' || (p_size % 5) || ')' || CASE WHEN p_size % 3 = 0 THEN ' — págs. ' || (p_size + 1) || '–' || (p_size + 3) WHEN p_size % 3 = 1 THEN ' — pág. ' || (p_size + 1) WHEN p_size % 2 = 0 THEN ' — hoja/fila: ' || p_type WHEN p_size % 5 = 0 THEN ' — fragmento #' || (p_partkey + 1) ELSE ' — ' || p_type END AS citation FROM part""")
def citations(spark, d):
    n = F.col("p_size")
    start, end = F.when(n % 3 < 2, n + 1), F.when(n % 3 == 0, n + 3)
    section = F.when((n % 2 == 1) & (n % 5 == 0), "").otherwise(F.col("p_type"))
    kind = F.when(n % 2 == 0, "tabla").otherwise("guia")
    return table(spark, d, "part").select("p_partkey", T.citation(F.col("p_brand"), F.concat(F.lit("Rev "), (n % 5).cast("string")), start, end, section, F.col("p_partkey"), kind).alias("citation"))


#: Columns of a catalogue of files made of customers, in SQL that both engines read: revisions, dates, codes, guide numbers, equal names
#: and titles, assets, hints, repeated files and contents.
CATALOGUE = {
    "tenant": "'T' || c_nationkey",
    "origin": "CASE WHEN c_custkey % 2 = 0 THEN 'Local' END",
    "kind": "CASE WHEN c_custkey % 3 = 0 THEN 'Guía' WHEN c_custkey % 3 = 1 THEN 'manual_oem' END",
    "name": "CASE c_custkey % 8 WHEN 0 THEN 'Manual ' || c_mktsegment || ' Rev ' || (c_custkey % 3) || '.pdf' WHEN 1 THEN 'NCC-' || (c_custkey % 4) || ' ' || lower(c_mktsegment) || '_v2.pdf'"
    " WHEN 2 THEN 'GUIGS-' || (c_custkey % 5) || ' guía ' || c_mktsegment || ' 2024-01-1' || (c_custkey % 7) || '.docx' WHEN 3 THEN 'MANUAL ' || c_mktsegment || '.pdf' WHEN 4 THEN 'Informe ' || (c_custkey % 2) || '.xlsx'"
    " WHEN 5 THEN 'Plano revision b ' || lower(c_mktsegment) || ' siemens.dwg' WHEN 6 THEN 'informe ' || (c_custkey % 2) || '.XLSX' ELSE 'Bomba 20240115 rev. ' || (c_custkey % 2) || ' 15-01-2024.pdf' END",
    "path": "CASE c_custkey % 5 WHEN 0 THEN 'Entregables/MYC' WHEN 1 THEN 'Anexos/Planta Norte' WHEN 2 THEN 'M&C' ELSE '' END",
    "hint": "CASE WHEN c_custkey % 29 = 0 THEN ' hint ' || (c_custkey % 2) END",
    "asset": "CASE WHEN c_custkey % 4 = 1 THEN 'FT-' || (100 + c_custkey % 3) END",
    "model": "CASE WHEN c_custkey % 6 = 0 THEN 'S7 ' || (c_custkey % 2) END",
    "file_hash": "'h' || c_mktsegment || (c_custkey % 60)",
    "content_hash": "CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_mktsegment || (c_custkey % 3) END",
}


def catalogue_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return rows.select(F.col("c_custkey").alias("file_id"), F.col("c_custkey").alias("arrival"), *[F.expr(x).alias(c) for c, x in CATALOGUE.items()])


def _sql_part(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def _re2(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


_LONGEST = "list_filter(tags, lambda t: length(t) = list_max(list_transform(tags, lambda u: length(u))))[1]"
_MODULE = "coalesce(" + ", ".join(f"CASE WHEN contains(upper(path || ' ' || name).replace('&', ''), '{m.replace('&', '')}') THEN '{m.replace('&', '')}' END" for m in T.MODULES) + f", list_filter(list_transform(string_split(path, '/'), lambda p: {_sql_part('p')}), lambda p: length(p) >= 3 AND p NOT IN {T.NO_MODULE})[1][:40], '')"
_VENDOR = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(path || ' ' || name), '{v}') THEN '{v}' END" for v in T.VENDORS) + ", '')"
KEYED_FILES = f"""f AS (SELECT c_custkey AS file_id, {', '.join(f'{x} AS {c}' for c, x in CATALOGUE.items() if c not in ('origin', 'kind', 'hint', 'asset', 'model'))}, lower(coalesce({CATALOGUE['origin']}, 'ods1')) AS origin, lower(coalesce({CATALOGUE['kind']}, 'otro')) AS kind,
    trim(coalesce({CATALOGUE['hint']}, '')) AS hint, coalesce({CATALOGUE['asset']}, '') AS own, coalesce({CATALOGUE['model']}, '') AS model FROM customer),
g AS (SELECT *, upper(coalesce(nullif(regexp_extract(name, '{T.NAME_CODE}', 1), ''), regexp_extract(path, '{T.NAME_CODE}', 1))) AS code,
    CASE WHEN regexp_matches(name, '{T.GUIDE_NUMBER}') THEN upper(regexp_extract(name, '{T.GUIDE_NUMBER}', 1)) || '-' || regexp_extract(name, '{T.GUIDE_NUMBER}', 2) ELSE '' END AS guide,
    {_MODULE} AS module, {_VENDOR} AS maker, list_filter(list_transform(regexp_extract_all(upper(path || ' ' || name), '{T.NAME_ASSET}'), lambda t: translate(t, ' _', '--')), lambda t: length(t) >= 4 AND NOT starts_with(t, 'REV')) AS tags,
    {_sql_part(f"regexp_replace(regexp_replace(regexp_replace(name, '^(.+)[.][^.]+$', '\\1'), '{_re2(T.NAME_REVISION)}', ' ', 'g'), '{_re2(T.NAME_DATE)}', ' ', 'g')")} AS title FROM f),
p AS (SELECT *, coalesce(nullif(own, ''), {_LONGEST}, '') AS asset FROM g),
q AS (SELECT *, list_filter([{_sql_part('tenant')}, {_sql_part('origin')}, {_sql_part('code')}, {_sql_part('asset')}, {_sql_part('kind')}, {_sql_part('module')}], lambda y: y <> '') AS by_code, list_filter([{_sql_part('tenant')}, {_sql_part('origin')}, {_sql_part('guide')}, {_sql_part('asset')}, {_sql_part('kind')}, {_sql_part('module')}], lambda y: y <> '') AS by_guide,
    list_filter([{_sql_part('tenant')}, title, {_sql_part('asset')}, {_sql_part('maker')}, {_sql_part('model')}, {_sql_part('module')}], lambda y: y <> '') AS by_title FROM p),
k AS (SELECT *, CASE WHEN hint <> '' THEN hint WHEN code <> '' THEN array_to_string(by_code, '|') WHEN guide <> '' AND len(by_guide) >= 3 THEN array_to_string(by_guide, '|') ELSE array_to_string(by_title, '|') END AS logical_key FROM q),
keyed AS (SELECT *, CASE WHEN hint <> '' OR code <> '' OR (guide <> '' AND asset <> '') THEN 'high' WHEN (guide <> '' AND module <> '') OR length(logical_key) - length(replace(logical_key, '|', '')) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM k)"""


@query(f"WITH {KEYED_FILES} SELECT file_id, logical_key, title, code, guide, module, asset, maker, confidence FROM keyed")
def logical_keys(spark, d):
    return identity.with_identity(catalogue_files(spark, d)).select("file_id", "logical_key", T.title_key(F.col("name")).alias("title"), "code", "guide", "module", "asset", "maker", "confidence")


def identity_files(spark, d):
    docs = table(spark, d, "documents")
    h = T.content_hash(F.col("text"))
    return docs.select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), F.col("source").alias("logical_key"), h.alias("file_hash"), h.alias("content_hash"))


@query(f"""WITH f AS (SELECT doc_id, source, sha256({NORM}) AS h FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM f),
r AS (SELECT *, lag(h) OVER (PARTITION BY source ORDER BY doc_id) AS before, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS key_nth FROM n WHERE nth = 1)
SELECT doc_id AS file_id, source AS logical_key, CASE WHEN key_nth = 1 THEN 'new_document' WHEN before = h THEN 'same_content' ELSE 'new_version' END AS decision FROM r
UNION ALL SELECT doc_id, source, 'duplicate' FROM n WHERE nth > 1""")
def identity_decisions(spark, d):
    return identity.decisions(identity_files(spark, d))


_REC = "struct_pack(key := logical_key, h := file_hash, content := content_hash, name := lower(name), title := title, code := code, asset := asset, low := low, latest := true)"
_CLASH = "x.latest AND x.key <> logical_key"


@query(f"""WITH RECURSIVE {KEYED_FILES},
o AS (SELECT *, confidence = 'low' AS low, row_number() OVER (PARTITION BY tenant ORDER BY file_id) AS i FROM keyed),
r AS (SELECT tenant, 0::BIGINT AS i, [{_REC}][1:0] AS reg, 0::BIGINT AS file_id, '' AS logical_key, '' AS decision, '' AS rule FROM o WHERE i = 1
UNION ALL SELECT tenant, i, CASE WHEN decision NOT IN ('new_document', 'new_version') THEN reg
    WHEN known IS NULL OR (content_hash IS NOT NULL AND known.content IS DISTINCT FROM content_hash) THEN list_append(list_transform(reg, lambda x: struct_pack(key := x.key, h := x.h, content := x.content, name := x.name, title := x.title, code := x.code, asset := x.asset, low := x.low, latest := x.latest AND x.key <> logical_key)), rec)
    ELSE list_append(reg, struct_pack(key := rec.key, h := rec.h, content := rec.content, name := rec.name, title := rec.title, code := rec.code, asset := rec.asset, low := rec.low, latest := false)) END, file_id, logical_key, decision, rule
  FROM (SELECT *, CASE WHEN rule = 'file_hash' THEN 'duplicate' WHEN rule IN ('code', 'name', 'title') THEN 'review' WHEN rule = 'new_key' THEN 'new_document' WHEN rule = 'content_hash' THEN CASE WHEN known.content = content_hash THEN 'same_content' ELSE 'new_version' END WHEN low THEN 'review' ELSE 'new_version' END AS decision
    FROM (SELECT *, CASE WHEN list_contains(list_transform(reg, lambda x: x.h), file_hash) THEN 'file_hash'
        WHEN code <> '' AND len(list_filter(reg, lambda x: {_CLASH} AND x.code = code AND ((asset <> '' AND x.asset <> '' AND x.asset <> asset) OR low OR x.low))) > 0 THEN 'code'
        WHEN low AND len(list_filter(reg, lambda x: x.key <> logical_key AND x.name = lower(name))) > 0 THEN 'name' WHEN low AND title <> '' AND len(list_filter(reg, lambda x: {_CLASH} AND x.title = title)) > 0 THEN 'title'
        WHEN known IS NULL THEN 'new_key' WHEN content_hash IS NOT NULL AND known.content IS NOT NULL THEN 'content_hash' ELSE 'no_content_hash' END AS rule
      FROM (SELECT o.*, r.reg, {_REC.replace(':= ', ':= o.').replace('o.lower(name)', 'lower(o.name)').replace('o.true', 'true')} AS rec, list_filter(r.reg, lambda x: x.latest AND x.key = o.logical_key)[1] AS known FROM r JOIN o ON o.tenant = r.tenant AND o.i = r.i + 1))))
SELECT file_id, logical_key, decision, rule FROM r WHERE i > 0""")
def identity_replay(spark, d):
    """Nations are the tenants of the catalogue."""
    return identity.replay(identity.with_identity(catalogue_files(spark, d))).select("file_id", "logical_key", "decision", "rule")


@query(f"SELECT decision, count(*) AS n, count(*) FILTER (decision IN ('new_document', 'new_version')) AS indexable FROM ({ORACLE_SQL['identity_decisions']}) GROUP BY ROLLUP (decision)")
def decision_counts(spark, d):
    return identity_decisions(spark, d).rollup("decision").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("new_document", "new_version")).alias("indexable"))


@query("""WITH v AS (SELECT source AS catalog_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_no, n_chars % 11 = 0 AS broken FROM documents)
SELECT doc_id, catalog_id, CASE WHEN broken THEN 'indexed' WHEN version_no = newest THEN 'active' WHEN version_no < newest THEN 'superseded' ELSE 'indexed' END AS status, NOT broken AND version_no = newest AS is_current
FROM (SELECT *, max(CASE WHEN NOT broken THEN version_no END) OVER (PARTITION BY catalog_id) AS newest FROM v)""")
def active_versions(spark, d):
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    points = F.when(F.col("n_chars") % 11 == 0, 0).otherwise(1)
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("catalog_id"), nth.alias("version_no"), F.lit(1).alias("chunks"), points.alias("points"), F.lit(1).alias("expected"))
    return identity.activate(rows).select("doc_id", "catalog_id", "status", "is_current")


@query("""WITH o AS (SELECT c_nationkey AS k, c_name AS name, c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_nationkey AS k, c_name AS name, c_custkey AS id FROM customer WHERE c_custkey % 2 = 1),
e AS (SELECT k, min_by(name, id) AS name FROM o WHERE k < 15 GROUP BY k), n AS (SELECT k, min_by(name, id) AS name FROM i GROUP BY k)
SELECT * FROM e UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM e)""")
def upsert_catalog_first_wins(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    one = lambda df: df.groupBy("k").agg(F.min_by("name", "id").alias("name"))
    return dml.upsert_first_wins(one(c.where("id % 2 = 0 AND k < 15")), one(c.where("id % 2 = 1")), ["k"])


@query("""SELECT tag, retail FROM (SELECT p_brand || '-' || p_size AS tag, p_retailprice AS retail, row_number() OVER (PARTITION BY p_brand || '-' || p_size ORDER BY p_partkey % 3 = 1 DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""")
def upsert_assets_last_wins(spark, d):
    p = table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("tag"), F.col("p_retailprice").alias("retail"), "p_partkey")
    return dml.upsert_last_wins(p.where("p_partkey % 3 <> 1"), p.where("p_partkey % 3 = 1"), ["tag"], F.col("p_partkey")).select("tag", "retail")


@query(f"""WITH f AS (SELECT doc_id, source AS logical_key, sha256({NORM}) AS file_hash FROM documents)
SELECT doc_id, logical_key FROM f WHERE file_hash NOT IN (SELECT file_hash FROM f JOIN labels USING (doc_id) WHERE quality = 1) AND logical_key NOT IN ('src0', 'src1')""")
def retention_clean(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.col("source").alias("logical_key"), T.content_hash(F.col("text")).alias("file_hash"))
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    allowed = f.join(good, "doc_id", "left_semi").select("file_hash").distinct()
    return dml.retention(f, allowed, f.where("logical_key IN ('src0', 'src1')").select("logical_key").distinct()).select("doc_id", "logical_key")


@query("""SELECT o_orderkey, CASE WHEN p.o_orderkey IS NOT NULL THEN 'P' ELSE o.o_orderstatus END AS o_orderstatus, o_totalprice FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity >= 49) p USING (o_orderkey)""")
def patch_status(spark, d):
    late = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderstatus", F.lit("P"))
    return dml.patch(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), late, "o_orderkey", ["o_orderstatus"])


@query("SELECT user_id, event_id, CAST(ts AS VARCHAR) AS created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') <= 432000) WHERE nth <= 3")
def session_ttl_eviction(spark, d):
    puts = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created"), F.col("ts").cast("string").alias("at"))
    live = dml.live_sessions(puts, F.lit("2024-01-20 00:00:00").cast("timestamp"), 5 * 86400, 3)
    return live.select(F.col("owner").alias("user_id"), F.col("session_id").alias("event_id"), F.col("at").alias("created"))


@query("SELECT 'quantity' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS broken FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (NOT l_discount < 0.05) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (NOT l_returnflag IN ('A', 'N')) FROM lineitem")
def constraint_violations(spark, d):
    return dml.violations(table(spark, d, "lineitem"), {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") < 0.05, "flag": F.col("l_returnflag").isin("A", "N")})


@query(r"SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY doc_id")
def segment_lines(spark, d):
    return chunking.lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


HEADING = chunking.HEADING.replace("'", "''")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
h AS (SELECT doc_id, line_no, trim(line) AS line, regexp_matches(trim(line), '{HEADING}') AS is_heading FROM l WHERE trim(line) <> ''),
s AS (SELECT *, last_value(CASE WHEN is_heading THEN regexp_replace(line, '{HEADING}', '\\1 \\2') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h),
p AS (SELECT doc_id, line_no, is_heading, section, CASE WHEN is_heading THEN [line] ELSE string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS x FROM s)
SELECT * FROM (SELECT doc_id, line_no, is_heading, section, generate_subscripts(x, 1) - 1 AS part, unnest(x) AS segment FROM p) WHERE segment <> ''""")
def segment_sentences(spark, d):
    return chunking.segments(table(spark, d, "documents"))


@query()
def chunk_greedy(spark, d):
    return chunking.chunk(table(spark, d, "documents"))


@query("""SELECT conv_id AS doc_id, role AS section, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id, role HAVING count(*) >= 3""")
def section_aggregate(spark, d):
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("section"), F.col("turn").alias("block_no"), "text")
    return chunking.section_text(blocks, 3)


@query("""WITH RECURSIVE b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text, length(text) AS n FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) WHERE trim(text) <> ''),
f AS (SELECT conv_id, i, 0 AS c, text AS content FROM b WHERE i = 1
UNION ALL SELECT b.conv_id, b.i, CASE WHEN b.n < 3000 AND length(f.content) + b.n <= 5000 THEN f.c ELSE f.c + 1 END, CASE WHEN b.n < 3000 AND length(f.content) + b.n <= 5000 THEN f.content || chr(10) || chr(10) || b.text ELSE b.text END FROM f JOIN b ON b.conv_id = f.conv_id AND b.i = f.i + 1)
SELECT conv_id AS doc_id, c AS chunk_index, max_by(content, i) AS content, length(max_by(content, i)) AS tokens FROM f GROUP BY conv_id, c""")
def merge_small_blocks(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    blocks = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), "text", F.lit("").alias("section"), F.lit(True).alias("whole"))
    return chunking.block_chunks(blocks, 4, 3000, 1 << 30, 5000, count=len).select("doc_id", "chunk_index", "content", "tokens")


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def neighbour_titles(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return chunking.beside(rows, "conv_id", ["turn", "role", "text"], "role").select("conv_id", "turn", "before", "after")


@query(f"WITH {FILES} SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'reject') AS rejected, count(*) FILTER (status IS NULL) AS unknown, count(*) FILTER (indexed) AS indexed, count(*) FILTER (status = 'pass' AND NOT indexed) AS pass_not_indexed, CAST(sum(CASE WHEN indexed THEN n_tokens ELSE 0 END) AS BIGINT) AS tokens FROM files")
def status_summary(spark, d):
    return reports.status_summary(files(spark, d))


@query(f"WITH {FILES} SELECT folder, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'reject') AS rejected, count(*) FILTER (indexed) AS indexed, round(100.0 * count(*) FILTER (indexed) / count(*), 1)::DOUBLE AS pct FROM files GROUP BY folder")
def folder_coverage(spark, d):
    return reports.coverage(files(spark, d))


@query(f"WITH {FILES} SELECT lang, count(*) FILTER (status = 'pass') AS \"pass\", count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'reject') AS reject FROM files GROUP BY lang")
def status_pivot(spark, d):
    return reports.pivot_status(files(spark, d), "lang")


@query(f"""WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY file_id) AS nth FROM files WHERE status = 'reject')
SELECT reason, count(*) AS n, string_agg(name, ', ' ORDER BY file_id) FILTER (nth <= 3) AS samples FROM r GROUP BY reason ORDER BY n DESC, min(file_id) LIMIT 15""")
def reject_top(spark, d):
    return reports.reject_reasons(files(spark, d))


@query(f"WITH {FILES} SELECT folder, file_id, n_tokens, nth FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n_tokens DESC, file_id) AS nth FROM files) WHERE nth <= 8")
def token_top(spark, d):
    return reports.top_per_group(files(spark, d), "folder", "n_tokens", "file_id", 8).select("folder", "file_id", "n_tokens", "nth")


@query("""WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT string_split(path, '/') AS x FROM p WHERE contains(path, '/'))
SELECT folder, count(*) AS n_files FROM (SELECT array_to_string(x[1:unnest(range(1, len(x)))], '/') AS folder FROM s) GROUP BY folder""")
def folder_tree(spark, d):
    return reports.folder_tree(table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@query(f"WITH {FILES}, c AS (SELECT folder, count(*) AS total, round(100.0 * count(*) FILTER (indexed) / count(*), 1)::DOUBLE AS pct, count(*) FILTER (status = 'reject') AS rejected FROM files GROUP BY folder) SELECT 'low_coverage' AS rule, folder AS subject, pct AS value FROM c WHERE pct < 70 AND total > 20 UNION ALL SELECT 'many_rejects', 'corpus', s FROM (SELECT CAST(sum(rejected) AS DOUBLE) AS s FROM c) WHERE s > 40")
def report_recommendations(spark, d):
    return reports.recommendations(folder_coverage(spark, d))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value <= 0) AS errors, min(value) FILTER (value > 0) AS lo, max(value) FILTER (value > 0) AS hi, round(avg(value) FILTER (value > 0), 6) AS mean, round(quantile_cont(value, 0.5) FILTER (value > 0), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (value > 0), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (value > 0), 6) AS p99, round(100.0 * count(*) FILTER (value <= 0) / count(*), 2) AS error_pct, round(sum(value) FILTER (value > 0), 4) AS total, round(count(*) FILTER (value > 0) / (round(sum(value) FILTER (value > 0), 4) / 1000), 6) AS rps FROM events GROUP BY event_type")
def latency_stats(spark, d):
    return reports.latency(table(spark, d, "events"), "event_type", "value", F.col("value") > 0)


@query("""WITH b AS (SELECT conv_id AS doc_id, turn AS page, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t]+', ' ', 'g')) AS norm, text, (length(text) % 101) / 100.0 AS c FROM conversations),
r AS (SELECT doc_id, page, 'block_confidence' AS rule, 'review' AS status FROM b WHERE c < 0.6 UNION ALL SELECT doc_id, page, 'raw_differs', 'review' FROM b WHERE text <> norm UNION ALL SELECT doc_id, page, 'empty_block', 'reject' FROM b WHERE norm = '')
SELECT doc_id, rule, count(*) AS n, CASE max(CASE status WHEN 'reject' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) WHEN 2 THEN 'reject' WHEN 1 THEN 'review' ELSE 'pass' END AS worst FROM r GROUP BY doc_id, rule""")
def ocr_validation(spark, d):
    return quality.block_findings(ocr_blocks(spark, d)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), quality.worst(F.col("status")).alias("worst"))


def ocr_blocks(spark, d):
    """Conversation turns as recognised blocks, with a confidence from their length."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("block"), F.col("text").alias("text_raw"), quality.normalise_ocr(F.col("text")).alias("text_norm"), ((F.length("text") % 101) / 100.0).alias("confidence"))


@query("SELECT doc_id, page, confidence, n_blocks, CASE WHEN confidence < 0.75 THEN 'review' ELSE 'pass' END AS status FROM (SELECT conv_id AS doc_id, turn AS page, round(avg((length(text) % 101) / 100.0), 6) AS confidence, count(*) AS n_blocks FROM conversations GROUP BY ALL)")
def ocr_page_status(spark, d):
    return quality.page_status(ocr_blocks(spark, d))


@query("SELECT conv_id AS doc_id, count(*) AS pages, count(*) FILTER (length(text) % 7 = 0) AS empty_pages, CASE WHEN count(*) FILTER (length(text) % 7 = 0) = count(*) THEN 'reject' WHEN count(*) FILTER (length(text) % 7 = 0) > 0.05 * count(*) THEN 'review' ELSE 'pass' END AS quality FROM conversations GROUP BY conv_id")
def document_quality(spark, d):
    chars = F.when(F.length("text") % 7 == 0, 0).otherwise(F.length("text"))
    return quality.document_quality(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), chars.alias("chars")))


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'plano layout' WHEN 1 THEN 'manual de taller' WHEN 2 THEN 'corte 1' ELSE 'x' END AS name, substr(html, 1, 8000) AS text, page_id % 5 AS e, length(html) % 1000 AS a FROM pages),
s AS (SELECT page_id, round(CASE WHEN page_id % 4 IN (0, 2) THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(plano|detalle|corte|vista|drawing|sheet)\\b') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(text, '\\b1\\s*:\\s*\\d{1,4}\\b') THEN 0.2 ELSE 0 END + CASE WHEN e / 4.0 >= 0.5 THEN 0.35 ELSE 0 END + CASE WHEN a < 250 AND e / 4.0 >= 0.3 THEN 0.25 ELSE 0 END, 6) AS d,
round(CASE WHEN page_id % 4 = 1 THEN 0.45 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\\S+')) > 180 THEN 0.25 ELSE 0 END + CASE WHEN e / 4.0 <= 0.1 AND a > 500 THEN 0.45 WHEN e / 4.0 <= 0.25 AND a > 800 THEN 0.35 ELSE 0 END, 6) AS t FROM f)
SELECT page_id, d AS drawing_score, t AS document_score, CASE WHEN round(d - t, 6) >= 0.15 THEN 'plano' WHEN round(d - t, 6) <= -0.15 THEN 'documento' WHEN greatest(d, t) > 0 THEN 'mixto' ELSE 'desconocido' END AS kind FROM s""")
def plan_detect(spark, d):
    m = F.col("page_id") % 4
    name = F.when(m == 0, "plano layout").when(m == 1, "manual de taller").when(m == 2, "corte 1").otherwise("x")
    rows = table(spark, d, "pages").select("page_id", name.alias("name"), F.col("html").alias("text"), F.lit(4).alias("pages"), (F.col("page_id") % 5).alias("empty_pages"), (F.length("html") % 1000).alias("avg_chars"))
    return quality.drawing_scores(rows).select("page_id", "drawing_score", "document_score", "kind")


SHEET = "c AS (SELECT c_nationkey AS sheet_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 3 AS row_no, * FROM customer)"


def customer_sheets(spark, d):
    """A sheet of customers for every nation: a title, a row of groups, the header, a sub-header, then the rows; the last column stays empty."""
    from pyspark.sql import Window

    c = table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    cells = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    body = c.select(F.col("c_nationkey").alias("sheet_id"), (F.row_number().over(w) + 3).alias("row_no"), cells(F.col("c_custkey").cast("string"), " ", "c_name" and F.col("c_name"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("z"), F.col("c_custkey").cast("string"))), "").alias("cells"))
    sheets = c.select(F.col("c_nationkey").alias("sheet_id")).distinct()
    fixed = [cells("Customers", "", "", "", "", ""), cells("Key", "", "Person", "", "", ""), cells("id", "ref", "name", "segment", "name", ""), cells("a", "b", "c", "", "", "")]
    for i, row in enumerate(fixed):
        body = body.unionByName(sheets.select("sheet_id", F.lit(i).alias("row_no"), row.alias("cells")))
    return body


@query(f"""WITH {SHEET} SELECT sheet_id, row_no, 'Key > id > a: ' || c_custkey || ' | Key > ref > b: null | Person > name > c: ' || c_name || ' | Person > segment: ' || c_mktsegment || ' | Person > name: ' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE 'z' || c_custkey END || ' | Person > name_2: null' AS text_line FROM c""")
def excel_header_detect(spark, d):
    return readers.grid_records(customer_sheets(spark, d))


@query(f"WITH {SHEET} SELECT sheet_id, 2 AS header_row, count(*) AS n_rows, 'ok' AS status FROM c GROUP BY sheet_id UNION ALL SELECT 1000 + c_nationkey, 0, 0, 'template_only' FROM customer GROUP BY c_nationkey UNION ALL SELECT 2000 + c_nationkey, NULL, 0, 'no_table' FROM customer GROUP BY c_nationkey")
def sheet_status(spark, d):
    sheets = table(spark, d, "customer").select("c_nationkey").distinct()
    bare = sheets.select((F.col("c_nationkey") + 1000).alias("sheet_id"), F.lit(0).alias("row_no"), F.array(F.lit("name"), F.lit("value of it")).alias("cells"))
    none = sheets.select((F.col("c_nationkey") + 2000).alias("sheet_id"), F.lit(0).alias("row_no"), F.array(F.lit("only one"), F.lit("")).alias("cells"))
    return readers.sheet_states(customer_sheets(spark, d).unionByName(bare).unionByName(none))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def rls_semi_join(spark, d):
    tenant = table(spark, d, "region").where("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = table(spark, d, "nation").join(tenant, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = table(spark, d, "customer").join(nations, "c_nationkey", "left_semi")
    return customers.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT event_type, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type")
def json_props(spark, d):
    keys = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"))


@query(f"SELECT l_orderkey AS doc_id, nth_line AS page, CASE WHEN nth_line % 2 = 0 THEN 'ocr ' || l_returnflag ELSE 'native ' || l_linestatus END AS text, nth_line % 2 = 0 AS from_ocr FROM {LINES}")
def hybrid_pages(spark, d):
    li = order_lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("nth_line").alias("page"), "l_returnflag", "l_linestatus")
    native = li.select("doc_id", "page", F.when(F.col("page") % 2 == 0, "").otherwise(F.concat(F.lit("native "), "l_linestatus")).alias("text"))
    ocr = li.select("doc_id", "page", F.concat(F.lit("ocr "), "l_returnflag").alias("text"))
    return readers.merge_ocr_pages(native, ocr)


@query("""WITH p AS (SELECT 0 AS turn, url AS path, 'local' AS origin FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT 1, upper(url), 'remote' FROM pages WHERE page_id % 2 = 0)
SELECT origin, count(*) AS n, min(path) AS first_path FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY turn, path) AS rn FROM p) WHERE rn = 1 GROUP BY origin""")
def inventory_union(spark, d):
    p = table(spark, d, "pages")
    local = p.where("page_id % 3 > 0").select(F.col("url").alias("path"), F.lit("local").alias("origin"))
    remote = p.where("page_id % 2 = 0").select(F.upper("url").alias("path"), F.lit("remote").alias("origin"))
    return assets.union_inventories([local, remote]).groupBy("origin").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
