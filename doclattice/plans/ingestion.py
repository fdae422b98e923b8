"""Registered queries of staged ingestion, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import sinks
from ..streaming import ingest
from .corpus import _re2, _sql_part, query, table


#: Columns of files made of documents, in SQL that both engines read.
FILES = {
    "doc_id": "doc_id",
    "tenant": "CASE WHEN doc_id % 97 <> 5 THEN source END",
    "name": "CASE WHEN doc_id % 5 = 0 THEN 'NCC-' || (doc_id % 3) || ' ' ELSE 'Informe ' END || lang || ' ' || (doc_id % 2) || ' Rev ' || (doc_id % 3) || '.pdf'",
    "path": "''",
    "origin": "'local'",
    "kind": "CASE WHEN doc_id % 2 = 0 THEN 'guia' ELSE 'sop' END",
    "hint": "CASE WHEN doc_id % 7 = 0 THEN 'hint ' || (doc_id % 4) END",
    "asset": "CASE WHEN doc_id % 4 = 1 THEN 'FT-' || (100 + doc_id % 3) END",
    "version_label": "'Rev ' || (doc_id % 3)",
    "text": "CASE WHEN doc_id % 89 <> 3 THEN text END",
}


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(*[F.expr(x).alias(c) for c, x in FILES.items()])


_HEADING = chunking.HEADING.replace("'", "''")
_REC = "struct_pack(key := o.logical_key, h := o.file_hash, content := o.content_hash, name := lower(o.name), title := o.title, code := o.code, asset := o.asset, low := o.low, latest := true)"
INGESTED = f"""f AS (SELECT {', '.join(f'{x} AS {c}' for c, x in FILES.items() if c not in ('asset', 'hint'))}, coalesce({FILES['asset']}, '') AS own, coalesce({FILES['hint']}, '') AS hint FROM documents),
a AS (SELECT *, CASE WHEN text IS NULL THEN 'no file' WHEN trim(coalesce(tenant, '')) = '' THEN 'no tenant' END AS bad, sha256(coalesce(text, '')) AS file_hash, upper(regexp_extract(name, '{T.NAME_CODE}', 1)) AS code,
    list_filter(list_transform(regexp_extract_all(upper(name), '{T.NAME_ASSET}'), lambda t: translate(t, ' _', '--')), lambda t: length(t) >= 4 AND NOT starts_with(t, 'REV')) AS tags,
    {_sql_part(f"regexp_replace(regexp_replace(regexp_replace(name, '^(.+)[.][^.]+$', '\\1'), '{_re2(T.NAME_REVISION)}', ' ', 'g'), '{_re2(T.NAME_DATE)}', ' ', 'g')")} AS title FROM f),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM a WHERE bad IS NULL),
w AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(trim(line), '{_HEADING}') THEN trim(line) ELSE regexp_replace(trim(line), '([.!?])\\s+', '\\1 ', 'g') END, ' ' ORDER BY line_no) AS content FROM l WHERE trim(line) <> '' GROUP BY doc_id),
p AS (SELECT a.*, w.content IS NULL AS no_content, sha256({"trim(regexp_replace(lower(content), '[ \t\n\v\f\r]+', ' ', 'g'))"}) AS content_hash, coalesce(nullif(own, ''), list_filter(tags, lambda t: length(t) = list_max(list_transform(tags, lambda u: length(u))))[1], '') AS asset FROM a LEFT JOIN w USING (doc_id)),
k AS (SELECT *, CASE WHEN hint <> '' THEN hint WHEN code <> '' THEN array_to_string(list_filter([{_sql_part('tenant')}, 'local', {_sql_part('code')}, {_sql_part('asset')}, kind], lambda y: y <> ''), '|') ELSE array_to_string(list_filter([{_sql_part('tenant')}, title, {_sql_part('asset')}], lambda y: y <> ''), '|') END AS logical_key FROM p),
o AS (SELECT *, NOT (hint <> '' OR code <> '' OR length(logical_key) - length(replace(logical_key, '|', '')) >= 3) AS low, row_number() OVER (PARTITION BY tenant ORDER BY doc_id) AS i FROM k WHERE bad IS NULL AND NOT no_content),
r AS (SELECT tenant, 0::BIGINT AS i, [{_REC}][1:0] AS reg, 0::BIGINT AS doc_id, '' AS logical_key, '' AS decision, '' AS rule FROM o WHERE i = 1
UNION ALL SELECT tenant, i, CASE WHEN decision NOT IN ('new_document', 'new_version') THEN reg WHEN known IS NULL OR known.content <> content_hash THEN list_append(list_transform(reg, lambda x: struct_pack(key := x.key, h := x.h, content := x.content, name := x.name, title := x.title, code := x.code, asset := x.asset, low := x.low, latest := x.latest AND x.key <> logical_key)), rec) ELSE list_append(reg, rec) END, doc_id, logical_key, decision, rule
  FROM (SELECT *, CASE WHEN rule = 'file_hash' THEN 'duplicate' WHEN rule IN ('code', 'name', 'title') THEN 'review' WHEN rule = 'new_key' THEN 'new_document' WHEN known.content = content_hash THEN 'same_content' ELSE 'new_version' END AS decision
    FROM (SELECT *, CASE WHEN list_contains(list_transform(reg, lambda x: x.h), file_hash) THEN 'file_hash'
        WHEN code <> '' AND len(list_filter(reg, lambda x: x.latest AND x.key <> logical_key AND x.code = code AND ((asset <> '' AND x.asset <> '' AND x.asset <> asset) OR low OR x.low))) > 0 THEN 'code'
        WHEN low AND len(list_filter(reg, lambda x: x.key <> logical_key AND x.name = lower(name))) > 0 THEN 'name' WHEN low AND title <> '' AND len(list_filter(reg, lambda x: x.latest AND x.key <> logical_key AND x.title = title)) > 0 THEN 'title'
        WHEN known IS NULL THEN 'new_key' ELSE 'content_hash' END AS rule
      FROM (SELECT o.*, r.reg, {_REC} AS rec, list_filter(r.reg, lambda x: x.latest AND x.key = o.logical_key)[1] AS known FROM r JOIN o ON o.tenant = r.tenant AND o.i = r.i + 1)))),
seen AS (SELECT a.doc_id, CASE WHEN bad IS NOT NULL THEN 'validate' WHEN no_content THEN 'extract' WHEN decision IN ('new_document', 'new_version') THEN 'activate' ELSE 'identity' END AS stage, CASE WHEN bad IS NOT NULL OR no_content THEN 'error' WHEN decision = 'review' THEN 'review' WHEN decision IN ('duplicate', 'same_content') THEN 'skipped' ELSE 'ok' END AS state,
    CASE WHEN bad IS NOT NULL THEN bad WHEN no_content THEN 'no content' WHEN decision IN ('new_document', 'new_version') THEN 'active' ELSE decision || ' by ' || rule END AS reason, CASE WHEN decision IN ('new_document', 'new_version') THEN a.tenant || chr(58) || r.logical_key END AS entry FROM p AS a LEFT JOIN r ON r.doc_id = a.doc_id AND r.i > 0)"""


@query(f"WITH RECURSIVE {INGESTED} SELECT doc_id, stage, state, reason, CASE WHEN entry IS NOT NULL THEN CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY entry) THEN 'active' ELSE 'superseded' END END AS status FROM seen")
def stage_pipeline(spark, d):
    """All documents as one arrival of files, through all nine stages."""
    store = sinks.shared_folder(spark)
    ingest.ingest(files(spark, d), 0, store)
    return ingest.stages_of(spark, store).join(ingest.versions_of(spark, store).select("doc_id", "status"), "doc_id", "left")
