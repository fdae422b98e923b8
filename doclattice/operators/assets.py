"""Manifest, extraction cache, index results and the asset catalogue: joins by path, name, slug and hash, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages whose files may be indexed, and those that need an extraction first; terminal states of a run.
INDEXABLE = ("native_pdf", "structured_docx", "structured_pptx", "structured_excel", "ocr")
NEEDS_EXTRACT = ("structured_docx", "structured_pptx", "structured_excel", "ocr")
TERMINAL = ("ok", "duplicate", "same_content", "skipped")


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\")))


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rn_ = 1").drop("rn_")


def later_wins(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Union of two tables of results; of a key the newer table's row stays, and of equal ones the greatest ``seq``."""
    both = older.withColumn("turn_", F.lit(0)).unionByName(newer.withColumn("turn_", F.lit(1)))
    return first_of(both, [key], [F.desc("turn_"), F.desc("seq")]).drop("turn_")


def with_extract(manifest: DataFrame, extracts: DataFrame) -> DataFrame:
    """Manifest (path, slug, ...) with its extraction (path, slug, quality, quality_override): by path, else by slug."""
    values = [c for c in extracts.columns if c not in ("path", "slug")]
    one = lambda key: first_of(extracts.where(F.col(key).isNotNull()), [key], [F.desc("path")])
    a = one("path").select(path_key(F.col("path")).alias("k_"), F.struct(*values).alias("a_"))
    b = one("slug").select(F.col("slug").alias("s_"), F.struct(*values).alias("b_"))
    rows = manifest.join(a, path_key(F.col("path")) == F.col("k_"), "left").join(b, F.col("slug") == F.col("s_"), "left")
    x = F.coalesce("a_", "b_")
    return rows.select(*[F.col(c) for c in manifest.columns], *[x[c].alias(c) for c in values], x.isNotNull().alias("has_extract"))


def indexable(rows: DataFrame, included_only: bool = True) -> DataFrame:
    """Files (with_extract) that may be indexed: included, of an indexable stage, with a passing quality (an override counts first) where there is an
    extraction, and with one where the stage needs it."""
    kept = rows.where(F.coalesce("included", F.lit(True))) if included_only else rows
    quality = F.coalesce(F.nullif("quality_override", F.lit("")), "quality")
    return kept.where(F.col("stage").isin(*INDEXABLE) & F.when(F.col("has_extract"), quality == "pass").otherwise(~F.col("stage").isin(*NEEDS_EXTRACT)))


def pending(files: DataFrame, results: DataFrame, errors_only: bool = False) -> DataFrame:
    """Files (name) still to do after the results (name, state); or only those that failed."""
    if errors_only:
        return files.join(results.where("state = 'error'"), "name", "left_semi")
    return files.join(results.where(F.col("state").isin(*TERMINAL)), "name", "left_anti")


def triage(files: DataFrame, exclude: list[str], include: list[str]) -> DataFrame:
    """Files (path) with decision include, exclude or review, from words of their path; an include word wins."""
    has = lambda words: F.exists(F.array(*[F.lit(w.upper()) for w in words]), lambda w: F.contains(F.upper("path"), w))
    return files.withColumn("decision", F.when(has(include), "include").when(has(exclude), "exclude").otherwise("review"))


def triage_rows(triaged: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows that triage rows name by path, or by name and relative path; each once, a path match first."""
    by_path = triaged.where("path IS NOT NULL").join(manifest.withColumnRenamed("path", "m_path"), F.col("path") == F.col("m_path")).select("file_id", "decision", F.lit(0).alias("way"))
    t = triaged.select(F.col("name").alias("t_name"), F.col("relative_path").alias("t_rel"), "decision")
    by_name = t.join(manifest, (F.col("t_name") == F.col("name")) & (F.col("t_rel") == F.col("relative_path"))).select("file_id", "decision", F.lit(1).alias("way"))
    return first_of(by_path.unionByName(by_name), ["file_id"], [F.asc("way"), F.asc("decision")]).select("file_id", "decision")


def hash_matches(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Manifest files (file_id, file_hash) with the first document (document_id, created) of their hash."""
    first = first_of(documents, ["file_hash"], [F.asc("created"), F.asc("document_id")]).select("file_hash", "document_id")
    return manifest.join(first, "file_hash").select("file_id", "document_id")


def tag_states(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest (file_id, module, asset_tag) with state ok, unknown or sin_tag against the catalogue (tag, current)."""
    known = catalog.where(F.coalesce("current", F.lit(True))).select(F.upper(F.trim("tag")).alias("tag_")).distinct()
    rows = manifest.withColumn("tag", F.upper(F.trim(F.coalesce("asset_tag", F.lit(""))))).join(known, F.col("tag") == F.col("tag_"), "left")
    return rows.select("file_id", "module", "tag", F.when(F.col("tag") == "", "sin_tag").when(F.col("tag_").isNotNull(), "ok").otherwise("unknown").alias("state"))


def tag_coverage(states: DataFrame) -> DataFrame:
    """Per module: files, valid, unknown and empty tags, the distinct tags, and the share of valid ones."""
    g = states.groupBy("module").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "ok").alias("valid"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state") == "sin_tag").alias("empty"), F.count_distinct(F.nullif("tag", F.lit(""))).alias("n_tags"))
    return g.withColumn("coverage", F.round(F.col("valid") / F.col("total"), 4))


def seed_catalog(manifest: DataFrame) -> DataFrame:
    """Distinct non-blank tags, trimmed and upper-cased, as catalogue rows."""
    tag = F.upper(F.trim("asset_tag"))
    return manifest.select(tag.alias("tag")).where("coalesce(tag, '') <> ''").distinct().withColumn("current", F.lit(True))


def upsert_assets(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Catalogue with changes (tenant, tag, name, seq) merged: tags upper-cased, the latest change of a key overwrites."""
    both = catalog.withColumn("seq", F.lit(-1)).unionByName(changes).withColumn("tag", F.upper(F.trim("tag")))
    return first_of(both, ["tenant", "tag"], [F.desc("seq")]).drop("seq")


def fill_blanks(manifest: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Manifest with blank columns filled from derived values, and whether a row changed."""
    d = derived.select(key, *[F.col(c).alias(f"d_{c}") for c in columns])
    rows, blank = manifest.join(d, key, "left"), lambda c: F.nullif(F.trim(c), F.lit(""))
    changed = F.lit(False)
    for c in columns:
        changed = changed | (blank(c).isNull() & blank(f"d_{c}").isNotNull())
    filled = {c: F.coalesce(blank(c), blank(f"d_{c}")) for c in columns}
    return rows.withColumn("changed", changed).withColumns(filled).drop(*[f"d_{c}" for c in columns])


def curated(specs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of exactly the specified names (spec_id, name), and the specs without one."""
    return specs.join(first_of(files, ["name"], [F.asc("path")]), "name"), specs.join(files, "name", "left_anti")


def extension_report(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files per extension with the registry's status (extension, status), else unsupported."""
    n = files.groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(registry), "extension", "left").select("extension", "n", F.coalesce("status", F.lit("unsupported")).alias("status"))


def file_states(manifest: DataFrame, extracts: DataFrame, results: DataFrame) -> DataFrame:
    """State of every manifest file from extraction and index result (name, state): excluded, indexed, error, rejected, ready, pending."""
    rows = with_extract(manifest, extracts).join(first_of(results, ["name"], [F.desc("seq")]).select("name", F.col("state").alias("result")), "name", "left")
    quality = F.coalesce(F.nullif("quality_override", F.lit("")), "quality")
    state = F.when(~F.coalesce("included", F.lit(True)), "excluded").when(F.col("result") == "ok", "indexed").when(F.col("result") == "error", "error").when(quality == "reject", "rejected").when(quality == "pass", "ready").otherwise("pending")
    return rows.select("file_id", "name", state.alias("state"))


def reconcile(summary: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index summary with rows of the same name replaced by fresh ones."""
    return summary.join(fresh, "name", "left_anti").unionByName(fresh)


def failed_with_manifest(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Failed documents (document_id, path, status) with their manifest row by path."""
    m = manifest.select(path_key(F.col("path")).alias("k_"), "file_id").dropDuplicates(["k_"])
    return documents.where("status = 'failed'").join(m, path_key(F.col("path")) == F.col("k_"), "left").select("document_id", "file_id")


def union_inventories(inventories: list[DataFrame]) -> DataFrame:
    """Rows (path, origin) of several inventories; of paths that differ in case only the first inventory's stays; local ones first, then by path."""
    every = None
    for i, one in enumerate(inventories):
        one = one.select("path", "origin", F.lit(i).alias("turn_"))
        every = one if every is None else every.unionByName(one)
    rows = every.groupBy(F.lower("path").alias("k_")).agg(F.min_by(F.struct("path", "origin"), F.struct("turn_", "path")).alias("x"))
    return rows.select("x.*", F.when(F.col("x.origin") == "local", 0).otherwise(1).alias("origin_order"))


def missing_metadata(tenant: Column, key: Column, kind: Column) -> Column:
    """The first of tenant, document key and document type that an ingestion lacks; null if all are there."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(tenant), "tenant is missing").when(blank(key), "document key is missing").when(blank(kind), "document type is missing")
