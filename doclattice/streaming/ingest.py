"""Staged ingestion: files of a stream through validate, extract, chunk, identity, register, embed, index, validate_index and activate.

Each batch of the stream writes its tables to folders that bear its number; a folder counts once its ``_SUCCESS`` file stands, and then it is never
written again. A restarted batch so goes on after its last whole stage, and earlier batches are read as they were then. Every
document of a batch has a row for each stage it came to, with state ok, skipped, review or error; only ok goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, identity, retrieval
from .streams import STAGES

FILES = "doc_id long, tenant string, name string, path string, origin string, kind string, hint string, asset string, version_label string, text string"
DOCUMENTS = "doc_id long, tenant string, catalog_id string, logical_key string, name string, path string, kind string, domain string, file_hash string, content_hash string, version_label string, n_chunks long"
CHUNKED = "doc_id long, chunk_index int, content string, tokens int, section string, safety boolean"
POINTS = "doc_id long, catalog_id string, chunk_index int, point_id string, vector array<double>, content string, section string, criticality string"
VERSIONS = "doc_id long, catalog_id string, version_no long, status string, is_current boolean"
OUTCOME = "doc_id long, state string, reason string"
MOST_PAYLOAD = 4000


class Batch:
    """The tables of one batch in the store, and those of the batches before."""

    def __init__(self, spark: SparkSession, store: str, number: int):
        self.spark, self.store, self.number = spark, store.rstrip("/"), number

    def _folder(self, name: str) -> str:
        return f"{self.store}/{name}/batch={self.number}"

    def _stands(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def has(self, name: str) -> bool:
        return self._stands(f"{self._folder(name)}/_SUCCESS")

    def put(self, name: str, rows: Callable[[], DataFrame]) -> None:
        if not self.has(name):
            rows().write.mode("overwrite").parquet(self._folder(name))

    def own(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._folder(name))

    def before(self, name: str, schema: str) -> DataFrame:
        """Rows of earlier batches, with their batch."""
        if not self._stands(f"{self.store}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.store}/{name}").where(F.col("batch") < self.number)


def _outcome(state: Column, reason: Column) -> list[Column]:
    return [F.col("doc_id"), state.alias("state"), F.coalesce(reason, F.lit("")).alias("reason")]


def _missing(alive: DataFrame, found: DataFrame, why: str) -> DataFrame:
    """ok for documents that have rows in ``found``, an error for others."""
    some = found.select(F.col("doc_id").alias("found_id")).distinct()
    return alive.join(some, F.col("doc_id") == F.col("found_id"), "left").select(*_outcome(F.when(F.col("found_id").isNull(), "error").otherwise("ok"), F.when(F.col("found_id").isNull(), why)))


def validate(b: Batch, alive: DataFrame) -> DataFrame:
    """Files without text or tenant are errors; a file hash that an earlier batch has registered is skipped."""
    known = b.before("documents", DOCUMENTS).select(F.col("tenant").alias("k_tenant"), F.col("file_hash").alias("k_hash")).distinct()
    rows = alive.withColumn("file_hash", T.file_hash(F.col("text"))).join(known, (F.col("tenant") == F.col("k_tenant")) & (F.col("file_hash") == F.col("k_hash")), "left")
    why = F.when(F.col("text").isNull(), "no file").when(F.trim(F.coalesce("tenant", F.lit(""))) == "", "no tenant")
    return rows.select(*_outcome(F.when(why.isNotNull(), "error").when(F.col("k_hash").isNotNull(), "skipped").otherwise("ok"), F.coalesce(why, F.when(F.col("k_hash").isNotNull(), "duplicate"))))


SEGMENTS = "doc_id long, line_no int, is_heading boolean, section string, part int, segment string"


def extract(b: Batch, alive: DataFrame) -> DataFrame:
    b.put("segments", lambda: chunking.segments(alive.select("doc_id", "text")))
    return _missing(alive, b.own("segments", SEGMENTS), "no content")


def chunk(b: Batch, alive: DataFrame) -> DataFrame:
    kinds = alive.select("doc_id", T.index_kind(F.lower("kind")).alias("kind"))
    rows = b.own("segments", SEGMENTS).join(kinds, "doc_id")
    b.put("chunks", lambda: chunking.fold_segments(rows, F.col("kind")))
    return _missing(alive, b.own("chunks", CHUNKED), "no chunks")


def _identified(b: Batch, alive: DataFrame) -> DataFrame:
    """The files that came so far with their identity, file hash and the hash over their chunks."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "\n\n")
    hashes = b.own("chunks", CHUNKED).groupBy("doc_id").agg(T.content_hash(joined).alias("content_hash"), F.count("*").alias("n_chunks"))
    rows = identity.with_identity(alive.withColumn("file_hash", T.file_hash(F.col("text"))).drop("text"))
    return rows.join(hashes, "doc_id").withColumns({"file_id": F.col("doc_id"), "arrival": F.col("doc_id")})


DECIDED = "tenant string, file_id long, logical_key string, decision string, rule string, indexed boolean"


def decide(b: Batch, alive: DataFrame) -> DataFrame:
    stored = b.before("documents", DOCUMENTS).join(_statuses(b), "doc_id", "left")
    b.put("decisions", lambda: identity.replay(_identified(b, alive), identity.known_versions(stored)))
    made = b.own("decisions", DECIDED).withColumn("doc_id", F.col("file_id"))
    state = F.when(F.col("indexed"), "ok").when(F.col("decision") == "review", "review").otherwise("skipped")
    return made.select(*_outcome(state, F.concat_ws(" by ", "decision", "rule")))


def register(b: Batch, alive: DataFrame) -> DataFrame:
    """A document row each; a catalog entry of the tenant's logical key, whose first row stays as it is."""
    rows = _identified(b, alive).withColumns({"catalog_id": T.uuid5_url(F.concat_ws(":", "tenant", "logical_key")), "domain": T.domain(F.col("kind")), "kind": T.index_kind(F.col("kind"))})
    b.put("documents", lambda: rows.select(*[c.split(" ")[0] for c in DOCUMENTS.split(", ")]))
    entries = b.own("documents", DOCUMENTS).groupBy("catalog_id").agg(F.min_by(F.struct("tenant", "logical_key", "name", "kind", "domain"), "doc_id").alias("e")).select("catalog_id", "e.*")
    known = b.before("catalog", "catalog_id string, tenant string, logical_key string, name string, kind string, domain string")
    b.put("catalog", lambda: entries.join(known.select("catalog_id"), "catalog_id", "left_anti"))
    return alive.select(*_outcome(F.lit("ok"), F.lit("")))


def embed(b: Batch, alive: DataFrame) -> DataFrame:
    """Vectors of all chunks; a chunk without tokens has a vector of zeros."""
    chunks = b.own("chunks", CHUNKED).join(alive.select("doc_id"), "doc_id", "left_semi")
    b.put("vectors", lambda: retrieval.slot_vectors(chunks.select("doc_id", "chunk_index", F.col("content").alias("text")), ["doc_id", "chunk_index"]))
    return _missing(alive, b.own("vectors", "doc_id long, chunk_index int, vector array<double>"), "no chunks")


def index(b: Batch, alive: DataFrame) -> DataFrame:
    """Points with ids that follow from document and chunk, so that a second write is the same write."""
    docs = b.own("documents", DOCUMENTS).select("doc_id", "catalog_id")
    chunks = b.own("chunks", CHUNKED).join(docs, "doc_id").join(b.own("vectors", "doc_id long, chunk_index int, vector array<double>"), ["doc_id", "chunk_index"])
    point = T.uuid5_url(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    rows = chunks.select("doc_id", "catalog_id", "chunk_index", point.alias("point_id"), "vector", F.substring("content", 1, MOST_PAYLOAD).alias("content"), "section", F.when(F.col("safety"), "seguridad").otherwise("normal").alias("criticality"))
    b.put("points", lambda: rows)
    return alive.select(*_outcome(F.lit("ok"), F.lit("")))


def validate_index(b: Batch, alive: DataFrame) -> DataFrame:
    """As many points as chunks are stored for every document."""
    stored = b.own("points", POINTS).groupBy("doc_id").agg(F.count_distinct("point_id").alias("points"))
    rows = b.own("documents", DOCUMENTS).join(alive.select("doc_id"), "doc_id", "left_semi").join(stored, "doc_id", "left")
    whole = F.coalesce("points", F.lit(0)) == F.col("n_chunks")
    return rows.select(*_outcome(F.when(whole, "ok").otherwise("error"), F.when(~whole, F.concat(F.lit("chunks expected "), F.col("n_chunks").cast("string"), F.lit(", stored "), F.coalesce("points", F.lit(0)).cast("string")))))


def _statuses(b: Batch) -> DataFrame:
    """doc_id, status, is_current as the batches before left them."""
    past = b.before("versions", VERSIONS)
    last = past.groupBy("doc_id").agg(F.max_by(F.struct("catalog_id", "version_no", "status", "is_current"), "batch").alias("v"))
    return last.select("doc_id", "v.status", "v.is_current")


def activate(b: Batch, alive: DataFrame) -> DataFrame:
    """The newest document of each catalog entry becomes active, the one that was is superseded; only entries of this batch are written."""
    new = b.own("documents", DOCUMENTS).join(alive.select("doc_id"), "doc_id", "left_semi").select("doc_id", "catalog_id", F.col("doc_id").alias("version_no"))
    touched = new.select("catalog_id").distinct()
    past = b.before("versions", VERSIONS).groupBy("doc_id").agg(F.max_by(F.struct("catalog_id", "version_no"), "batch").alias("v")).select("doc_id", "v.*").join(touched, "catalog_id", "left_semi")
    one = F.lit(1)
    every = past.select(*new.columns).unionByName(new).withColumns({"chunks": one, "points": one, "expected": one})
    b.put("versions", lambda: identity.activate(every).select(*[c.split(" ")[0] for c in VERSIONS.split(", ")]))
    return alive.select(*_outcome(F.lit("ok"), F.lit("active")))


STEPS: dict[str, Callable[[Batch, DataFrame], DataFrame]] = dict(zip(STAGES, (validate, extract, chunk, decide, register, embed, index, validate_index, activate), strict=True))


def ingest(files: DataFrame, number: int, store: str, after: Callable[[int, str], None] = lambda number, stage: None) -> None:
    """One batch of files (``FILES``) through all stages. ``after`` is called when a stage has been committed."""
    b = Batch(files.sparkSession, store, number)
    b.put("files", lambda: files.dropDuplicates(["doc_id"]))
    every = alive = b.own("files", FILES)
    for name, step in STEPS.items():
        b.put(f"runs/stage={name}", lambda step=step, alive=alive: step(b, alive))
        after(number, name)
        passed = b.own(f"runs/stage={name}", OUTCOME).where("state = 'ok'").select("doc_id")
        alive = every.join(passed, "doc_id", "left_semi")  # a stage has outcomes only for those that passed the stages before


def stages_of(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, stage, state, reason): the last stage that every document came to. A batch that was never begun has no rows."""
    runs = spark.read.schema(f"{OUTCOME}, stage string, batch int").parquet(f"{store}/runs")
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    last = runs.groupBy("doc_id").agg(F.max_by(F.struct("stage", "state", "reason"), F.struct("batch", place)).alias("r"))
    return last.select("doc_id", "r.*")


def versions_of(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, catalog_id, status, is_current) of all registered documents."""
    rows = spark.read.schema(f"{VERSIONS}, batch int").parquet(f"{store}/versions")
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("catalog_id", "status", "is_current"), "batch").alias("v")).select("doc_id", "v.*")
