"""Which files are duplicates, new versions or new documents, and which version is active."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks as tables
from . import components


def in_history(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``nth`` (from 1) and ``before`` (the value of the row before) in the history of their key.

    Histories are cut into ranges of (key, order), so that one key may hold any share of the rows; a range takes over count and last value from the ranges before."""
    cut = tables.written(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", key).orderBy(*order)
    local = cut.withColumn("_nth", F.row_number().over(own)).withColumn("_before", F.lag(value).over(own))
    ends = cut.groupBy("_range", key).agg(F.count("*").alias("n"), F.max_by(F.struct(value), F.struct(*order)).alias("last"))
    several = ends.groupBy(key).agg(F.count("*").alias("ranges")).where("ranges > 1").select(F.col(key).alias("k"))
    over = Window.partitionBy("k").orderBy("r")
    carried = ends.join(several, F.col(key).eqNullSafe(F.col("k"))).select("k", F.col("_range").alias("r"), "n", "last")
    carried = carried.select("k", "r", F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("c_n"), F.lag("last").over(over).alias("c_last"))
    whole = local.join(carried, F.col(key).eqNullSafe(F.col("k")) & (F.col("_range") == F.col("r")), "left")
    before = F.when(F.col("_nth") > 1, F.col("_before")).otherwise(F.col(f"c_last.{value}"))
    return whole.withColumns({"nth": F.col("_nth") + F.coalesce("c_n", F.lit(0)), "before": before}).drop("_range", "_nth", "_before", "k", "r", "c_n", "c_last")


def decisions(files: DataFrame) -> DataFrame:
    """Set form for (file_id, arrival, logical_key, file_hash, content_hash): duplicate, new_document, same_content or new_version.

    It equals the sequential replay when no file conflicts or waits for review and skipped contents don't come again.
    """
    firsts = files.groupBy(F.col("file_hash").alias("h")).agg(F.min(F.struct("arrival", "file_id")).alias("first"))
    fresh = files.join(firsts, F.col("file_hash").eqNullSafe(F.col("h"))).withColumn("again", F.struct("arrival", "file_id") != F.col("first")).drop("h", "first")
    registered = in_history(fresh.where("NOT again"), "logical_key", ["arrival", "file_id"], "content_hash")
    kind = F.when(F.col("nth") == 1, "new_document").when(F.col("before") == F.col("content_hash"), "same_content").otherwise("new_version")
    return registered.select("file_id", "logical_key", kind.alias("decision")).unionByName(fresh.where("again").select("file_id", "logical_key", F.lit("duplicate").alias("decision")))


def with_identity(files: DataFrame) -> DataFrame:
    """``files`` (tenant, origin, kind, name, path, and where known hint, code, guide, asset, module, maker, model) with what the name
    and path tell of the blank ones, and logical_key and confidence."""
    have = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in files.columns else F.lit("")
    name, path = F.coalesce("name", F.lit("")), F.coalesce("path", F.lit(""))
    told = {"code": T.document_code, "guide": T.guide_number, "asset": T.asset_of, "module": T.module_of, "maker": T.vendor_of}
    filled = {c: F.coalesce(F.nullif(have(c), F.lit("")), f(name, path), F.lit("")) for c, f in told.items()}
    rows = files.withColumns(filled | {"hint": have("hint"), "model": have("model"), "kind": F.lower(F.coalesce("kind", F.lit("otro"))), "origin": F.lower(F.coalesce("origin", F.lit("ods1")))})
    parts = {c: F.col(c) for c in ("tenant", "origin", "kind", "name", "hint", "code", "guide", "asset", "module", "maker", "model")}
    keyed = rows.withColumn("logical_key", T.logical_key(**parts))
    return keyed.withColumn("confidence", T.identity_confidence(F.col("hint"), F.col("code"), F.col("guide"), F.col("asset"), F.col("module"), F.col("logical_key")))


def _unlike(rows: DataFrame, by: Column, unsure: bool) -> DataFrame:
    """(group, key): keys of a tenant that share a value of ``by`` with another key, and so may decide on each other."""
    groups = rows.where(by.isNotNull() & (by != "")).groupBy("tenant_key", by.alias("shared"))
    hot = groups.agg(F.min("key_id").alias("least"), F.max("key_id").alias("most"), F.max(F.col("confidence") == "low").alias("low"), F.min(F.nullif("asset", F.lit(""))).alias("a0"), F.max(F.nullif("asset", F.lit(""))).alias("a1"))
    fires = F.col("low") if unsure else F.col("low") | (F.col("a0") != F.col("a1"))
    hot = hot.where((F.col("least") < F.col("most")) & F.coalesce(fires, F.lit(False))).select("tenant_key", "shared", "least")
    pairs = rows.select("tenant_key", by.alias("shared"), "key_id").distinct().join(hot, ["tenant_key", "shared"])
    return pairs.where("key_id <> least").select(F.col("key_id").alias("u"), F.col("least").alias("v"))


def histories(files: DataFrame) -> DataFrame:
    """``files`` with ``history``: rows of two histories never decide on each other, so that each can be replayed apart.

    A history holds logical keys that are connected by a shared file hash, or by a shared code, name or title where a conflict
    could follow: other keys under it, and assets that differ or a file of low confidence.
    """
    spark = files.sparkSession
    tenant = F.coalesce(F.col("tenant").cast("string"), F.lit(""))
    keyed = files.withColumn("tenant_key", tenant).withColumn("key_id", F.conv(F.substring(F.sha2(F.concat(tenant, F.lit("\0"), F.coalesce("logical_key", F.lit(""))), 256), 1, 15), 16, 10).cast("long"))
    narrow = tables.written(keyed.select("tenant_key", "key_id", "confidence", "asset", "file_hash", "code", F.lower("name").alias("lower_name"), T.title_key(F.col("name")).alias("title")))
    same_hash = narrow.where("file_hash IS NOT NULL").groupBy("tenant_key", "file_hash").agg(F.min("key_id").alias("least"), F.max("key_id").alias("most")).where("least < most").drop("most")
    by_hash = narrow.select("tenant_key", "file_hash", "key_id").distinct().join(same_hash, ["tenant_key", "file_hash"]).where("key_id <> least").select(F.col("key_id").alias("u"), F.col("least").alias("v"))
    edges = by_hash.unionByName(_unlike(narrow, F.col("code"), False)).unionByName(_unlike(narrow, F.col("lower_name"), True)).unionByName(_unlike(narrow, F.col("title"), True))
    roots = components.roots(edges.distinct())
    return keyed.join(roots, F.col("key_id") == F.col("node"), "left").withColumn("history", F.coalesce("root", "key_id")).drop("tenant_key", "key_id", "node", "root")


class Registry:
    """What has been registered of one history, in the order of arrival. Every rule is answered without going through the records."""

    def __init__(self) -> None:
        self.hashes: set = set()
        self.latest: dict = {}
        self.codes: dict = {}
        self.titles: dict = {}
        self.names: dict = {}

    def _count(self, rec: dict, by: int) -> None:
        if rec["code"]:
            of = self.codes.setdefault(rec["code"], Counter())
            of.update({"all": by, "low": by * (rec["confidence"] == "low"), "filled": by * bool(rec["asset"]), ("asset", rec["asset"]): by})
        if rec["title"]:
            self.titles.setdefault(rec["title"], Counter())["all"] += by

    def add(self, rec: dict, hash_only: bool = False) -> None:
        if rec["file_hash"]:
            self.hashes.add(rec["file_hash"])
        if hash_only:
            return
        before = self.latest.get(rec["logical_key"])
        if before is None or rec["content_hash"] and before["content_hash"] != rec["content_hash"]:
            if before is not None:
                self._count(before, -1)
            self.latest[rec["logical_key"]] = rec
            self._count(rec, 1)
        keys = self.names.setdefault(rec["name"].lower(), [])
        if len(keys) < 2 and rec["logical_key"] not in keys:
            keys.append(rec["logical_key"])

    def conflict(self, rec: dict) -> str | None:
        """The first rule that fires: another key has the code (with another asset, or one of both is unsure), the name, or the title."""
        own, low = self.latest.get(rec["logical_key"]), rec["confidence"] == "low"
        if rec["code"]:
            of = self.codes.get(rec["code"], Counter())
            mine = own is not None and own["code"] == rec["code"]
            others = of["all"] - mine
            unsure = of["low"] - (mine and own["confidence"] == "low")
            other_asset = of["filled"] - of[("asset", rec["asset"])] - (mine and bool(own["asset"]) and own["asset"] != rec["asset"])
            if others and (low or unsure or rec["asset"] and other_asset):
                return "code"
        if low and any(k != rec["logical_key"] for k in self.names.get(rec["name"].lower(), [])):
            return "name"
        if low and rec["title"] and self.titles.get(rec["title"], Counter())["all"] - (own is not None and own["title"] == rec["title"]):
            return "title"
        return None

    def decide(self, rec: dict) -> tuple[str, str]:
        """Decision and the rule that made it; what is indexed is registered."""
        if rec["file_hash"] and rec["file_hash"] in self.hashes:
            return "duplicate", "file_hash"
        if found := self.conflict(rec):
            return "review", found
        known = self.latest.get(rec["logical_key"])
        if known is None:
            said = "new_document", "new_key"
        elif rec["content_hash"] and known["content_hash"]:
            if known["content_hash"] == rec["content_hash"]:
                return "same_content", "content_hash"
            said = "new_version", "content_hash"
        elif rec["confidence"] == "low":
            return "review", "no_content_hash"
        else:
            said = "new_version", "no_content_hash"
        self.add(rec)
        return said


REPLAYED = ("logical_key", "file_hash", "content_hash", "name", "title", "code", "asset", "confidence")
REPLAY = "tenant string, file_id long, logical_key string, decision string, rule string, indexed boolean"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (history, seen, arrival, file_id); the registry starts anew with each history."""
    at, registry = None, Registry()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["history"] != at:
                at, registry = row["history"], Registry()
            rec = {c: row[c] or "" for c in REPLAYED}
            if row["seen"] < 2:
                registry.add(rec, hash_only=row["seen"] == 0)
                continue
            decision, rule = registry.decide(rec)
            out.append({"tenant": row["tenant"], "file_id": row["file_id"], "logical_key": row["logical_key"], "decision": decision, "rule": rule, "indexed": decision in ("new_document", "new_version")})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("tenant", pa.string()), ("file_id", pa.int64()), ("logical_key", pa.string()), ("decision", pa.string()), ("rule", pa.string()), ("indexed", pa.bool_())]))


def replay(files: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Exact sequential decisions of (tenant, file_id, arrival, logical_key, file_hash, content_hash, name, code, asset, confidence).

    Order of rules: same file hash; conflict by code, name or title; unknown key; same content as the latest registered of the
    key; new version; no hash to compare and low confidence: review. Only indexed files are registered.
    ``registered`` is what a store has already (``known_versions``). Histories that can't decide on each other are replayed apart, each as a
    stream of rows in order of arrival, so memory holds the registry of one history and not its rows.
    """
    columns = ["tenant", "file_id", "arrival", *[c for c in REPLAYED if c != "title"]]
    rows = files.select(*columns).withColumn("seen", F.lit(2))
    if registered is not None:
        rows = rows.unionByName(registered.select(*columns, "seen"))
    rows = histories(rows).withColumn("title", T.title_key(F.col("name"))).withColumn("tenant", F.col("tenant").cast("string"))
    order = ["history", "seen", "arrival", "file_id"]
    return rows.repartition("history").sortWithinPartitions(*order).select("history", "seen", "tenant", "file_id", *REPLAYED).mapInArrow(_replay, REPLAY)


def known_versions(stored: DataFrame) -> DataFrame:
    """Registry rows of stored documents (tenant, doc_id, logical_key, file_hash, content_hash, name, path, status, is_current): failed ones
    and those without a key are left out; every file hash is known (seen 0), and of each key the best row (seen 1)."""
    kept = stored.where((F.coalesce("status", F.lit("")) != "failed") & (F.trim(F.coalesce("logical_key", F.lit(""))) != ""))
    kept = kept.withColumn("logical_key", F.trim("logical_key"))
    best = best_registered(kept, ["tenant", "logical_key"])
    fields = lambda df, seen: df.select("tenant", F.col("doc_id").alias("file_id"), F.col("doc_id").alias("arrival"), "logical_key", "file_hash", "content_hash", F.coalesce("name", "path").alias("name"), T.document_code(F.col("name"), F.col("path")).alias("code"), F.lit("").alias("asset"), F.lit("high").alias("confidence"), F.lit(seen).alias("seen"))
    return fields(kept, 0).unionByName(fields(best, 1))


def content_of_extraction() -> Column:
    """Hash of an extraction: of its text, else of its format, quality, source, counts and the first 50 parts' texts; null if nothing is known.

    Columns: markdown, format, quality, source_path, counts (array of name and value), parts (array of name, title, text, markdown)."""
    some = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    head = some(F.array("format", "quality", "source_path"))
    counts = F.transform(F.filter(F.coalesce("counts", F.array()), lambda c: c["value"].isNotNull()), lambda c: F.concat_ws(":", c["name"], c["value"].cast("string")))
    texts = F.flatten(F.transform(F.slice(F.coalesce("parts", F.array()), 1, 50), lambda p: F.transform(some(F.array(p["name"], p["title"], p["text"], p["markdown"])), lambda t: F.substring(t, 1, 500))))
    every = F.concat(head, counts, texts)
    return F.coalesce(T.content_hash(F.col("markdown")), F.when(F.size(every) > 0, T.content_hash(F.array_join(every, "\n"))))


def activate(versions: DataFrame) -> DataFrame:
    """Latest complete version of each catalog entry becomes active, older ones superseded, incomplete ones stay indexed.

    versions: catalog_id, doc_id, version_no, chunks, points, expected.
    """
    whole = (F.col("chunks") == F.col("points")) & (F.col("chunks") == F.col("expected"))
    newest = F.max(F.when(whole, F.col("version_no"))).over(Window.partitionBy("catalog_id"))
    status = F.when(~whole, "indexed").when(F.col("version_no") == newest, "active").when(F.col("version_no") < newest, "superseded").otherwise("indexed")
    return versions.withColumn("status", status).withColumn("is_current", F.col("status") == "active")


def best_registered(rows: DataFrame, keys: tuple | list = ("logical_key",)) -> DataFrame:
    """One row of each logical key: current first, then active, then with a hash, then the least id."""
    rank = [F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("is_current"), F.col("status") == "active", F.col("content_hash").isNotNull())]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*rank, -F.col("doc_id"))).alias("best")).select("best.*")
