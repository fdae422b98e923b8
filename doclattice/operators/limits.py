"""Limits documented in texts, the facts they make of sensor readings, and the diagnosis of an asset."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .motor import aggregate_confidence, confidence_label, exceeded, fact_confidence

# Kinds of limits with their patterns and units, and the form of a tag.
NUMBER = r"(\d+(?:[.,]\d+)?)"
LIMITS = {
    "max_temp": (rf"(?:m[aá]x(?:ima)?|l[ií]mite|alarma|max(?:imum)?\s*temp(?:eratura)?)[^.\n]{{0,40}}?{NUMBER}\s*°?\s*C\b", "°C"),
    "max_vibration": (rf"(?:m[aá]x(?:ima)?|l[ií]mite|alarma|vibraci[oó]n)[^.\n]{{0,40}}?{NUMBER}\s*mm\s*/\s*s\b", "mm/s"),
    "nominal_flow": (rf"(?:nominal|caudal\s*(?:de\s*)?dise[nñ]o|setpoint)[^.\n]{{0,40}}?{NUMBER}\s*L\s*/\s*min\b", "L/min"),
    "min_flow": (rf"(?:m[ií]n(?:ima)?|l[ií]mite\s*bajo|alarma\s*baja)[^.\n]{{0,40}}?{NUMBER}\s*L\s*/\s*min\b", "L/min"),
    "generic_limit": (rf"(?:l[ií]mite|alarma|umbral)[^.\n]{{0,30}}?{NUMBER}\s*(°C|mm/s|L/min|bar|kPa)\b", None),
}
TAG = re.compile(r"\b([A-Z]{1,3}-\d{2,4}[A-Z]?)\b")
NEAR, BEFORE, AFTER = 80, 20, 40
_PATTERNS = [(kind, re.compile(pattern, re.IGNORECASE), unit) for kind, (pattern, unit) in LIMITS.items()]
FOUND = "array<struct<nth:int,kind:string,value:double,unit:string,near_tag:string,context:string>>"


def limits_in(text: str | None) -> list[tuple]:
    """(nth, kind, value, unit, nearest tag within 80 characters, context) of every limit, equal ones once."""
    out: dict[tuple, tuple] = {}
    for kind, pattern, unit in _PATTERNS:
        for m in pattern.finditer(text or ""):
            value, measured = float(m.group(1).replace(",", ".")), unit or m.group(2).replace(" ", "")
            tag = TAG.search(text[max(0, m.start() - NEAR) : m.end() + NEAR])
            context = text[max(0, m.start() - BEFORE) : m.end() + AFTER].strip()
            out.setdefault((kind, value, measured), (len(out), kind, value, measured, tag and tag.group(1), context))
    return list(out.values())


def extract_limits(hits: DataFrame, keep: list[str]) -> DataFrame:
    """Limits of every hit's ``text``: ``keep`` columns, nth, kind, limit_value, limit_unit, near_tag, context. Texts without a digit aren't scanned."""


    def limits(texts: pd.Series) -> pd.Series:
        return texts.map(limits_in)

    rows = hits.where(F.col("text").rlike(r"\d")).select(*keep, F.explode(F.pandas_udf(limits, FOUND)("text")).alias("x"))
    return rows.select(*keep, "x.nth", "x.kind", F.col("x.value").alias("limit_value"), F.col("x.unit").alias("limit_unit"), "x.near_tag", "x.context")


#: Characters of a text whose parts are looked at together, and of a tag by which a part is taken at all.
BLOCK, HEAD = 256, 3


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def tags_in_texts(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """(case_id, key, tag): the tags (case_id, tag) that stand in the texts (case_id, text) of their case, as any part of them; ``key`` is the text's ``_key``.

    Of every text the parts that are as long as some tag and begin as it does are joined with the tags, so that no text is held against all tags of its case."""
    tags = written(tags.where("case_id IS NOT NULL AND tag IS NOT NULL").select("case_id", "tag").distinct())
    sizes = F.length("tag").alias("n")
    heads = written(tags.select(F.substring("tag", 1, HEAD).alias("head"), sizes).distinct())
    longest, own = heads.agg(F.max("n"), F.collect_set(F.length("head"))).first()
    if longest is None:
        return texts.select("case_id", _key(F.col("text")).alias("key"), F.col("text").alias("tag")).where(F.lit(False))
    rows = texts.where("case_id IS NOT NULL AND text IS NOT NULL").select("case_id", "text").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(BLOCK))
    blocks = rows.select("case_id", _key(F.col("text")).alias("key"), F.explode(F.transform(starts, lambda i: F.substr("text", i, F.lit(BLOCK + longest)))).alias("block"))
    places = F.sequence(F.lit(1), F.least(F.greatest(F.length("block"), F.lit(1)), F.lit(BLOCK)))
    # a tag shorter than HEAD is its own head
    begin = lambda k: F.transform(places, lambda i: F.struct(i.alias("at"), F.substr("block", i, F.lit(k)).alias("head")))
    begins = F.flatten(F.array(*[begin(k) for k in sorted(own)]))
    met = blocks.select("case_id", "key", "block", F.explode(begins).alias("b")).select("case_id", "key", "block", "b.*").join(heads, "head")
    parts = met.select("case_id", "key", F.substr("block", F.col("at"), F.col("n")).alias("tag")).distinct()
    return parts.join(tags, ["case_id", "tag"], "left_semi").select("case_id", "key", "tag")


def limits_of_hits(hits: DataFrame, tags: DataFrame) -> DataFrame:
    """Limits of hits (case_id, hit_id, text) for the reading tags (case_id, tag): tags that a hit names own its limits; else the nearest tag does."""
    named = tags_in_texts(hits.select("case_id", F.upper("text").alias("text")), tags.select("case_id", F.upper("tag").alias("tag")))
    found = extract_limits(hits.withColumn("key", _key(F.upper("text"))), ["case_id", "hit_id", "key"])
    rows = found.join(named, ["case_id", "key"], "left")
    return rows.withColumn("limit_tag", F.coalesce("tag", "near_tag")).drop("tag", "key", "near_tag")


def _bare(unit: Column) -> Column:
    return F.lower(F.replace(F.coalesce(unit, F.lit("")), F.lit(" "), F.lit("")))


def _parts(unit: Column) -> Column:
    """All parts of a unit's name, the empty one too."""
    n = F.length(unit)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(0), F.greatest(n - a + 1, F.lit(0))), lambda k: F.substr(unit, a, k)))))


def unit_score(unit: Column, limit_unit: Column, kind: Column) -> Column:
    """+2 where the reading's unit is part of the limit's, +1 where the kind suits the unit."""
    within = F.when((unit != "") & (limit_unit != "") & F.contains(F.lower(limit_unit), F.lower(unit)), 2).otherwise(0)
    bare = _bare(unit)
    suits = F.when(F.contains(unit, F.lit("°")) & (kind == "max_temp"), 1).when(F.contains(bare, F.lit("l/min")) & kind.isin("nominal_flow", "min_flow"), 1).when(F.contains(bare, F.lit("mm")) & (kind == "max_vibration"), 1).otherwise(0)
    return within + suits


def match_limits(readings: DataFrame, limits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best limit of each reading: equal tag +3, unit +2, kind that suits +1; another tag, or a unit that neither holds nor lies in the reading's,
    excludes; the first limit on ties. ``by`` names columns that both sides share.

    readings: reading_id, tag, unit, value, nominal; limits: limit_id, kind, limit_value, limit_unit, limit_tag. What a limit scores depends on tag and unit of the
    reading alone, and of limits with one tag, unit and kind the first is the best. So the best is found for each tag and unit: tagged limits join by tag, others by
    parts of the units' names, and a reading meets one row.
    """
    by = list(by)
    unit, tag = F.coalesce("unit", F.lit("")), F.upper(F.coalesce("tag", F.lit("")))
    clean = limits.select(*by, "limit_id", "kind", "limit_value", F.coalesce("limit_unit", F.lit("")).alias("limit_unit"), F.nullif(F.upper(F.coalesce("limit_tag", F.lit(""))), F.lit("")).alias("limit_tag"))
    firsts = written(clean.groupBy(*by, "limit_tag", "limit_unit", "kind").agg(F.min(F.struct("limit_id", "limit_value")).alias("x")).select(*by, "limit_tag", "limit_unit", "kind", "x.*"))
    asked = written(readings.select(*by, tag.alias("tag_"), unit.alias("unit_")).distinct())
    a, b = _bare(F.col("unit_")), _bare(F.col("limit_unit"))
    tagged = asked.join(firsts, [F.col("tag_") == F.col("limit_tag"), *[asked[c] == firsts[c] for c in by]]).where(F.contains(a, b) | F.contains(b, a))
    tagged = tagged.select(*[asked[c] for c in by], "tag_", "unit_", "limit_id", "kind", "limit_value", "limit_unit", (unit_score(F.col("unit_"), F.col("limit_unit"), F.col("kind")) + 3).alias("score"))
    general = firsts.where("limit_tag IS NULL").drop("limit_tag").withColumn("m", b)
    units = asked.select(*by, "unit_").distinct().withColumn("r", a)
    wanted = [*by, "unit_", "limit_id", "kind", "limit_value", "limit_unit"]
    pairs = units.select(*by, "unit_", F.explode(_parts(F.col("r"))).alias("m")).join(general, [*by, "m"]).select(*wanted)
    pairs = pairs.union(general.withColumn("r", F.explode(_parts(F.col("m")))).join(units, [*by, "r"]).select(*wanted))
    row = F.struct((-F.col("score")).alias("worse"), "limit_id", "kind", "limit_value", "limit_unit", "score")
    best_of = lambda df, keys: df.groupBy(*keys).agg(F.min(row).alias("x")).select(*keys, "x.*").drop("worse")
    pairs = best_of(pairs.withColumn("score", unit_score(F.col("unit_"), F.col("limit_unit"), F.col("kind"))), [*by, "unit_"])
    every = tagged.unionByName(asked.join(pairs, [*by, "unit_"]).select(*tagged.columns))
    found = written(best_of(every, [*by, "tag_", "unit_"]).withColumnRenamed("score", "match_score"))  # its size is known, so that readings need no shuffle while it is small
    return readings.withColumns({"tag_": tag, "unit_": unit}).join(found, [*by, "tag_", "unit_"], "left").select(*readings.columns, "limit_id", "kind", "limit_value", "limit_unit", "match_score")


def plain(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


LIMIT_KINDS = {"max_temp": "max", "max_vibration": "max", "min_flow": "min", "nominal_flow": "nominal", "generic_limit": "max"}


def measurement_facts(matched: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts of matched readings (case_id, reading_id, tag, description, unit, value, nominal, limit_id, kind, limit_value, limit_unit), with
    sources (limit_id, citation_index, citation, document_id): text, limit, source and confidence."""
    rows = matched.join(sources, "limit_id", "left")
    over = exceeded(F.col("kind"), F.col("value"), F.col("limit_value"), F.col("nominal"))
    rows = rows.withColumn("exceeded", over)
    short = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in LIMIT_KINDS.items()])
    label = F.when(short == "max", "límite").otherwise(F.replace("kind", F.lit("_"), F.lit(" ")))
    text = F.concat("description", F.lit(" "), "tag", F.lit(": "), plain(F.col("value")), F.lit(" "), "unit")
    text = F.concat(text, F.when(F.col("nominal").isNotNull(), F.concat(F.lit(" (nominal "), plain(F.col("nominal")), F.lit(" "), "unit", F.lit(")"))).when(F.col("limit_id").isNotNull(), F.concat(F.lit(" ("), label, F.lit(" documentado "), plain(F.col("limit_value")), F.lit(" "), "limit_unit", F.lit(")"))).otherwise(""))
    text = F.concat(text, F.when(F.col("exceeded"), " — FUERA DE LÍMITE").when(~F.col("exceeded"), " — dentro de límite").otherwise(""))
    limit = F.when(F.col("limit_id").isNotNull(), F.struct(F.col("limit_value").alias("value"), F.col("limit_unit").alias("unit"), short.alias("kind"))).when(F.col("nominal").isNotNull(), F.struct(F.col("nominal").alias("value"), F.col("unit").alias("unit"), F.lit("nominal").alias("kind")))
    document = F.col("citation_index").isNotNull()
    source = F.struct(F.when(document, "document").otherwise("sensor").alias("type"), F.when(document, F.coalesce(F.nullif("citation", F.lit("")), F.concat(F.lit("Evidencia "), F.col("citation_index").cast("string")))).otherwise(F.concat(F.lit("PI/SCADA · "), "tag")).alias("citation"), F.when(document, F.col("document_id")).alias("document_id"))
    pct = fact_confidence(document & F.col("limit_id").isNotNull(), F.col("exceeded").isNotNull(), F.col("nominal").isNotNull())
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("reading_id"))
    return rows.select("case_id", "reading_id", "tag", text.alias("text"), F.coalesce("citation_index", nth).alias("citation_index"), limit.alias("limit"), "exceeded", source.alias("source"), pct.alias("confidence"), confidence_label(pct).alias("level"))


def merge_facts(structured: DataFrame, told: DataFrame) -> DataFrame:
    """Measured facts, and told ones (case_id, text) whose text names none of the measured tags of the case."""
    text = F.upper("text")
    named = tags_in_texts(told.select("case_id", text.alias("text")), structured.select("case_id", F.upper("tag").alias("tag")).where("tag <> ''")).select("case_id", "key").distinct()
    fresh = told.withColumn("key", _key(text)).join(named, ["case_id", "key"], "left_anti")
    return structured.select("case_id", "text", F.lit("measurement").alias("kind")).unionByName(fresh.select("case_id", "text", F.lit("told").alias("kind")))


def resolve_assets(asked: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """asset_id, name, criticality, origin of every asked tag: from the catalogue, else from known assets, else a stub; trimmed upper-cased tags join."""
    key = lambda df, c: df.withColumn("k", F.upper(F.trim(c)))
    a = key(catalog, "tag").select("k", F.col("name").alias("c_name"), F.col("criticality").alias("c_crit")).dropDuplicates(["k"])
    b = key(known, "tag").select("k", F.col("name").alias("f_name"), F.col("criticality").alias("f_crit")).dropDuplicates(["k"])
    rows = key(asked, "tag").join(a, "k", "left").join(b, "k", "left")
    origin = F.when(F.col("c_name").isNotNull(), "catalog").when(F.col("f_name").isNotNull(), "fixture").otherwise("stub")
    return rows.select(F.col("k").alias("asset_id"), F.coalesce("c_name", "f_name", "k").alias("name"), F.coalesce("c_crit", "f_crit").alias("criticality"), origin.alias("origin"))


def hypothesis_facts(hypotheses: DataFrame, facts: DataFrame) -> DataFrame:
    """Texts of the facts that hypotheses (case_id, code, fact_indices from 1) cite, in order; indices out of range and repeats are dropped."""
    numbered = facts.withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy("reading_id")))
    cited = hypotheses.select("case_id", "code", F.posexplode(F.array_distinct("fact_indices")).alias("pos", "nth"))
    return cited.join(numbered.select("case_id", "nth", "text"), ["case_id", "nth"]).groupBy("case_id", "code").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x")).select("case_id", "code", F.transform("x", lambda e: e["text"]).alias("facts"))


def document_conflicts(conflicts: DataFrame, fact_tags: DataFrame, hits: DataFrame) -> DataFrame:
    """Conflicts (asset_id, tag, doc_a, doc_b, severity) whose tag is blank, measured (asset_id, tag) or named by a hit (asset_id, content)."""
    rows = conflicts.withColumns({"tag": F.upper(F.coalesce("tag", F.lit(""))), "cid": F.xxhash64("asset_id", "tag", "doc_a", "doc_b")})
    blank = rows.where("tag = ''")
    measured = rows.where("tag <> ''").join(fact_tags.select("asset_id", F.upper("tag").alias("tag")).distinct(), ["asset_id", "tag"], "left_semi")
    named = rows.where("tag <> ''").alias("r").join(hits.alias("h"), (F.col("r.asset_id") == F.col("h.asset_id")) & F.contains(F.upper("h.content"), F.col("r.tag")), "left_semi")
    every = blank.unionByName(measured).unionByName(named).dropDuplicates(["cid"])
    text = F.concat(F.when(F.col("tag") == "", "Documento").otherwise(F.col("tag")), F.lit(": conflicto de versiones — "), "doc_a", F.lit(" vs "), "doc_b")
    return every.select("asset_id", text.alias("text"), F.coalesce("severity", F.lit("warn")).alias("severity"))


def mixed_versions(hits: DataFrame) -> DataFrame:
    """Cases (case_id) whose hits carry several version labels, with the first four."""
    g = hits.where("coalesce(version_label, '') <> ''").groupBy("case_id").agg(F.array_sort(F.collect_set("version_label")).alias("v")).where(F.size("v") > 1)
    return g.select("case_id", F.concat(F.lit("Evidencia recuperada mezcla versiones documentales: "), F.array_join(F.slice("v", 1, 4), ", ")).alias("text"), F.lit("info").alias("severity"))


def finding_banner(findings: DataFrame, by: str) -> DataFrame:
    """count, warnings, severity of the findings of every case."""
    g = findings.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "warn").alias("n_warn"))
    return g.withColumn("severity", F.when(F.col("n_warn") > 0, "warn").otherwise("info"))


def history(asset_ids: DataFrame, orders: DataFrame, calibrations: DataFrame, most: int = 3) -> DataFrame:
    """Newest work orders and all calibrations of every asset as arrays; tags join trimmed and upper-cased."""
    key = F.upper(F.trim(F.col("asset_id")))
    newest = orders.withColumn("asset_id", key).withColumn("rn", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("order_date"), F.asc("order_id")))).where(F.col("rn") <= most)
    o = newest.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("rn", "order_id"))).alias("o")).select("asset_id", F.transform("o", lambda x: x["order_id"]).alias("orders"))
    c = calibrations.withColumn("asset_id", key).groupBy("asset_id").agg(F.count("*").alias("n_calibrations"), F.max("last_calibration").alias("last_calibration"))
    return asset_ids.withColumn("asset_id", key).join(o, "asset_id", "left").join(c, "asset_id", "left").withColumn("n_calibrations", F.coalesce("n_calibrations", F.lit(0)))


def exported_sources(facts: DataFrame) -> DataFrame:
    """Distinct documents that a case's facts rest on."""
    return facts.where("source.document_id IS NOT NULL").groupBy("case_id").agg(F.array_sort(F.collect_set("source.document_id")).alias("documents"))


def analyze(readings: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Diagnosis of every case: readings (case_id, reading_id, tag, description, unit, value, nominal), hits (case_id, hit_id, text), sources
    (hit_id, citation_index, citation, document_id). With readings and hits the limits of the case are matched; with readings alone their nominal values decide; with hits alone
    a case has no fact and the least confidence."""
    found = limits_of_hits(hits, readings.select("case_id", "tag")).withColumn("limit_id", F.concat_ws(":", F.col("case_id").cast("string"), F.col("hit_id").cast("string"), F.lpad(F.col("nth").cast("string"), 4, "0"), "limit_tag"))
    found = written(found.select("case_id", "hit_id", "limit_id", "kind", "limit_value", "limit_unit", "limit_tag"))  # texts are scanned once
    matched = match_limits(readings, found.drop("hit_id"), ("case_id",))
    cited = found.select("limit_id", "hit_id").join(sources, "hit_id", "left").drop("hit_id")
    facts = measurement_facts(matched, cited)
    whole = aggregate_confidence(facts.withColumn("source_doc", F.col("source.document_id")), ["case_id"])
    over = facts.groupBy("case_id").agg(F.count("*").alias("n_facts"), F.count_if("exceeded").alias("n_exceeded"), F.count_if(F.col("source.type") == "document").alias("n_documented"))
    cases = readings.select("case_id").unionByName(hits.select("case_id")).distinct()
    rows = cases.join(whole.select("case_id", "confidence_pct", "label"), "case_id", "left").join(over, "case_id", "left")
    return rows.select("case_id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_exceeded", F.lit(0)).alias("n_exceeded"), F.coalesce("n_documented", F.lit(0)).alias("n_documented"), F.coalesce("confidence_pct", F.lit(0)).alias("confidence_pct"), F.coalesce("label", F.lit("baja")).alias("label"))
