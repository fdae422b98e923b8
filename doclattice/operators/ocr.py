"""Rules over recognised text: tags against the catalogue, dates, units, and the validity of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import FIELD_LEAST

# Patterns of tags, dates and measured values in recognised text.
TAG = r"(?i)\b([A-Z]{2,5}-\d{2,5}[A-Z0-9-]*|IFC[- ]?\d{2,5}|SGP-\d+MYC-[A-Z]+-\d+)\b"
DATE = r"\b(\d{1,2}[-_/]\d{1,2}[-_/]\d{2,4}|\d{4}[-_/]\d{2}[-_/]\d{2})\b"
UNIT = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(bar|°C|mm|kPa|MPa|RPM|rpm|%)\b"


def normal_tag(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.replace(raw, F.lit("_"), F.lit("-"))), r"\s+", "")


def code_forms(document_key: Column) -> Column:
    """Forms of a document's own code, which are no asset tags of it."""
    key = normal_tag(F.coalesce(document_key, F.lit("")))
    both = F.array(key, F.replace(key, F.lit("IFC"), F.lit("IFC-")), F.replace(key, F.lit("IFC-"), F.lit("IFC")))
    return F.when(key == "", F.array().cast("array<string>")).when(key.startswith("IFC"), F.array_distinct(both)).otherwise(F.array(key))


def found_tags(text: Column, document_key: Column) -> Column:
    """Distinct normal tags of four characters at least, without the document's own code, in order."""
    every = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), 1), normal_tag)
    return F.array_sort(F.array_except(F.filter(every, lambda t: F.length(t) >= 4), code_forms(document_key)))


def _status(sure: Column) -> Column:
    return F.when(F.coalesce(sure, F.lit(True)) & ~F.coalesce(F.col("confidence") < FIELD_LEAST, F.lit(False)), "pass").otherwise("review")


def tag_findings(blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """technical_tag rows of blocks (doc_id, page, block, text, document_key, confidence): pass if the tag is a current one of the catalogue (tag, current) and the block is sure."""
    tags = blocks.select("doc_id", "page", "block", "confidence", F.explode(found_tags(F.col("text"), F.col("document_key"))).alias("value"))
    known = catalog.where(F.coalesce("current", F.lit(True))).select(F.upper(F.trim("tag")).alias("value"), F.lit(True).alias("known")).distinct()
    return tags.join(known, "value", "left").select("doc_id", "page", "block", F.lit("technical_tag").alias("rule"), "value", _status(F.coalesce("known", F.lit(False))).alias("status"))


def field_findings(blocks: DataFrame) -> DataFrame:
    """date_field and unit_field rows of blocks; a doubtful block makes them doubtful."""
    text = F.coalesce("text", F.lit(""))
    units = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(UNIT), 1).alias("n"), F.regexp_extract_all(text, F.lit(UNIT), 2).alias("u")), lambda x: F.concat(x["n"], F.lit(" "), x["u"]))
    row = lambda rule, values: F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))
    found = blocks.select("doc_id", "page", "block", "confidence", F.explode(F.concat(row("date_field", F.regexp_extract_all(text, F.lit(DATE), 1)), row("unit_field", units))).alias("x"))
    return found.select("doc_id", "page", "block", "x.rule", "x.value", _status(F.lit(True)).alias("status"))


def slide_quality(slides: DataFrame) -> DataFrame:
    """Quality of slides (doc_id, slide, title, elements array<struct<kind, text>>): reject without any content, review if only pictures or without a title."""
    said = F.exists("elements", lambda e: F.coalesce(F.trim(e["text"]), F.lit("")) != "")
    pictures = (F.size("elements") > 0) & F.forall("elements", lambda e: e["kind"] == "image")
    titled = F.coalesce(F.trim("title"), F.lit("")) != ""
    return slides.select("doc_id", "slide", F.when(~said & ~titled & ~pictures, "reject").when(pictures | ~titled, "review").otherwise("pass").alias("quality"))


def answer_validity(answers: DataFrame) -> DataFrame:
    """ok for answers (case_id, answer) that cite and have a summary heading, and don't say that nothing was found."""
    from ..functions.text import cited_indices

    low = F.lower(F.coalesce("answer", F.lit("")))
    cited = F.size(cited_indices(F.coalesce("answer", F.lit(""))))
    summary, nothing = F.contains(low, F.lit("## resumen")), F.contains(low, F.lit("no encontr")) & (cited == 0)
    return answers.select("case_id", cited.alias("n_cited"), summary.alias("has_summary"), ((cited > 0) & summary & ~nothing).alias("ok"))


def pass_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.count_if("ok") / F.count("*"), 4).alias("rate"))
