"""Evidence for answers: enriched hits, evidence blocks, references, scope, payloads, and the conflict banner."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_indices
from .retrieval import top

# The answer without evidence, and the lengths of evidence and snippets.
NO_EVIDENCE = "No encontré evidencia en el corpus para responder esta consulta."
EVIDENCE, SNIPPET = 3500, 280


def filled(*columns) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in columns])


def enrich(hits: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (q_id, hit_id, document_id, title, section, content, ...) with their document's title and kind and their chunk's section, pages and content: the hit's own values first,
    then the chunk's, then the document's; of two contents the longer one."""
    d = documents.select("document_id", F.col("title").alias("d_title"), F.col("kind").alias("d_kind"), F.col("version_label").alias("d_version"))
    c = chunks.select("hit_id", F.col("content").alias("c_content"), F.col("section").alias("c_section"), "page_start", "page_end")
    rows = hits.join(d, "document_id", "left").join(c, "hit_id", "left")
    longer = F.when(F.length(F.coalesce("c_content", F.lit(""))) > F.length(F.coalesce("content", F.lit(""))), F.col("c_content")).otherwise(F.col("content"))
    new = {"title": filled("title", "d_title"), "section": filled("section", "c_section"), "kind": F.col("d_kind"), "version_label": F.col("d_version"), "content": longer}
    return rows.withColumns(new).drop("d_title", "d_kind", "d_version", "c_content", "c_section")


def facet_filter(hits: DataFrame, asset: str = "", domain: str = "", kind: str = "", document_key: str = "", version: str = "", text: str = "") -> DataFrame:
    """Hits that match every facet given: asset as a code or in title or content; domain and kind equal; key, version and text as parts; case ignored."""
    low = lambda *cs: F.lower(F.concat_ws(" ", *cs))
    has = lambda where, what: F.contains(where, F.lit(what.strip().lower()))
    if asset.strip():
        hits = hits.where(F.exists(F.coalesce("asset_codes", F.array().cast("array<string>")), lambda a: F.upper(a) == asset.strip().upper()) | has(low("content", "title"), asset))
    for column, value in (("domain", domain), ("kind", kind)):
        if value.strip():
            hits = hits.where(F.lower(F.coalesce(column, F.lit(""))) == value.strip().lower())
    if version.strip():
        hits = hits.where(has(low("version_label"), version))
    if document_key.strip():
        hits = hits.where(has(low("document_key"), document_key) | has(low("title"), document_key))
    return hits.where(has(low("content", "title", "section"), text)) if text.strip() else hits


def evidence(hits: DataFrame, limit: int = 6) -> DataFrame:
    """Numbered evidence text of each query: "[n] citation" and the head of the content, best first."""
    best = top(hits, ["q_id"], [F.desc("score"), F.asc("hit_id")], limit, "nth")
    line = F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), F.coalesce(filled("citation", "title"), F.concat(F.lit("Fuente "), F.col("nth").cast("string"))), F.lit("\n"), F.substring("content", 1, EVIDENCE))
    g = best.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("x"))
    return g.select("q_id", F.size("x").alias("n_evidence"), F.array_join(F.transform("x", lambda e: e["line"]), "\n\n").alias("evidence"))


def extractive(question: pd.Series, text: pd.Series) -> pd.Series:
    """A stand-in for a chat service: a summary that cites every piece of evidence."""
    return text.map(lambda t: "## Resumen\n" + " ".join(f"[{i}]" for i in range(1, t.count("\n\n[") + 2)))


def ask(queries: DataFrame, hits: DataFrame, answer: Callable[[pd.Series, pd.Series], pd.Series] = extractive, limit: int = 6) -> DataFrame:
    """q_id, answer, cited and n_evidence of every query (q_id, q_text); ``answer`` maps questions and evidence to answers; without hits the fixed answer."""
    rows = queries.join(evidence(hits, limit), "q_id", "left")

    def said(question: pd.Series, text: pd.Series) -> pd.Series:
        return answer(question, text)

    told = F.pandas_udf(said, "string")
    rows = rows.withColumn("answer", F.when(F.col("evidence").isNull(), NO_EVIDENCE).otherwise(told("q_text", F.coalesce("evidence", F.lit("")))))
    n = F.coalesce("n_evidence", F.lit(0))
    return rows.select("q_id", "answer", cited_indices(F.col("answer"), n).alias("cited"), n.alias("n_evidence"))


def references(answers: DataFrame, hits: DataFrame, limit: int = 6) -> DataFrame:
    """A row for each cited hit of an answer (ask), in order of citing."""
    best = top(hits, ["q_id"], [F.desc("score"), F.asc("hit_id")], limit, "nth")
    cited = answers.select("q_id", F.posexplode("cited").alias("pos", "nth"))
    return cited.join(best, ["q_id", "nth"]).select("q_id", "pos", "nth", "hit_id", F.round("score", 4).alias("score"), F.trim(F.substring("content", 1, SNIPPET)).alias("snippet"))


def ask_selected(queries: DataFrame, hits: DataFrame, selected: DataFrame, limit: int = 8) -> DataFrame:
    """ask() over the hits of the selected nodes (hit_id) alone."""
    return ask(queries, hits.join(selected.select("hit_id").distinct(), "hit_id", "left_semi"), limit=limit)


def payload(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """q_id and the JSON of answer, number of evidence and references."""
    r = refs.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("pos", "nth", "hit_id", "score"))).alias("references"))
    return answers.join(r, "q_id", "left").select("q_id", F.to_json(F.struct("answer", "n_evidence", F.transform(F.coalesce("references", F.array().cast("array<struct<pos:int,nth:int,hit_id:bigint,score:double>>")), lambda x: F.struct(x["nth"].alias("index"), x["hit_id"].alias("hit_id"), x["score"].alias("score"))).alias("references"))).alias("payload"))


def superseded(hits: DataFrame) -> DataFrame:
    """Queries with hits of documents that aren't in force, how many, and the first three titles."""
    old = hits.where(F.lower(F.coalesce("version_status", F.lit(""))).isin("superseded", "indexed") | ~F.coalesce("is_current", F.lit(True)))
    nth = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "hit_id"))
    return old.withColumn("nth", nth).groupBy("q_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "title")))).alias("x")).select("q_id", "n", F.array_join(F.transform("x", lambda e: e["title"]), ", ").alias("titles"))


def conflict_banner(conflicts: DataFrame, by: str) -> DataFrame:
    """Count, severity and message of the conflicts (severity) of every query."""
    g = conflicts.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "warn").alias("n_warn"))
    s = F.when(F.col("n") != 1, "s").otherwise("")
    return g.select(by, "n", F.when(F.col("n_warn") > 0, "warn").otherwise("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" conflicto"), s, F.lit(" documental detectado"), s, F.lit(" — requiere validación humana")).alias("message"))
