"""Corpus reports, latency figures and retrieval metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written

def status_summary(files: DataFrame) -> DataFrame:
    """All counters of the corpus in one pass: (status, indexed, n_tokens)."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = F.col("status")
    return files.agg(F.count("*").alias("total"), count(s == "pass").alias("passed"), count(s == "review").alias("review"), count(s == "reject").alias("rejected"), count(s.isNull()).alias("unknown"), count(F.col("indexed")).alias("indexed"), count((s == "pass") & ~F.col("indexed")).alias("pass_not_indexed"), F.sum(F.when(F.col("indexed"), F.col("n_tokens")).otherwise(0)).alias("tokens"))


def coverage(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Per folder: totals by status, indexed, and the share indexed in percent."""
    g = files.groupBy(F.col(folder).alias("folder")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "reject").alias("rejected"), F.count_if(F.col("indexed")).alias("indexed"))
    return g.withColumn("pct", F.round(100.0 * F.col("indexed") / F.col("total"), 1))


def pivot_status(files: DataFrame, by: str, statuses: tuple[str, ...] = ("pass", "review", "reject")) -> DataFrame:
    return files.groupBy(by).pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0, list(statuses))


def reject_reasons(files: DataFrame, top: int = 15, samples: int = 3) -> DataFrame:
    """Most frequent reasons (cut to 120 characters) with their first sample names, in order of id. Samples are limited before they are shuffled."""
    rows = files.where("status = 'reject'").withColumn("reason", F.substring("reason", 1, 120))
    first = top_per_group(rows.withColumn("turn", -F.col("file_id")), "reason", "turn", "file_id", samples)
    names = first.groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("file_id", "name"))).alias("s"))
    best = rows.groupBy("reason").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).orderBy(F.desc("n"), F.asc("first_id")).limit(top)
    return best.join(names, "reason").select("reason", "n", F.array_join(F.transform("s", lambda x: x["name"]), ", ").alias("samples"))


def top_per_group(rows: DataFrame, by: str, value: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(value), F.asc(key))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def folder_tree(paths: DataFrame) -> DataFrame:
    """Files under every folder at every depth: (path)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.where(F.contains("path", F.lit("/"))).select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


def exact_percentiles(rows: DataFrame, by: str, value: str, ps: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(by, p, x): linearly interpolated percentiles of every group, without a group's values in one task.

    A quantile sketch proposes a bracket of values around each percentile; rows below it are counted and those within it are counted by value. The counts tell whether the
    two values that a percentile lies between are in the bracket; if not, brackets are made wider. Null values are left out."""
    rows = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    slack = 2.0 / accuracy
    while True:
        ends = [min(1.0, max(0.0, p + side * slack)) for p in ps for side in (-1, 1)]
        sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", ends, accuracy).alias("q"))
        low = [F.col("lo") if p <= slack else F.col("q")[2 * i] for i, p in enumerate(ps)]
        high = [F.col("hi") if p + slack >= 1 else F.col("q")[2 * i + 1] for i, p in enumerate(ps)]
        parts = F.array(*[F.struct(F.lit(p).alias("p"), a.alias("lo"), b.alias("hi"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for p, a, b in zip(ps, low, high, strict=True)])
        brackets = written(sketch.select(F.col("g").alias("b_g"), F.explode(parts).alias("b")).select("b_g", "b.*"))
        met = rows.join(brackets, F.col("g").eqNullSafe(F.col("b_g"))).where(F.col("v") <= F.col("hi"))
        counts = met.groupBy("b_g", "p", "at", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("x")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("b_g", "p").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = counts.withColumn("to", upto)
        holds = lambda k: F.max(F.when((k < F.col("to")) & (k >= F.col("to") - F.col("n")), F.col("x")))
        found = written(placed.groupBy("b_g", "p", "at").agg(holds(F.floor("at")).alias("x0"), holds(F.ceil("at")).alias("x1")))
        if slack >= 1 or not found.where("x0 IS NULL OR x1 IS NULL").limit(1).count():
            return found.select(F.col("b_g").alias(by), "p", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("at") - F.floor("at"))).alias("x"))
        slack *= 8


def latency(requests: DataFrame, by: str, value: str = "ms", ok: Column | None = None, wall_ms: float | None = None) -> DataFrame:
    """Count, errors and their share in percent, extremes, mean, linearly interpolated percentiles, total time (``wall_ms`` if given, else the sum) and good requests a second."""
    good = F.col(value) >= 0 if ok is None else ok
    good = F.coalesce(good, F.lit(False))
    v = F.when(good, F.col(value))
    total = F.coalesce(F.sum(v), F.lit(0.0)) if wall_ms is None else F.lit(wall_ms)
    base = requests.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~good).alias("errors"), F.round(100.0 * F.count_if(~good) / F.count("*"), 2).alias("error_pct"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.round(total, 4).alias("total"), F.count(v).alias("ok"))
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    found = exact_percentiles(requests.withColumn("_v", v), by, "_v", tuple(names))
    wide = found.groupBy(F.col(by).alias("p_by")).agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("x"))), 6).alias(n) for p, n in names.items()])
    rps = F.when(F.col("total") > 0, F.round(F.col("ok") / (F.col("total") / 1000), 6)).otherwise(0.0)
    return base.join(wide, F.col(by).eqNullSafe(F.col("p_by")), "left").withColumn("rps", rps).drop("ok", "p_by")


def retrieval_metrics(judged: DataFrame, cases: DataFrame, by: str | None = None, cuts: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """Mean reciprocal rank, hit rate and precision at each cut over (q_id, rank, relevant); cases without hits count as 0."""
    per = judged.groupBy("q_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"), *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"n{k}") for k in cuts])
    full = cases.join(per, "q_id", "left")
    aggs = [F.count("*").alias("n_cases"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr")]
    for k in cuts:
        aggs += [F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("int").cast("double")), 6).alias(f"hit_rate_at_{k}"), F.round(F.avg(F.coalesce(F.col(f"n{k}"), F.lit(0)) / F.lit(float(k))), 6).alias(f"precision_at_{k}")]
    return full.agg(*aggs) if by is None else full.rollup(by).agg(*aggs)


def recommendations(folders: DataFrame, rejected: int = 40, pct: float = 70.0, files: int = 20) -> DataFrame:
    """Which thresholds of the report are crossed: folders under ``pct`` with more than ``files`` files, and many rejects overall."""
    low = folders.where((F.col("pct") < pct) & (F.col("total") > files)).select(F.lit("low_coverage").alias("rule"), F.col("folder").alias("subject"), F.col("pct").cast("double").alias("value"))
    many = folders.agg(F.sum("rejected").alias("r")).where(F.col("r") > rejected).select(F.lit("many_rejects").alias("rule"), F.lit("corpus").alias("subject"), F.col("r").cast("double").alias("value"))
    return low.unionByName(many)


def weak_cases(per_case: DataFrame, k: int = 5) -> DataFrame:
    """Cases (q_id, best: rank of the first relevant hit) that miss the first k hits."""
    return per_case.where(F.col("best").isNull() | (F.col("best") > k))


def kind_counts(scanned: DataFrame) -> DataFrame:
    """Drawings, documents and doubtful files of a scan, with those whose recognition is blocked."""
    return scanned.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("block_ocr").alias("blocked"))


def pilot(scanned: DataFrame, by: str, pages: int = 12, rank: Column | None = None) -> DataFrame:
    """The best candidate of each group for a pilot, of at most so many pages, and the group's greatest score (confidence less 0.01 a page). ``rank`` over file_id and
    pilot_score decides, by default the score; of equal ones the least file_id does. A group without a score has no candidate."""
    kept = scanned.where(F.col("pages") <= pages).withColumn("pilot_score", F.round(F.col("confidence") - 0.01 * F.col("pages"), 6))
    rank = F.col("pilot_score") if rank is None else rank
    best = F.max_by(F.when(rank.isNotNull(), F.col("file_id")), F.struct(rank, -F.col("file_id")))
    return kept.groupBy(by).agg(best.alias("file_id"), F.max("pilot_score").alias("pilot_score"))


def result_rows(hits: DataFrame, columns: list[str], snippet: int = 280) -> DataFrame:
    """Hits as an interface shows them: the named columns, score to four places, the head of the content."""
    return hits.select(*columns, F.round("score", 4).alias("score"), F.trim(F.substring("content", 1, snippet)).alias("snippet"))
