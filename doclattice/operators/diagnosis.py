"""The whole diagnosis of a case: facts, hypotheses with deterministic ones where too few are given, checks, merged discrepancies and their banner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import motor

# Tags of the rules, and what the rules say.
TEMPERATURE, FLOW, VIBRATION = "TE-401A", "FT-405", "VE-402X"
RULES = (
    ("Obstrucción parcial en intercambiador o válvula de control", "Temperatura de salida elevada con caudal por debajo del nominal.", 88),
    ("Degradación de sellos o cavitación en bomba de circulación", "Vibración elevada en 1× RPM con caudal reducido.", 65),
    ("Restricción térmica en intercambiador o control de temperatura", "Lectura de temperatura por encima del límite documentado.", 72),
    ("Desviación operativa sin patrón único identificado", "Los sensores muestran variación respecto a límites o nominal documentado.", 55),
)
NO_EVIDENCE = "No se encontró evidencia documental en el corpus para este activo y síntoma."
LEAST_HYPOTHESES, MOST_HYPOTHESES = 2, 3


def fallback_hypotheses(facts: DataFrame) -> DataFrame:
    """(case_id, title, rationale, confidence, facts) by rule from exceeded temperature, flow and vibration; facts (case_id, nth from 1, tag, exceeded). The first fact of a tag counts."""
    tag = F.upper(F.coalesce("tag", F.lit("")))
    first = lambda t: F.min(F.when(tag == t, F.struct("nth", F.coalesce("exceeded", F.lit(False)).alias("over"))))
    g = facts.groupBy("case_id").agg(F.count("*").alias("n"), *[first(t).alias(a) for t, a in ((TEMPERATURE, "te"), (FLOW, "ft"), (VIBRATION, "ve"))])
    over = {a: F.coalesce(F.col(f"{a}.over"), F.lit(False)) for a in ("te", "ft", "ve")}
    at = lambda *names: F.array(*[F.col(f"{a}.nth").cast("int") for a in names])
    both, worn = over["te"] & over["ft"], over["ft"] & over["ve"]
    fires = (both, worn, over["te"] & ~both & ~worn, ~both & ~worn & ~over["te"])
    cited = (at("te", "ft"), at("ft", "ve"), at("te"), F.sequence(F.lit(1), F.least(F.col("n"), F.lit(2)).cast("int")))
    rows = F.array(*[F.struct(f.alias("fires"), F.lit(t).alias("title"), F.lit(r).alias("rationale"), F.lit(c).alias("confidence"), i.alias("facts")) for (t, r, c), f, i in zip(RULES, fires, cited, strict=True)])
    return g.select("case_id", F.inline(F.filter(rows, lambda x: x["fires"]))).drop("fires")


def hypotheses(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """The hypotheses of every case, ranked H1 to H3: valid ones of ``raw`` (case_id, title, rationale, confidence, facts), and where these are fewer than two, as
    many of the rules' as are missing. Indices out of range are dropped; one without title or reason, or without a fact where there are facts, is not valid."""
    n = facts.groupBy("case_id").agg(F.count("*").alias("n"))
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround("confidence").cast("int"), F.lit(50))))
    known = raw.join(n, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cited = F.array_distinct(F.filter(F.coalesce("facts", F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.col("n"))))
    known = known.select("case_id", F.trim("title").alias("title"), F.trim("rationale").alias("rationale"), pct.alias("confidence"), cited.alias("facts"), "n").where("coalesce(title, '') <> '' AND coalesce(rationale, '') <> '' AND (n = 0 OR size(facts) > 0)").drop("n")
    best = lambda df, k, by, name: df.withColumn(name, F.row_number().over(Window.partitionBy("case_id").orderBy(*by))).where(F.col(name) <= k)
    known = best(known, MOST_HYPOTHESES, [F.desc("confidence"), F.asc("title")], "nth").withColumn("origin", F.lit(0))
    own = fallback_hypotheses(facts).withColumns({"nth": F.lit(0), "origin": F.lit(1)})
    titled = known.select("case_id", F.lower("title").alias("k"))
    own = own.join(titled, (own["case_id"] == titled["case_id"]) & (F.lower(own["title"]) == F.col("k")), "left_anti")
    have = known.groupBy("case_id").agg(F.count("*").alias("have"))
    own = best(own.join(have, "case_id", "left"), LEAST_HYPOTHESES, [F.desc("confidence"), F.asc("title")], "nth").where(F.col("nth") <= LEAST_HYPOTHESES - F.coalesce("have", F.lit(0)))
    every = best(known.unionByName(own.drop("have")), MOST_HYPOTHESES, [F.desc("confidence"), F.asc("origin"), F.asc("title")], "nth")
    return every.select("case_id", F.concat(F.lit("H"), F.col("nth").cast("string")).alias("code"), "title", "rationale", F.col("confidence").alias("confidence_pct"), "facts")


def calibration_texts(calibrations: DataFrame, today: Column) -> DataFrame:
    """Findings (case_id, text, severity) of (case_id, tag, last_calibration, interval_days, drift_pct, tolerance_pct)."""
    rows = motor.calibration_findings(calibrations, today)
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")
    late = F.when(F.col("overdue"), F.concat(F.lit("última calibración hace "), F.col("days").cast("string"), F.lit(" días (máx "), F.coalesce("interval_days", F.lit(365)).cast("string"), F.lit(")")))
    off = F.when(F.col("drifted"), F.concat(F.lit("lectura ±"), number(F.col("drift_pct")), F.lit("% fuera de tolerancia ±"), number(F.coalesce("tolerance_pct", F.lit(5.0))), F.lit("%")))
    return rows.select("case_id", F.concat(F.coalesce(F.nullif("tag", F.lit("")), F.lit("instrumento")), F.lit(" — "), F.concat_ws("; ", late, off)).alias("text"), "severity")


def order_texts(orders: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings on the work order of each case that is nearest to its symptom (case_id, order_id, order_date, score, cause, mtbf_hours, mtbf_expected_hours): a mean time
    between failures under 85 % of what is expected, and a known cause while a fact is exceeded, which may have come back."""
    nearest = motor.top_work_orders(orders, "case_id", F.col("score"), 1)
    over = facts.groupBy("case_id").agg(F.max(F.coalesce("exceeded", F.lit(False))).alias("over"))
    rows = nearest.join(over, "case_id", "left")
    cause, s = F.coalesce("cause", F.lit("")), lambda c: F.col(c).cast("string")
    code = F.coalesce(F.nullif(s("order_id"), F.lit("")), F.lit("WO"))
    short = F.when(F.col("mtbf_hours") < 0.85 * F.col("mtbf_expected_hours"), F.struct(F.concat(code, F.lit(" ("), F.coalesce(s("order_date"), F.lit("")), F.lit("): MTBF "), s("mtbf_hours"), F.lit(" h vs esperado "), s("mtbf_expected_hours"), F.lit(" h — causa previa: "), cause).alias("text"), F.lit("info").alias("severity")))
    again = F.when(F.coalesce("over", F.lit(False)) & (cause != ""), F.struct(F.concat(F.lit("Síntoma actual coincide con histórico "), code, F.lit("; verificar si la causa «"), cause, F.lit("» fue resuelta definitivamente")).alias("text"), F.lit("warn").alias("severity")))
    return rows.select("case_id", F.explode(F.filter(F.array(short, again), lambda x: x.isNotNull())).alias("x")).select("case_id", "x.*")


def merged(groups: list[DataFrame]) -> DataFrame:
    """Findings (case_id, text, severity) of several groups, with their place: of texts that are equal in lower case the earlier group's stays; warnings first, then by text."""
    every = None
    for i, g in enumerate(groups):
        g = g.select("case_id", F.trim("text").alias("text"), F.when(F.col("severity") == "warn", "warn").otherwise("info").alias("severity"), F.lit(i).alias("group")).where("coalesce(text, '') <> ''")
        every = g if every is None else every.unionByName(g)
    once = every.groupBy("case_id", F.lower("text").alias("k")).agg(F.min(F.struct("group", "text", "severity")).alias("x")).select("case_id", "x.text", "x.severity")
    order = Window.partitionBy("case_id").orderBy(F.when(F.col("severity") == "warn", 0).otherwise(1), "text")
    return once.withColumn("nth", F.row_number().over(order))


def banner(findings: DataFrame) -> DataFrame:
    """(case_id, count, message, severity) of the findings of every case that has any."""
    g = findings.groupBy("case_id").agg(F.count("*").alias("count"), F.max(F.col("severity") == "warn").alias("warns"))
    many = F.when(F.col("count") == 1, "").otherwise("s")
    message = F.concat(F.col("count").cast("string"), F.lit(" discrepancia"), many, F.lit(" detectada"), many, F.lit(" — no bloquea el análisis"))
    return g.select("case_id", "count", message.alias("message"), F.when(F.col("warns"), "warn").otherwise("info").alias("severity"))


def diagnose(cases: DataFrame, facts: DataFrame, raw: DataFrame, findings: list[DataFrame], checks: DataFrame) -> DataFrame:
    """One row a case (case_id, n_hits): confidence, summary where there is no evidence, facts, hypotheses, checks, discrepancies and banner as arrays and structs.

    facts: case_id, nth, tag, text, exceeded, confidence, source_doc; raw: hypotheses as above; findings: groups for ``merged``; checks: as ``motor.prioritise_checks`` takes them, with case_id."""
    listed = lambda df, name, order, *cols: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))
    sure = motor.aggregate_confidence(facts, ["case_id"]).select("case_id", "confidence_pct", "label")
    found = merged(findings)
    said = motor.prioritise_checks(checks, "case_id").withColumn("o", F.concat(F.when(F.col("urgent"), "0").otherwise("1"), F.lower("text")))
    parts = [
        sure,
        listed(facts, "facts", "nth", "tag", "text", "exceeded"),
        listed(hypotheses(raw, facts), "hypotheses", "code", "title", "confidence_pct", "facts"),
        listed(said, "checks", "o", "text", "urgent"),
        listed(found, "discrepancies", "nth", "text", "severity"),
        banner(found).select("case_id", F.struct("count", "message", "severity").alias("banner")),
    ]
    out = cases.select("case_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    for part in parts:
        out = out.join(part, "case_id", "left")
    none = (F.col("n_hits") == 0) & F.col("facts").isNull()
    return out.withColumns({"summary": F.when(none, NO_EVIDENCE), "confidence_pct": F.coalesce("confidence_pct", F.lit(0)), "label": F.coalesce("label", F.lit("baja"))})
