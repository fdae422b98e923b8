"""The registered query of the whole diagnosis, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis
from .corpus import query, table

#: A user is a case; events are its readings, work orders, calibrations, proposed hypotheses and checks by type and number. SQL that both engines read.
FACT = {"case_id": "user_id", "tag": "CASE event_type WHEN 'error' THEN 'TE-401A' WHEN 'click' THEN 'ft-405' WHEN 'view' THEN 'VE-402X' ELSE 'X-1' END", "text": "'reading ' || event_id", "exceeded": "value > 45", "confidence": "CAST(55 + event_id % 40 AS INT)", "source_doc": "CASE WHEN event_id % 3 = 0 THEN event_id % 5 END"}
RAW = {"case_id": "user_id", "title": "CASE WHEN event_id % 4 <> 1 THEN 'Hypothesis ' || (event_id % 9) || ' of ' || event_id END", "rationale": "CASE WHEN event_id % 5 <> 2 THEN 'because' ELSE ' ' END", "confidence": "CAST(event_id % 130 AS DOUBLE)"}
ORDER = {"case_id": "user_id", "order_id": "event_id", "order_date": "CAST(ts AS DATE)", "score": "event_id % 3", "cause": "CASE WHEN event_id % 4 > 0 THEN 'cause ' || (event_id % 5) END", "mtbf_hours": "CAST(floor(value) AS INT)", "mtbf_expected_hours": "40"}
CALIBRATION = {"case_id": "user_id", "tag": "'I-' || (event_id % 3)", "last_calibration": "CAST(ts AS DATE)", "interval_days": "CAST(event_id % 30 AS INT)", "drift_pct": "CAST(event_id % 12 AS DOUBLE)", "tolerance_pct": "5.5"}
TODAY = "2024-02-01"
CASES = "SELECT user_id AS case_id, count(*) FILTER (event_id % 7 = 0) AS n_hits FROM events GROUP BY user_id"


def pick(spark, d, columns, where):
    return table(spark, d, "events").where(where).select(*[F.expr(x).alias(c) for c, x in columns.items()])


def _sql(columns, where):
    return f"SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM events WHERE {where}"


R = diagnosis.RULES
NTH = "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth"


@query(f"""WITH facts AS ({_sql(FACT | {'nth': NTH[: -len(' AS nth')]}, "event_type <> 'purchase'")}), cases AS ({CASES}),
sure AS (SELECT case_id, least(98, round_even(avg(confidence) + least(3 * count(DISTINCT source_doc), 9) + CASE WHEN bool_or(exceeded) AND count(DISTINCT source_doc) > 0 THEN 5 ELSE 0 END, 0)::INT) AS confidence_pct, count(*) AS n FROM facts GROUP BY case_id),
firsts AS (SELECT case_id, coalesce(min_by(exceeded, nth) FILTER (upper(tag) = 'TE-401A'), false) AS te, coalesce(min_by(exceeded, nth) FILTER (upper(tag) = 'FT-405'), false) AS ft, coalesce(min_by(exceeded, nth) FILTER (upper(tag) = 'VE-402X'), false) AS ve, min(nth) FILTER (upper(tag) = 'TE-401A') AS te_at, min(nth) FILTER (upper(tag) = 'FT-405') AS ft_at, min(nth) FILTER (upper(tag) = 'VE-402X') AS ve_at, count(*) AS n FROM facts GROUP BY case_id),
rules AS (SELECT case_id, '{R[0][0]}' AS title, {R[0][2]} AS pct, te_at || ',' || ft_at AS cited FROM firsts WHERE te AND ft UNION ALL SELECT case_id, '{R[1][0]}', {R[1][2]}, ft_at || ',' || ve_at FROM firsts WHERE ft AND ve UNION ALL SELECT case_id, '{R[2][0]}', {R[2][2]}, te_at::VARCHAR FROM firsts WHERE te AND NOT ft UNION ALL SELECT case_id, '{R[3][0]}', {R[3][2]}, CASE WHEN n > 1 THEN '1,2' ELSE '1' END FROM firsts WHERE NOT te AND NOT (ft AND ve)),
raw AS (SELECT r.case_id, trim(title) AS title, least(100, confidence)::INT AS pct, array_to_string(list_filter([1, 3, 400], lambda i: i <= coalesce(n, 0)), ',') AS cited, coalesce(n, 0) AS n FROM ({_sql(RAW | {'rationale': RAW['rationale']}, 'event_id % 11 = 0')}) r LEFT JOIN firsts USING (case_id) WHERE trim(coalesce(title, '')) <> '' AND trim(rationale) <> ''),
k AS (SELECT case_id, title, pct, cited, 0 AS origin FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pct DESC, title) AS i FROM raw WHERE n = 0 OR cited <> '') WHERE i <= 3),
more AS (SELECT case_id, title, pct, cited, 1 AS origin FROM (SELECT rules.*, row_number() OVER (PARTITION BY case_id ORDER BY pct DESC, title) AS i, (SELECT count(*) FROM k WHERE k.case_id = rules.case_id) AS have FROM rules) WHERE i <= 2 - have),
hyp AS (SELECT case_id, string_agg('H' || i || ' ' || title || ' ' || pct || ' [' || cited || ']', '; ' ORDER BY i) AS hypotheses FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pct DESC, origin, title) AS i FROM (FROM k UNION ALL FROM more)) WHERE i <= 3 GROUP BY case_id),
cal AS (SELECT case_id, tag || ' — ' || concat_ws('; ', CASE WHEN days > interval_days THEN 'última calibración hace ' || days || ' días (máx ' || interval_days || ')' END, CASE WHEN drift_pct > 5.5 THEN 'lectura ±' || drift_pct::INT || '% fuera de tolerancia ±5.5%' END) AS text, CASE WHEN days > interval_days THEN 'warn' ELSE 'info' END AS severity FROM (SELECT *, date_diff('day', last_calibration, DATE '{TODAY}') AS days FROM ({_sql(CALIBRATION, "event_type = 'purchase' AND event_id % 3 = 0")})) WHERE days > interval_days OR drift_pct > 5.5),
wo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN best > 0 THEN score ELSE 0 END DESC, order_date DESC, order_id) AS i FROM (SELECT *, max(score) OVER (PARTITION BY case_id) AS best FROM ({_sql(ORDER, "event_type = 'signup'")}))) WHERE i = 1),
ot AS (SELECT case_id, order_id || ' (' || order_date || '): MTBF ' || mtbf_hours || ' h vs esperado 40 h — causa previa:' || coalesce(' ' || cause, '') AS text, 'info' AS severity FROM wo WHERE mtbf_hours < 34 UNION ALL SELECT case_id, 'Síntoma actual coincide con histórico ' || order_id || '; verificar si la causa «' || cause || '» fue resuelta definitivamente', 'warn' FROM wo WHERE cause IS NOT NULL AND case_id IN (SELECT case_id FROM facts WHERE exceeded)),
found AS (SELECT case_id, arg_min(text, (g, text)) AS text, arg_min(severity, (g, text)) AS severity FROM (SELECT *, 0 AS g FROM cal UNION ALL SELECT *, 1 FROM ot UNION ALL SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'i-' || (event_id % 3) || ' seen' ELSE 'I-' || (event_id % 3) || ' SEEN' END, CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'other' END, 2 + event_id % 2 FROM events WHERE event_id % 13 = 0) GROUP BY case_id, lower(text)),
disc AS (SELECT case_id, string_agg(sev || ' ' || text, '; ' ORDER BY CASE WHEN sev = 'warn' THEN 0 ELSE 1 END, text) AS discrepancies, count(*) AS n_found, bool_or(sev = 'warn') AS warns FROM (SELECT *, CASE WHEN severity = 'warn' THEN 'warn' ELSE 'info' END AS sev FROM found) GROUP BY case_id),
chk AS (SELECT user_id AS case_id, 'check ' || event_type AS text, bool_or(event_id % 5 = 0) AS urgent FROM events WHERE event_id % 2 = 0 GROUP BY ALL), chks AS (SELECT case_id, string_agg(text || CASE WHEN urgent THEN '!' ELSE '' END, '; ' ORDER BY urgent DESC, text) AS checks FROM chk GROUP BY case_id)
SELECT case_id, n_hits, coalesce(confidence_pct, 0) AS confidence_pct, CASE WHEN confidence_pct >= 85 THEN 'alta' WHEN confidence_pct >= 60 THEN 'media' ELSE 'baja' END AS label, coalesce(n, 0) AS n_facts, hypotheses, checks, discrepancies, n_found || CASE WHEN n_found = 1 THEN ' discrepancia detectada' ELSE ' discrepancias detectadas' END || ' — no bloquea el análisis' AS banner, CASE WHEN warns THEN 'warn' WHEN n_found > 0 THEN 'info' END AS banner_severity, CASE WHEN n_hits = 0 AND n IS NULL THEN '{diagnosis.NO_EVIDENCE}' END AS summary
FROM cases LEFT JOIN sure USING (case_id) LEFT JOIN hyp USING (case_id) LEFT JOIN disc USING (case_id) LEFT JOIN chks USING (case_id)""")
def motor_diagnosis(spark, d):
    """Every case in full: confidence, hypotheses, checks, discrepancies of calibrations, orders and others, and the banner."""
    events = table(spark, d, "events")
    facts = events.where("event_type <> 'purchase'").withColumn("nth", F.expr(NTH[: -len(" AS nth")])).select("nth", *[F.expr(x).alias(c) for c, x in FACT.items()])
    raw = pick(spark, d, RAW, "event_id % 11 = 0").withColumn("facts", F.array(F.lit(1), F.lit(3), F.lit(3), F.lit(400)))
    cal = diagnosis.calibration_texts(pick(spark, d, CALIBRATION, "event_type = 'purchase' AND event_id % 3 = 0"), F.lit(TODAY).cast("date"))
    orders = diagnosis.order_texts(pick(spark, d, ORDER, "event_type = 'signup'"), facts)
    other = lambda odd: events.where(f"event_id % 13 = 0 AND event_id % 2 = {odd}").select(F.col("user_id").alias("case_id"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'i-' || (event_id % 3) || ' seen' ELSE 'I-' || (event_id % 3) || ' SEEN' END").alias("text"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'other' END").alias("severity"))
    checks = events.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("case_id"), F.concat(F.lit("check "), "event_type").alias("text")).agg(F.max(F.col("event_id") % 5 == 0).alias("urgent")).withColumns({"origin": F.lit(0), "alarm": F.lit(False), "criticality": F.lit("C")})
    cases = events.groupBy(F.col("user_id").alias("case_id")).agg(F.count_if(F.col("event_id") % 7 == 0).alias("n_hits"))
    rows = diagnosis.diagnose(cases, facts, raw, [cal, orders, other(0), other(1)], checks)
    said = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, f), "; "))
    return rows.select(
        "case_id", "n_hits", "confidence_pct", "label", F.coalesce(F.size("facts"), F.lit(0)).alias("n_facts"),
        said("hypotheses", lambda h: F.concat(h["code"], F.lit(" "), h["title"], F.lit(" "), h["confidence_pct"].cast("string"), F.lit(" ["), F.array_join(h["facts"].cast("array<string>"), ","), F.lit("]"))).alias("hypotheses"),
        said("checks", lambda c: F.concat(c["text"], F.when(c["urgent"], "!").otherwise(""))).alias("checks"),
        said("discrepancies", lambda x: F.concat(x["severity"], F.lit(" "), x["text"])).alias("discrepancies"),
        F.col("banner.message").alias("banner"), F.col("banner.severity").alias("banner_severity"), "summary",
    )
