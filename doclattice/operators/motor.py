"""Sensor readings against documented limits, maintenance history, hypotheses, checks and discrepancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = {"24h": 24, "7d": 168, "30d": 720}


def sensor_window(readings: DataFrame, window: str, now: Column, upper: bool = False) -> DataFrame:
    """Readings not older than the window; "custom" keeps all, an unknown one means 24 hours; no upper bound unless asked for."""
    if window == "custom":
        return readings
    kept = readings.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(WINDOWS.get(window, 24))))
    return kept.where(F.col("ts") <= now) if upper else kept


def exceeded(kind: Column, value: Column, limit: Column, nominal: Column) -> Column:
    """Over a maximum, under a minimum, or more than 15 % off the nominal; null if nothing is known."""
    off = lambda base: F.abs(value - base) > 0.15 * base
    return (
        F.when(kind == "min_flow", value < limit)
        .when(kind == "nominal_flow", off(F.coalesce(nominal, limit)))
        .when(kind.isNotNull(), value > limit)
        .when(nominal.isNotNull(), F.abs(value - nominal) / F.greatest(nominal, F.lit(1.0)) > 0.15)
    )


def fact_confidence(has_limit: Column, known: Column, nominal: Column) -> Column:
    return F.least(F.lit(98), 55 + F.when(has_limit, 25).otherwise(0) + F.when(known, 10).otherwise(0) + F.when(nominal, 5).otherwise(0))


def confidence_label(pct: Column) -> Column:
    return F.when(pct >= 85, "alta").when(pct >= 60, "media").otherwise("baja")


def aggregate_confidence(facts: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence + min(3 * documents, 9) + 5 if a documented fact is exceeded, 98 at most."""
    g = facts.groupBy(*by).agg(F.avg(F.coalesce("confidence", F.lit(0))).alias("mean"), F.count_distinct("source_doc").alias("docs"), F.max(F.coalesce("exceeded", F.lit(False)).cast("int")).alias("any_over"))
    raw = F.col("mean") + F.least(3 * F.col("docs"), F.lit(9)) + F.when((F.col("any_over") == 1) & (F.col("docs") > 0), 5).otherwise(0)
    return g.withColumn("confidence_pct", F.least(F.lit(98), F.bround(raw).cast("int"))).withColumn("label", confidence_label(F.col("confidence_pct")))


def calibration_findings(calibrations: DataFrame, today: Column) -> DataFrame:
    """Overdue (days since the last beyond the interval, 365 by default) or drifted (over the tolerance, 5 by default)."""
    days = F.coalesce(F.datediff(today, "last_calibration"), F.lit(0))
    rows = calibrations.withColumn("days", days).withColumn("overdue", F.col("days") > F.coalesce("interval_days", F.lit(365))).withColumn("drifted", F.coalesce("drift_pct", F.lit(0.0)) > F.coalesce("tolerance_pct", F.lit(5.0)))
    return rows.where("overdue OR drifted").withColumn("severity", F.when(F.col("overdue"), "warn").otherwise("info"))


def top_work_orders(orders: DataFrame, by: str, score: Column, k: int = 3) -> DataFrame:
    """The k best by symptom score; where the best score is 0, the newest."""
    rows = orders.withColumn("score", score)
    best = F.max("score").over(Window.partitionBy(by))
    w = Window.partitionBy(by).orderBy(F.when(best > 0, F.col("score")).otherwise(0).desc(), F.desc("order_date"), F.asc("order_id"))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def mtbf_findings(orders: DataFrame, factor: float = 0.85) -> DataFrame:
    return orders.where(F.col("mtbf_hours") < factor * F.col("mtbf_expected_hours"))


def rank_hypotheses(candidates: DataFrame, by: str, keep: int = 3) -> DataFrame:
    """Valid hypotheses (title, rationale, at least one fact), by confidence clamped to 0-100 (50 if missing), numbered H1..."""
    pct = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround("confidence").cast("int"), F.lit(50))))
    valid = candidates.where("coalesce(trim(title), '') <> '' AND coalesce(trim(rationale), '') <> '' AND n_facts > 0").withColumn("confidence_pct", pct)
    w = Window.partitionBy(by).orderBy(F.desc("confidence_pct"), F.asc("title"))
    return valid.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep).withColumn("code", F.concat(F.lit("H"), F.col("nth").cast("string")))


def prioritise_checks(checks: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Checks of several origins (origin 0 first) until there are ``least``; equal lower-cased texts once; urgent first, then by text.

    A check is urgent too when its asset has an alarm and criticality A or B.
    """
    once = Window.partitionBy(by, F.lower("text")).orderBy("origin", "text")
    rows = checks.withColumn("rn", F.row_number().over(once)).where("rn = 1").drop("rn")
    order = Window.partitionBy(by).orderBy("origin", F.lower("text"))
    rows = rows.withColumn("nth", F.row_number().over(order)).where((F.col("origin") == 0) | (F.col("nth") <= least))
    return rows.withColumn("urgent", F.col("urgent") | (F.col("alarm") & F.col("criticality").isin("A", "B")))
