"""Changes as new DataFrames: upserts, patches, deletions, retention, sessions. Callers write the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_first_wins(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new keys are added; rows that exist stay as they are."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def upsert_last_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of all rows of a key, the incoming one with the greatest order stays, else the existing one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), order.desc())
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of changes (one row a key) replace those of rows."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def retention(rows: DataFrame, allowed_hashes: DataFrame, allowed_keys: DataFrame) -> DataFrame:
    """What a cleaning run would remove: rows whose hash and key are both not allowed."""
    return rows.join(allowed_hashes, "file_hash", "left_anti").join(allowed_keys, "logical_key", "left_anti")


def set_payload(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def live_sessions(puts: DataFrame, now: Column, ttl_seconds: int, capacity: int) -> DataFrame:
    """Sessions (session_id, created) not past their time to live, the newest ``capacity`` of each owner."""
    alive = puts.where(F.unix_timestamp(now) - F.unix_timestamp("created") <= ttl_seconds)
    w = Window.partitionBy("owner").orderBy(F.desc("created"), F.desc("session_id"))
    return alive.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= capacity)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule: a constraint holds when its count is 0. One pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*map(F.col, rules)))).alias("rule", "broken"))
