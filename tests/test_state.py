"""Keyed tables and keyed state of streams."""

import random

import pytest
from pyspark.sql import functions as F

from doclattice.sources.keyed import KeyedTable
from doclattice.streaming import state, streams

SCHEMA = "k string, v int, at int"


def held(table):
    return {r["k"]: (r["v"], r["at"]) for r in table.rows().collect()}


def test_keyed_table_replaces_rows_and_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 16)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert held(table) == {}
    table.upsert(frame([(f"k{i}", i, 0) for i in range(200)]), 0)
    before = table._generations()
    table.upsert(frame([("k3", 33, 1), ("new", 1, 1)]), 1)
    after = table._generations()
    assert held(table) == {f"k{i}": (i, 0) for i in range(200)} | {"k3": (33, 1), "new": (1, 1)}
    assert sum(before.get(b) != g for b, g in after.items()) <= 2
    table.upsert(frame([("k4", -1, 1)]), 1)  # the number is committed already
    assert held(table)["k4"] == (4, 0)
    table.upsert(frame([("k4", 44, -5), ("k5", 55, 5), ("k5", 54, 4)]), 2, order="at")
    assert held(table)["k4"] == (4, 0) and held(table)["k5"] == (55, 5)
    table.delete(frame([("k3", 0, 0), ("nobody", 0, 0)]).select("k"), 3)
    assert len(held(table)) == 200 and "k3" not in held(table)


def test_a_write_that_broke_off_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 4)
    table.upsert(spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], SCHEMA), 0)
    broken = F.when(F.col("v") > 1, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("int")
    with pytest.raises(Exception, match="broken"):
        table.upsert(spark.createDataFrame([("a", 1, 9), ("b", 9, 9)], SCHEMA).withColumn("v", broken), 1)
    assert held(table) == {"a": (1, 0), "b": (2, 0)}
    table.upsert(spark.createDataFrame([("a", 5, 9)], SCHEMA), 1)
    assert held(table) == {"a": (5, 9), "b": (2, 0)}


def test_sessions_over_several_batches(spark, tmp_path):
    """Late rows inside the watermark's delay, several batches, ties of time and a restart."""
    rng = random.Random(6)
    rows = [(rng.randrange(4), i, rng.randrange(0, 40_000)) for i in range(300)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 500))  # nearly in order
    source = str(tmp_path / "in")
    put = lambda part: spark.createDataFrame(part, "owner long, session_id long, s long").select("owner", "session_id", F.timestamp_seconds("s").alias("created")).coalesce(1).write.mode("append").parquet(source)
    ttl, capacity, folder = 3600, 3, str(tmp_path / "out")
    with state.rocks(spark):
        for a in range(0, 300, 100):  # each arrival is a run of its own
            put(rows[a : a + 100])
            stream = spark.readStream.schema("owner long, session_id long, created timestamp").parquet(source)
            got = state.to_table(state.session_ends(stream, ttl, capacity, "600 seconds"), folder).collect()
    want, closed = set(), max(r[2] for r in rows) - 600
    for owner in range(4):
        own = sorted((s, i) for o, i, s in rows if o == owner)
        for n, (s, i) in enumerate(own):
            pushed = own[n + capacity][0] if n + capacity < len(own) else None
            full = pushed is not None and pushed <= s + ttl
            if s + ttl < closed:
                want.add((owner, i, s * 1000, (pushed if full else s + ttl) * 1000, "capacity" if full else "time"))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_logs_are_followed_over_runs(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path)
    table = KeyedTable(spark, f"{folder}/t", state.ACTIVITY, ["source"], 4)
    for rows in ([("a", 1, "[1/9] x"), ("b", 1, "noise")], [("a", 2, "[2/9] x"), ("a", 3, "noise"), ("b", 2, "[5/9] y")], [("c", 1, "[0/1] z")]):
        spark.createDataFrame(rows, state.ACTIVITY).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_folder(spark, source, "*.parquet", state.ACTIVITY)
        state.follow_logs(stream, r"^\[", table, f"{folder}/checkpoint")
    assert {(r["source"], r["line_no"], r["line"]) for r in table.rows().collect()} == {("a", 2, "[2/9] x"), ("b", 2, "[5/9] y"), ("c", 1, "[0/1] z")}
