import pytest

from doclattice import catalogue

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLE_SQL[name])


def test_stream_counts_close_all_but_the_last_window(spark):
    got = {(str(r["day"]), r["event_type"]): r["n"] for r in catalogue.QUERIES["stream_event_counts"](spark, SF).collect()}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("date_trunc('day', cast(ts as timestamp)) AS day", "event_type").groupBy("day", "event_type").count().collect()
    last = max(str(r["day"]) for r in events)
    assert got == {(str(r["day"]), r["event_type"]): r["count"] for r in events if str(r["day"]) < last}


def test_entry_points_do_not_need_the_training_data_operators(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
