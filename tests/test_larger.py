"""Queries whose results or work differ only on larger tables, or on tables of several files."""

from pyspark.sql import functions as F

from doclattice import catalogue
from doclattice.functions import tables
from doclattice.operators import limits, reports, retrieval
from doclattice.plans import formats
from doclattice.streaming import ingest

from .oracle import same

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def most_rows(spark, run):
    """What ``run`` gives, and the most rows that an operator of its queries made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    out = run()
    bus.waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        key = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            found = [metrics.apply(k) for k in range(metrics.size())]
            most = max([most, *[int(values.get(m.accumulatorId()).get().replace(",", "")) for m in found if m.name() == "number of output rows" and values.contains(m.accumulatorId())]])
    return out, most


def test_pilot_goes_by_the_rank_of_its_sql(spark):
    same(catalogue.QUERIES["pilot_pick"](spark, LARGE), LARGE, catalogue.ORACLE_SQL["pilot_pick"])
    rows = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 90_000, 1, 0.51), ("a", 3, 13, 0.9), ("b", 7, 1, 0.2), ("b", 5, 1, 0.2), ("c", 1, 1, None)], "folder string, file_id long, pages int, confidence double")
    by_score = {r["folder"]: (r["file_id"], r["pilot_score"]) for r in reports.pilot(rows, "folder").collect()}
    assert by_score == {"a": (90_000, 0.5), "b": (5, 0.19), "c": (None, None)}
    ranked = {r["folder"]: (r["file_id"], r["pilot_score"]) for r in reports.pilot(rows, "folder", rank=F.col("pilot_score") * 1000000 - F.col("file_id")).collect()}
    assert ranked == {"a": (1, 0.5), "b": (5, 0.19), "c": (None, None)}


def test_streams_read_tables_of_several_files(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert len(list((tmp_path / "documents.parquet").glob("part-*"))) == 3
    for name in ("replay_safe_files", "stream_event_counts", "live_activity"):
        whole, parts = (sorted(map(tuple, catalogue.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert whole and parts == whole


def test_readings_do_not_meet_every_limit_of_their_tag(spark):
    n = 1000
    readings = spark.range(n).select(F.col("id").alias("reading_id"), F.lit("T-1").alias("tag"), F.when(F.col("id") % 2 == 0, "bar").otherwise("mm").alias("unit"))
    documented = spark.range(n).select(F.col("id").alias("limit_id"), F.lit("t-1").alias("limit_tag"), F.when(F.col("id") % 3 == 0, "bar").otherwise("mm/s").alias("limit_unit"), F.lit("max_vibration").alias("kind"), F.col("id").cast("double").alias("limit_value"))
    rows, most = most_rows(spark, lambda: limits.match_limits(readings, documented).collect())
    assert {(r["unit"], r["limit_id"], r["limit_value"], r["match_score"]) for r in rows} == {("bar", 0, 0.0, 5), ("mm", 1, 1.0, 6)} and len(rows) == n
    assert most <= 2 * n  # 500,000 before


def test_texts_are_not_held_against_all_tags_of_their_case(spark):
    tags = [("a", "T-123"), ("a", "t-5"), ("a", "T-1"), ("b", "T-99"), ("b", "Ñ"), ("b", ""), (None, "T-1"), ("b", None), ("c", "Q-" + "7" * 300)]
    told = [("a", "seen at t-1239"), ("a", "seen at T-77 today"), ("a", "T-1"), ("b", "x " * 400 + "t-99"), ("b", "mañana"), ("b", "T-123"), ("d", "T-1"), (None, "T-1"), ("a", None), ("a", ""), ("c", "z" * 200 + "q-" + "7" * 301)]
    structured = spark.createDataFrame([(c, "measured", t) for c, t in tags], "case_id string, text string, tag string")
    df = limits.merge_facts(structured, spark.createDataFrame(told, "case_id string, text string"))
    fresh = [(r["case_id"], r["text"]) for r in df.where("kind = 'told'").collect()]
    named = lambda c, x: any(c == d and t and x and t.upper() in x.upper() for d, t in tags)
    assert sorted(fresh, key=str) == sorted([(c, x) for c, x in told if c is None or not named(c, x)], key=str)
    assert "collect_set" not in df._jdf.queryExecution().toString()  # no row holds the tags of a case


def test_a_hit_owns_the_tags_it_names(spark):
    tags = spark.createDataFrame([(1, "TE-401"), (1, "te-4"), (1, "FT-9"), (2, "FT-9")], "case_id int, tag string")
    hits = spark.createDataFrame([(1, 10, "te-401 límite 95 °C"), (1, 11, "ZZ-77 límite 95 °C"), (2, 12, "límite 95 °C"), (3, 13, "FT-9 límite 95 °C")], "case_id int, hit_id int, text string")
    found = limits.limits_of_hits(hits, tags)
    assert {(r["hit_id"], r["limit_tag"]) for r in found.where("kind = 'max_temp'").collect()} == {(10, "TE-401"), (10, "TE-4"), (11, "ZZ-77"), (12, None), (13, None)}
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_a_diagnosis_grows_with_its_readings_and_hits(spark):
    n = 300
    readings = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("reading_id"), F.lit("TE-401").alias("tag"), F.lit("T").alias("description"), F.lit("°C").alias("unit"), (F.col("id") % 2 * 10 + 90.0).alias("value"), F.lit(None).cast("double").alias("nominal"))
    hits = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("hit_id"), F.concat(F.lit("TE-401 límite 95 °C en "), F.col("id").cast("string")).alias("text"))
    sources = hits.select("hit_id", F.lit(1).alias("citation_index"), F.lit("c").alias("citation"), F.col("hit_id").cast("string").alias("document_id"))
    rows, most = most_rows(spark, lambda: limits.analyze(readings, hits, sources).collect())
    assert [(r["case_id"], r["n_facts"], r["n_exceeded"], r["n_documented"]) for r in rows] == [(1, n, n // 2, n)]
    assert most <= 100 * n  # places in texts at most; n * 2 * n pairs before


def test_pairs_of_equal_texts_are_scored_once(spark):
    queries = spark.createDataFrame([(i, "b", "bomba azul FT-101" if i % 2 else "x") for i in range(40)] + [(99, None, "x")], "q_id long, brand string, q_text string")
    hits = spark.createDataFrame([(i, "b", "Bomba Azul ft-101" if i % 3 else "valve", "FT-101" if i % 3 else None) for i in range(60)] + [(None, "b", "valve", None), (7, "c", "x", "x")], "hit_id long, brand string, title string, content string")
    df = retrieval.pair_boosts(queries, hits, "brand")
    got = sorted(map(tuple, df.collect()), key=str)
    want = [(q, h, 0.2 if q % 2 and h is not None and h % 3 else 0.0, 0.18 if q % 2 and h is not None and h % 3 else 0.0) for q in range(40) for h in [*range(60), None]]
    assert got == sorted(want, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("regexp") or "regexp" not in plan  # scored before the ids come apart


def test_rows_are_cut_as_by_the_table_function(spark):
    rows = formats.mixed_rows(spark, SF).where("floor(doc_id / 4) % 5 = 0")
    sheets = [(i * 4 + 3, n, "xlsx", "tabla", f"{n * 37} | ñ_x - {'w ' * (n % 3) * 90}", f"Hoja {n // 8}", False, False) for i in (10_000, 10_005) for n in range(20)]
    rows = rows.unionByName(spark.createDataFrame([*sheets, (None, 1, "csv", None, "a b", None, False, False)], "doc_id long, seq long, format string, kind string, text string, section string, mark boolean, safety boolean"))
    tables.register_chunkers(spark, "cut_again")
    rows.createOrReplaceTempView("rows_again")
    want = spark.sql("SELECT * FROM cut_again(TABLE(rows_again) PARTITION BY doc_id ORDER BY seq)")
    got = tables.cut_rows(rows, "seq")
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # documents go over batches
    assert sorted(map(str, tables.cut_rows(rows, "seq").collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = formats.chunks_by_format(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan


def test_documents_alive_meet_one_stage_and_not_all_before(spark, tmp_path):
    files = spark.createDataFrame([(1, "t", "a.pdf", "", "local", "guia", None, "", "Rev 1", "Some text. More of it.")], ingest.FILES)
    plans = []
    store = str(tmp_path / "store")
    steps = dict(ingest.STEPS)
    try:
        for name, step in steps.items():
            ingest.STEPS[name] = lambda b, alive, step=step: plans.append(alive._jdf.queryExecution().optimizedPlan().toString()) or step(b, alive)
        ingest.ingest(files, 0, store)
    finally:
        ingest.STEPS.update(steps)
    assert len(plans) == 9 and max(p.count("Join LeftSemi") for p in plans) == 1
