import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from doclattice.functions import text as T
from doclattice.operators import answers, assets, chunking, diagnosis, dml, identity, insight, limits, motor, ocr, quality, reports, retrieval
from doclattice.sources import readers, sinks
from doclattice.streaming import streams


def one(df):
    return df.collect()[0]


def test_text_functions(spark):
    df = spark.createDataFrame([("TE-401A FT-405 VE-402X CTS-DCH-ENF ATENCIÓN GUIGS-12",)], "t string")
    r = one(df.select(T.asset_tags(F.col("t")).alias("a"), T.exact_tags(F.col("t")).alias("x"), T.is_safety(F.col("t")).alias("s"), T.uuid5_url(F.lit("d1:0")).alias("u"), T.content_hash(F.lit(" A  b\n")).alias("h"), T.key_part(F.lit("Guía  Nº-3")).alias("k"), T.decimal_comma(F.lit("3,5")).alias("d"), T.cited_indices(F.lit("x [2] y [1] z [2]")).alias("c")))
    assert r["a"] == ["FT-405"] or "FT-405" in r["a"]
    assert {"TE-401A", "FT-405", "GUIGS-12"} <= set(r["x"]) and r["s"]
    assert r["u"] == "791801af-e45e-5dbb-83fc-55d61fb2d301" == str(uuid.uuid5(uuid.NAMESPACE_URL, "d1:0"))
    assert r["h"] == hashlib.sha256(b"a b").hexdigest() and r["k"] == "guia no 3" and r["d"] == 3.5 and r["c"] == [2, 1]


def test_titles_and_tags(spark):
    df = spark.createDataFrame([("Guia_bomba Rev 3 2024-01-02.pdf", "doc P-10 PMP-2040A REV-12")], "n string, t string")
    r = one(df.select(T.title_key(F.col("n")).alias("k"), T.longest_tag(F.col("t")).alias("g"), T.slug(F.col("n")).alias("s"), T.concept_slug(F.lit("Fuga, de aceite!")).alias("c")))
    assert r["k"] == "guia bomba" and r["g"] == "PMP-2040A" and r["s"].startswith("Guia_bomba_Rev") and r["c"] == "fuga-de-aceite"


def test_names_and_citations(spark):
    df = spark.createDataFrame([("Guia final ._.pdf", "see [3] [1] [9] [3]")], "n string, a string")
    none = F.lit(None).cast("int")
    r = one(df.select(T.slug(F.col("n")).alias("s"), T.extract_slug(F.col("n")).alias("e"), T.cited_indices(F.col("a"), F.lit(3)).alias("c"), T.picked_kind(F.lit("plano 1"), F.lit(".pdf")).alias("k"), T.citation(F.lit("T"), F.lit("v1"), none, none, F.lit("S"), F.lit(0), F.lit("tabla")).alias("t")))
    assert (r["s"], r["e"], r["c"], r["k"], r["t"]) == ("Guia_final_._", "Guia_final", [3, 1], "manual_oem", "T (v1) — hoja/fila: S")


def test_parts_of_names(spark):
    df = spark.createDataFrame([("guigs 12 PMP-20A-01 P-7 Rev-3 Guigs.pdf", "Entregables\\Planta Norte")], "n string, p string")
    r = one(df.select(T.asset_of(F.col("n"), F.col("p")).alias("a"), T.guide_number(F.col("n"), F.col("p")).alias("g"), T.module_of(F.col("n"), F.col("p")).alias("m"), T.document_code(F.lit("x"), F.lit("sgp-12myc-ab-3")).alias("c"), T.exact_tags(F.col("n")).alias("x")))
    assert (r["a"], r["g"], r["m"], r["c"]) == ("PMP-20A-01", "GUIGS-12", "planta norte", "SGP-12MYC-AB-3") and r["x"] == ["PMP-20A", "guigs"]


def test_longest_run_counts_neighbours(spark):
    df = spark.createDataFrame([(["aa", "bb", "cc", "dd"], "the bbs and cc")], "q array<string>, t string")
    assert one(df.select(T.longest_run(F.col("q"), F.col("t")).alias("n")))["n"] == 2


def test_replay_rules(spark):
    rows = [
        ("t", 1, 1, "k1", "h1", "c1", "a.pdf", "C1", "P-1", "high"),
        ("t", 2, 2, "k1", "h1", "c1", "a.pdf", "C1", "P-1", "high"),
        ("t", 3, 3, "k1", "h3", "c1", "a.pdf", "C1", "P-1", "high"),
        ("t", 4, 4, "k1", "h4", "c2", "a.pdf", "C1", "P-1", "high"),
        ("t", 5, 5, "k9", "h5", "c5", "b.pdf", "C1", "P-2", "high"),
        ("t", 6, 6, "k1", "h6", None, "a.pdf", "C1", "P-1", "low"),
        ("t", 7, 7, "k1", "h7", "c1", "a.pdf", "C1", "P-1", "high"),
        ("t", 8, 8, "k8", "h8", "c8", "a.pdf", "", "", "high"),  # the same name is a conflict for an unsure file only
        ("t", 9, 9, "k7", "h9", "c9", "c.pdf", "C1", "", "high"),  # one asset is blank
        ("t", 10, 10, "k6", "h10", "c9", "A.pdf", "", "", "low"),
    ]
    df = spark.createDataFrame(rows, "tenant string, file_id long, arrival long, logical_key string, file_hash string, content_hash string, name string, code string, asset string, confidence string")
    got = {r["file_id"]: r["decision"] for r in identity.replay(df).collect()}
    assert got == {1: "new_document", 2: "duplicate", 3: "same_content", 4: "new_version", 5: "review", 6: "review", 7: "new_version", 8: "new_document", 9: "new_document", 10: "review"}


def test_best_registered_and_activation(spark):
    df = spark.createDataFrame([("k", 1, False, "active", "h"), ("k", 2, True, "indexed", None), ("k", 3, True, "active", None)], "logical_key string, doc_id long, is_current boolean, status string, content_hash string")
    assert one(identity.best_registered(df))["doc_id"] == 3
    v = spark.createDataFrame([("c", 1, 1, 2, 2, 2), ("c", 2, 2, 2, 2, 2), ("c", 3, 3, 2, 1, 2)], "catalog_id string, doc_id long, version_no int, chunks int, points int, expected int")
    assert {r["doc_id"]: r["status"] for r in identity.activate(v).collect()} == {1: "superseded", 2: "active", 3: "indexed"}


def test_fold_keeps_order_caps_and_safety_pairs():
    rows = [(f"w{i} " * 20 + ".", False, False, "1 Alpha") for i in range(40)]
    chunks = chunking.fold(rows, 350)
    assert all(n <= 350 + 2 * 21 for _, n, _, _ in chunks) and chunks[0][0].startswith("w0") and all(f"w{i} " in " ".join(c[0] for c in chunks) for i in range(40))
    glued = chunking.fold([("a " * 80, False, False, None), ("peligro " * 60, False, True, None), ("b " * 60, False, False, None)], 150)
    assert any("peligro" in c[0] and "b b" in c[0] for c in glued)


def test_short_tail_joins_the_chunk_before():
    chunks = chunking.fold([("a " * 100, False, False, None), ("b " * 100, False, False, None), ("c " * 10, False, False, None)], 100)
    assert "c c" in chunks[-1][0] and "b b" in chunks[-1][0]


def test_oversize_is_split_whole():
    text = "one two three. " * 5000
    parts = chunking.split_oversize(text, 800)
    assert all(chunking.count_tokens(p) <= 800 for p in parts) and sum(p.count("one") for p in parts) == 5000
    assert "".join(chunking.split_oversize("x " * 2000, 500)).count("x") == 2000


def test_chunks_of_documents(spark):
    df = spark.createDataFrame([(1, "1. Alcance General\nUna frase. Otra frase! Fin?"), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.segments(df).orderBy("line_no", "part").collect()
    assert [r["segment"] for r in rows] == ["1. Alcance General", "Una frase.", "Otra frase!", "Fin?"] and rows[-1]["section"] == "1 Alcance General"
    assert [r["doc_id"] for r in chunking.chunk(df).collect()] == [1]
    many = spark.createDataFrame([(i, ". ".join(f"word{i} again{k}" for k in range(i * 9))) for i in range(1, 60)], "doc_id long, text string")
    got = chunking.chunk(many, "tabla").collect()
    assert {r["doc_id"] for r in got} == set(range(1, 60)) and all(f"word{r['doc_id']} " in r["content"] and r["content"].count("word") == r["content"].count(f"word{r['doc_id']} ") for r in got)
    assert all(any(f"again{k}" in r["content"] for r in got if r["doc_id"] == 50) for k in range(450))


def test_upserts_patch_and_sessions(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {r["k"]: r["v"] for r in dml.upsert_first_wins(a, b, ["k"]).collect()} == {1: "a", 2: "b", 3: "y"}
    assert {r["k"]: r["v"] for r in dml.upsert_last_wins(a, b, ["k"], F.col("v")).collect()} == {1: "a", 2: "x", 3: "y"}
    assert {r["k"]: r["v"] for r in dml.patch(a, b, "k", ["v"]).collect()} == {1: "a", 2: "x"}
    assert {r["k"] for r in dml.delete(a, b, ["k"]).collect()} == {1}
    assert {r["v"] for r in dml.set_payload(a, F.col("k") == 1, {"v": F.lit("z")}).collect()} == {"z", "b"}


def test_limits_and_facts(spark):
    readings = spark.createDataFrame([(1, "TE-401A", "°C", 98.0, 80.0), (2, "FT-405", "L/min", 50.0, 100.0), (3, "XX-1", "bar", 1.0, None)], "reading_id int, tag string, unit string, value double, nominal double")
    documented = spark.createDataFrame([(1, "max_temp", 95.0, "°C", "TE-401A"), (2, "generic_limit", 90.0, "°C", None), (3, "nominal_flow", 100.0, "L/min", None)], "limit_id int, kind string, limit_value double, limit_unit string, limit_tag string")
    rows = limits.match_limits(readings, documented).withColumn("over", motor.exceeded(F.col("kind"), F.col("value"), F.col("limit_value"), F.col("nominal"))).collect()
    got = {r["reading_id"]: (r["limit_id"], r["over"]) for r in rows}
    assert got == {1: (1, True), 2: (3, True), 3: (None, None)}


def test_rules(spark):
    r = one(spark.range(1).select(motor.fact_confidence(F.lit(True), F.lit(True), F.lit(True)).alias("b"), motor.confidence_label(F.lit(60)).alias("c")))
    assert (r["b"], r["c"]) == (95, "media")
    facts = spark.createDataFrame([(1, 1, "te-401a", True), (1, 2, "FT-405", True), (1, 3, "TE-401A", False), (2, 1, "X", None), (3, 1, "TE-401A", False), (3, 2, "TE-401A", True), (4, 1, "VE-402X", True), (4, 2, "FT-405", True), (4, 3, "TE-401A", True), (5, 1, "TE-401A", True)], "case_id long, nth int, tag string, exceeded boolean")
    assert sorted((x["case_id"], x["confidence"], x["facts"]) for x in diagnosis.fallback_hypotheses(facts).collect()) == [(1, 88, [1, 2]), (2, 55, [1]), (3, 55, [1, 2]), (4, 65, [2, 1]), (4, 88, [3, 2]), (5, 72, [1])]
    cal = spark.createDataFrame([("2024-08-15", 365, 5.0, 5.2)], "last string, interval_days int, tolerance_pct double, drift_pct double").withColumn("last_calibration", F.to_date("last"))
    assert one(motor.calibration_findings(cal, F.lit("2026-09-01").cast("date")))["severity"] == "warn"


def test_conflicts(spark):
    rows = spark.createDataFrame([("k", 1, "temperatura 12 c y 85 °C RPN: 120"), ("k", 2, "RPN 240 límite de alarma 95 °C")], "document_key string, doc_id int, text string")
    values = {(r["metric"], r["value"]) for r in insight.metrics(rows).collect()}
    assert {("temp_c", 12.0), ("temp_c", 85.0), ("rpn", 120.0), ("rpn", 240.0), ("limit_c", 95.0)} <= values
    assert {r["metric"] for r in insight.numeric_conflicts(insight.metrics(rows)).collect()} == {"temp_c", "rpn"}
    v = spark.createDataFrame([("k", "Rev 5"), ("k", "Rev 6"), ("j", "Rev 1")], "document_key string, version_label string")
    assert [r["versions"] for r in insight.version_conflicts(v).collect()] == ["Rev 5, Rev 6"]


def test_metrics_of_ranks(spark):
    judged = spark.createDataFrame([(1, 1, False), (1, 2, True)], "q_id int, rank int, relevant boolean")
    cases = spark.createDataFrame([(1,), (2,)], "q_id int")
    r = one(reports.retrieval_metrics(judged, cases))
    assert r["mrr"] == 0.25 and r["hit_rate_at_1"] == 0 and r["hit_rate_at_5"] == 0.5 and r["precision_at_5"] == 0.1
    lat = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0)], "k string, ms double")
    assert one(reports.latency(lat, "k"))["p95"] == 9.2


def test_ocr_and_drawings(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "a", "a", 0.92), (1, 1, 1, "b ", "b", 0.40)], "doc_id int, page int, block int, text_raw string, text_norm string, confidence double")
    assert {(r["rule"], r["status"]) for r in quality.block_findings(blocks).collect()} == {("block_confidence", "review"), ("raw_differs", "review")}
    files = spark.createDataFrame([("plano 1234567-12345-123AB-12345", "escala 1:50 detalle", 1, 1, 20.0), ("manual de taller", "procedimiento " * 200, 10, 0, 900.0)], "name string, text string, pages int, empty_pages int, avg_chars double")
    assert [r["kind"] for r in quality.drawing_scores(files).collect()] == ["plano", "documento"]


def test_grid_header(spark):
    rows = [(1, 0, ["Reporte", None, None]), (1, 1, ["Tag", "Valor", None]), (1, 2, ["PUMP-100", "33333", None]), (1, 3, [None, "", None]), (1, 4, ["PUMP-200", "", "extra"])]
    rows += [(2, 0, ["Grupo A", None, "Grupo B", None]), (2, 1, ["Tag", "Valor", "Tag", "Otro"]), (2, 2, ["S", "O", "D", ""]), (2, 3, ["largo uno", "v", "largo dos", ""])]
    rows += [(3, 0, ["x", None])]
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, cells array<string>")
    got = {(r["sheet_id"], r["row_no"]): r["text_line"] for r in readers.grid_records(df).collect()}
    assert got[1, 2] == "Tag: PUMP-100 | Valor: 33333 | Valor_2: null" and got[1, 4] == "Tag: PUMP-200 | Valor: null | Valor_2: extra"
    assert got[2, 3] == "Grupo A > Tag > S: largo uno | Grupo A > Valor > O: v | Grupo B > Tag > D: largo dos | Grupo B > Otro: null" and len(got) == 3
    assert {r["sheet_id"]: r["status"] for r in readers.sheet_states(df).collect()} == {1: "ok", 2: "ok", 3: "no_table"}


def test_limits_in_texts():
    text = "Bomba P-101: límite de alarma 85,5 °C. Vibración máxima 7.1 mm/s; caudal nominal 120 L/min. Presión umbral 6 bar"
    found = {(kind, value, unit, tag) for _, kind, value, unit, tag, _ in limits.limits_in(text)}
    assert {("max_temp", 85.5, "°C", "P-101"), ("generic_limit", 85.5, "°C", "P-101"), ("max_vibration", 7.1, "mm/s", "P-101"), ("nominal_flow", 120.0, "L/min", "P-101"), ("generic_limit", 6.0, "bar", None)} <= found
    assert limits.limits_in(None) == [] and len(limits.limits_in("límite 90 °C, límite 90 °C")) == 2


def test_limits_fit_units_either_way(spark):
    readings = spark.createDataFrame([(1, "A-1", "C"), (2, "A-1", ""), (3, "B-1", "kPa"), (4, "B-1", "mm / s")], "reading_id int, tag string, unit string")
    documented = spark.createDataFrame([(1, "max_temp", 9.0, "°C", None), (2, "generic_limit", 9.0, "", None), (3, "max_vibration", 9.0, "mm/s", None), (4, "max_temp", 9.0, "°C", "A-2")], "limit_id int, kind string, limit_value double, limit_unit string, limit_tag string")
    got = {r["reading_id"]: (r["limit_id"], r["match_score"]) for r in limits.match_limits(readings, documented).collect()}
    assert got == {1: (1, 2), 2: (1, 0), 3: (2, 0), 4: (3, 1)}


def test_diagnosis_cases(spark):
    readings = spark.createDataFrame([(1, 1, "TE-401", "Temp", "°C", 98.0, None), (2, 2, "FT-405", "Flow", "L/min", 50.0, 100.0)], "case_id int, reading_id int, tag string, description string, unit string, value double, nominal double")
    hits = spark.createDataFrame([(1, 10, "TE-401 límite 95 °C"), (3, 11, "no figure")], "case_id int, hit_id int, text string")
    sources = spark.createDataFrame([(10, 1, "Manual, p. 3", "d1")], "hit_id int, citation_index int, citation string, document_id string")
    got = {r["case_id"]: (r["n_facts"], r["n_exceeded"], r["n_documented"], r["label"]) for r in limits.analyze(readings, hits, sources).collect()}
    assert got == {1: (1, 1, 1, "alta"), 2: (1, 1, 0, "media"), 3: (0, 0, 0, "baja")}


def test_chunkers(spark):
    assert chunking.cut_points([10] * 10, [False] * 10, [False] * 10, 35, 0.3) == [(0, 3), (2, 5), (4, 7), (6, 9), (8, 10)]
    assert chunking.cut_points([10] * 4, [False, False, True, False], [False] * 4, 40) == [(0, 2), (2, 4)] and chunking.cut_points([], [], [], 5) == []
    long = "h1\nh2\nh3\nh4\nh5\n" + "\n\n".join(f"word{i} " * 300 for i in range(8))
    rows = [(1, 0, long, "s", False), (1, 1, "tiny", "s", False), (1, 2, "  ", "s", False), (2, 0, "peligro " * 100, None, True)]
    got = chunking.document_block_chunks(spark.createDataFrame(rows, "doc_id long, block_no int, text string, section string, whole boolean")).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in got if r["doc_id"] == 1]
    assert len(mine) == 3 and all(r["content"].startswith("h1\nh2") for r in mine) and mine[-1]["content"].endswith("tiny") and all(r["tokens"] <= 1000 for r in mine)
    assert [r["safety"] for r in got if r["doc_id"] == 2] == [True]
    many = spark.createDataFrame([(1, i, "w " * 50, "s", True) for i in range(400)], "doc_id long, block_no int, text string, section string, whole boolean")
    assert max(r["tokens"] for r in chunking.block_chunks(many, 4, 60, 500).collect()) <= chunking.MOST
    sheets = spark.createDataFrame([(1, s, i, "cell " * 50) for s in ("a", "b") for i in range(10)], "doc_id long, sheet string, row_no int, text_line string")
    assert [(r["section"], r["tokens"]) for r in chunking.chunk_any(".xlsx", sheets).orderBy("chunk_index").collect()] == [("a", 350), ("a", 150), ("b", 350), ("b", 150)]
    slides = spark.createDataFrame([(1, 1, "T", "S", "n", ["a", "b"]), (1, 2, "U", "S", None, ["x " * 300, "y " * 300])], "doc_id long, slide int, title string, section string, notes string, elements array<string>")
    texts = [r["text"] for r in chunking.slide_context(slides).orderBy("block_no").collect()]
    assert texts[0] == "S | Slide 1: T\na\nb\nNotas: n" and len(texts) == 3
    blocks = spark.createDataFrame([(1, 0, "paragraph", "A", "One two. " * 300), (1, 1, "table", "A", "x")], "doc_id long, block_no int, kind string, section string, text string")
    assert chunking.block_context(blocks).count() == 301


def test_recognised_text(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "see PMP-2040 and ifc_12 IFC 1234 on 12/03/2021 at 3,5 bar", "IFC1234", 0.8), (1, 1, 1, "PMP-2040 99 rpm", "", None)], "doc_id int, page int, block int, text string, document_key string, confidence double")
    catalog = spark.createDataFrame([("pmp-2040", True), ("OLD-11", False)], "tag string, current boolean")
    assert {(r["block"], r["value"], r["status"]) for r in ocr.tag_findings(blocks, catalog).collect()} == {(0, "PMP-2040", "review"), (1, "PMP-2040", "pass")}
    assert {(r["block"], r["rule"], r["value"], r["status"]) for r in ocr.field_findings(blocks).collect()} == {(0, "date_field", "12/03/2021", "review"), (0, "unit_field", "3,5 bar", "review"), (1, "unit_field", "99 rpm", "pass")}


def test_asset_tables(spark):
    m = spark.createDataFrame([(1, "C:/A/x.pdf", "x", "native_pdf", None), (2, "C:/A/y.docx", "y", "structured_docx", None), (3, "C:/A/z.docx", "z", "structured_docx", None)], "file_id int, path string, slug string, stage string, included boolean")
    x = spark.createDataFrame([("c:\\a\\Y.docx", None, "reject", "pass"), (None, "z", "review", None)], "path string, slug string, quality string, quality_override string")
    assert {r["file_id"] for r in assets.indexable(assets.with_extract(m, x)).collect()} == {1, 2}
    old = spark.createDataFrame([("a", "ok", 1), ("b", "ok", 2)], "name string, state string, seq int")
    new = spark.createDataFrame([("b", "error", 0)], "name string, state string, seq int")
    assert {r["name"]: r["state"] for r in assets.later_wins(old, new, "name").collect()} == {"a": "ok", "b": "error"}
    assert {r["name"]: r["state"] for r in assets.reconcile(old, new).collect()} == {"a": "ok", "b": "error"}


def test_answers(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "none")], "q_id int, q_text string")
    hits = spark.createDataFrame([(1, 10, 0.9, "text one", "", "T"), (1, 11, 0.5, "text two", "cited", "U")], "q_id int, hit_id long, score double, content string, citation string, title string")
    got = {r["q_id"]: r for r in answers.ask(queries, hits).collect()}
    assert got[1]["cited"] == [1, 2] and got[2]["answer"] == answers.NO_EVIDENCE and got[2]["cited"] == []
    told = answers.ask(queries, hits, lambda q, e: e.map(lambda t: "see [2] and [9]"))
    refs = answers.references(told, hits)
    assert [(r["nth"], r["hit_id"]) for r in refs.collect()] == [(2, 11)]
    assert '"index":2' in one(answers.payload(told, refs).where("q_id = 1"))["payload"]


def test_rerank_boosts(spark):
    df = spark.createDataFrame([("mantenimiento bomba TE-401 aceite", "Mantenimiento de bombas, aceite", "TE-401 text", ["te-401"])], "q string, title string, content string, codes array<string>")
    r = one(df.select(retrieval.title_boost(T.tokenize(F.col("q")), F.col("title")).alias("t"), retrieval.tag_boost(F.col("q"), F.col("title"), F.col("content"), F.lit(""), F.col("codes")).alias("g")))
    assert r["t"] == 0.1 and round(r["g"], 6) == 0.4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"files": [{"id": "1", "name": "a.pdf", "extension": ".pdf"}, {"id": "2", "name": "b.xyz"}]}')
    m = readers.manifest(spark, str(tmp_path / "m.json"))
    types = readers.file_types(spark)
    assert {r["name"]: r["state"] for r in m.join(types, "extension", "left").collect()} == {"a.pdf": "ready", "b.xyz": None}
    found = readers.binary_files(spark, str(tmp_path), "*.json")
    parsed = readers.extract_with(found, lambda path, data: [{"text": data.decode()[:5], "page": 1}])
    assert [r["text"] for r in parsed.collect()] == ['{"fil']
    assert readers.not_extracted(found, found.limit(0)).count() == 1 and readers.directory(spark, str(tmp_path)).count() == 1
    log = spark.createDataFrame([("l", 1, "done 3 of 9"), ("l", 2, "done 5 of 9"), ("l", 3, "noise")], "source string, line_no int, line string")
    assert one(readers.log_progress(log, r"done (\d+) of (\d+)", ["done", "total"]))["done"] == "5"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    out = str(tmp_path / "t")
    sinks.append(rows, out, ["k"])
    sinks.overwrite_keys(rows.where("k = 'a'").withColumn("v", F.lit(9)), out, ["k"])
    assert {r["k"]: r["v"] for r in spark.read.parquet(out).collect()} == {"a": 9, "b": 2}


def test_stream_batches_are_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "h1"), (2, "h2")], "id int, k string").write.parquet(src)
    for _ in range(2):
        stream = streams.read_folder(spark, src, "*.parquet", "id int, k string")
        streams.run_available(stream, lambda df, n: sinks.overwrite_keys(df, out, ["k"]), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 2
    rows = spark.createDataFrame([(1, 0, 0), (2, 3, 1), (3, 3, 3)], "id int, chunks int, points int")
    assert [r["resume_at"] for r in streams.resume_stage(rows).orderBy("id").collect()] == ["extract", "embed", "validate_index"]


@pytest.mark.parametrize("k", [1, 3])
def test_fusion_keeps_one_sided_hits(spark, k):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q_id int, doc_id int, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.rrf(a, b, k).collect()}
    assert got == {10: round(1 / (k + 1), 9), 11: round(1 / (k + 2) + 1 / (k + 1), 9)}
    assert retrieval.rrf(a, b.limit(0), k).count() == 2


def test_tables_boxes_and_relevance(spark):
    df = spark.createDataFrame([(["a", "b"], [["1", "x|y"], [None, "2"]], [3.0, 9.0, 1.0, 4.0], 'so ```json {"k": {"v": 1}} ``` end', "GUIGS-4 bomba.pdf")], "h array<string>, r array<array<string>>, p array<double>, j string, n string")
    r = one(df.select(T.markdown_table(F.col("h"), F.col("r")).alias("m"), T.bounding_box(F.col("p")).alias("b"), T.json_block(F.col("j")).alias("j"), T.suggest_kind(F.col("n"), F.lit(".pdf")).alias("k"), T.human_tokens(F.lit(1500)).alias("t"), T.human_size(F.lit(2048)).alias("s")))
    assert r["m"] == "| a | b |\n| --- | --- |\n| 1 | x/y |\n|  | 2 |" and tuple(r["b"]) == (1.0, 4.0, 3.0, 9.0)
    assert r["j"] == '{"k": {"v": 1}}' and r["k"] == "guia" and r["t"] == "1.5k" and r["s"] == "2.0 KB"
    rows = [("sop", "Bomba P-1", "limite 95", None, ["bomba"], None, None, True), ("sop", "Bomba", "x", "guia", ["bomba"], None, None, False), ("sop", "a", "x", None, None, ["y"], None, False), ("sop", "a", "x", "sop", None, None, ["q"], False), ("sop", "a", "x", None, None, None, None, False)]
    cases = spark.createDataFrame(rows, "kind string, title string, content string, want string, ti array<string>, co array<string>, kw array<string>, expect boolean")
    assert all(r["got"] == r["expect"] for r in cases.withColumn("got", T.is_relevant(*[F.col(c) for c in ("kind", "title", "content", "want", "ti", "co", "kw")])).collect())
