"""Heading paths, parsers and chunkers as table functions."""

import random

from pyspark.sql import functions as F

from doclattice.functions import tables
from doclattice.operators import chunking
from doclattice.plans import formats

SF = "/root/testdata/sf0.001"


def test_heading_paths_equal_a_stack(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for doc in range(12):
        stack = []
        for i in range(60):
            level = rng.choice([None, None, 1, 2, 3, 4, 9, 12])
            if level is not None:
                deep = min(level, chunking.LEVELS)
                stack = [*stack[: deep - 1], f"h{i}"]
            rows.append((doc, i, "paragraph" if level is None else "heading", level, f"h{i}"))
            want[doc, i] = " | ".join(stack)
    rng.shuffle(rows)
    got = chunking.heading_paths(spark.createDataFrame(rows, "doc_id long, block_no long, kind string, level int, text string")).collect()
    assert {(r["doc_id"], r["block_no"]): r["section"] for r in got} == want


def test_table_function_cuts_like_the_chunkers(spark):
    got = {}
    for r in formats.chunks_by_format(spark, SF).collect():
        got.setdefault(r["doc_id"] % 4, set()).add((r["doc_id"] // 4, r["chunk_index"], r["content"], r["tokens"], r["section"]))
    rows = formats.mixed_rows(spark, SF).withColumn("own", F.floor(F.col("doc_id") / 4)).where("doc_id % 4 = {i}".format(i=1))
    plain = lambda df: {(r["doc_id"], r["chunk_index"], r["content"], r["tokens"], r["section"]) for r in df.collect()}
    assert got[0] == plain(chunking.chunk(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got[1] == plain(chunking.slide_chunks(rows.select(F.col("own").alias("doc_id"), F.col("seq").alias("block_no"), "text", "section", F.col("mark").alias("whole"))))
    assert got[2] == plain(chunking.document_block_chunks(chunking.document_blocks(chunking.heading_paths(formats.page_blocks(spark, SF)))))
    assert {len(got[i]) > 0 for i in range(4)} == {True}


def test_parsers_by_extension(spark):
    tables.register_parsers(spark, {".txt": lambda path, content: [{"text": line} for line in content.decode().splitlines()], ".bad": lambda path, content: []}, "parse_small")
    spark.createDataFrame([("a.TXT", b"one\ntwo"), ("b.bad", b"x"), ("c.pdf", b"x"), ("d.txt", None), (None, b"x")], "path string, content binary").createOrReplaceTempView("small_files")
    rows = spark.sql("SELECT path, b.block_no, b.text, b.needs_ocr FROM small_files, LATERAL parse_small(path, content) b").collect()
    assert [tuple(r) for r in rows] == [("a.TXT", 0, "one", False), ("a.TXT", 1, "two", False)]


def test_oversize_texts_keep_paragraphs():
    count = lambda t: len(t.split())
    text = "a b c\n\nd e\n\n" + "One two three. Four five six. " + "long " * 9 + "\n\nz"
    parts = chunking.split_oversize(text, 5, count)
    assert parts[0] == "a b c\n\nd e" and all(count(p) <= 5 for p in parts)
    assert " ".join(" ".join(parts).split()) == " ".join(text.split())
    assert chunking.split_oversize("x" * 30, 8, len) == ["x" * 8] * 3 + ["x" * 6]
