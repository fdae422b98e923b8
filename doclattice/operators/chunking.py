"""Cutting documents into chunks: segments with carried sections, the greedy fold, section aggregation.

The fold is not associative, so it runs through each document's sorted rows (``mapInPandas``); all else is Column work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Target tokens by document type, overlap, and the least and greatest chunk.
TARGETS = {"norma": 900, "guia": 900, "manual_oem": 900, "sop": 550, "tabla": 350, "presentacion": 500, "plano": 600, "otro": 800}
OVERLAP, LEAST, MOST = 0.10, 60, 8000
HEADING = r"^\s*(\d+(?:\.\d+){0,3})\.?\s+([A-ZÁÉÍÓÚÑ][^\n]{3,70}?)\s*$"
SENTENCE = r"(?<=[.!?])\s+"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of all non-blank lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def segments(docs: DataFrame) -> DataFrame:
    """Headings and sentences in order, each with the section it stands in: doc_id, line_no, part, segment, is_heading, section."""
    rows = lines(docs).withColumn("is_heading", F.col("line").rlike(HEADING))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.last(F.when(F.col("is_heading"), F.regexp_replace(F.col("line"), HEADING, "$1 $2")), ignorenulls=True).over(w))
    parts = F.when(F.col("is_heading"), F.array("line")).otherwise(F.split("line", SENTENCE))
    return rows.select("doc_id", "line_no", "is_heading", "section", F.posexplode(parts).alias("part", "segment")).where("segment <> ''")


CHUNKS = "doc_id long, chunk_index int, content string, tokens int, section string, safety boolean"


def count_tokens(text: str) -> int:
    return len(re.findall(r"\w+|[^\w\s]", text))


def cut_points(sizes: list[int], starts: list[bool], glued: list[bool], target: int, overlap: float = 0.0, least: int = 0) -> list[tuple[int, int]]:
    """Ranges [a, b) of parts that make the chunks.

    A chunk ends before a part that would bring it over the target, or before one that starts a topic once it is half full; never before a
    glued part. The next begins with the longest tail of it that fits ``overlap`` of the target. A range under ``least`` joins the one before.
    """
    total = [0, *accumulate(sizes)]
    free = [i for i in range(len(sizes)) if not glued[i]]
    ranges, a, new = [], 0, 0
    for i in free[1:]:
        full = total[i] - total[a]
        if i > new and (full + sizes[i] > target or starts[i] and 2 * full >= target):
            ranges.append((a, i))
            a, new = bisect_left(total, total[i] - overlap * target, 0, i), i
    ranges += [(a, len(sizes))] if sizes else []
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and total[b] - total[a] < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def fold(rows: list[tuple[str, bool, bool, str | None]], target: int, count=count_tokens) -> list[tuple[str, int, str | None, bool]]:
    """Chunks (text, tokens, section, safety) of (segment, is_heading, is_safety, section): a safety sentence keeps the sentence that follows."""
    sizes, heads = [count(r[0]) for r in rows], [r[1] for r in rows]
    glued = [False] * len(rows)
    for i in range(1, len(rows)):
        glued[i] = rows[i - 1][2] and not glued[i - 1] and not heads[i]
    out = []
    for a, b in cut_points(sizes, heads, glued, target, OVERLAP, LEAST):
        part = rows[a:b]
        out.append((" ".join(r[0] for r in part), sum(sizes[a:b]), next((r[3] for r in reversed(part) if r[3]), None), any(r[2] for r in part)))
    return out


def split_oversize(text: str, most: int = MOST, count=count_tokens) -> list[str]:
    """Parts of at most ``most`` tokens, in order: whole paragraphs with the empty lines between them; of longer paragraphs whole sentences; of longer sentences slices of words."""
    if count(text) <= most:
        return [text]
    units: list[tuple[str, str, int]] = []  # text, what stands before it in a part, tokens
    for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
        whole = count(paragraph) <= most
        for i, sentence in enumerate([paragraph] if whole else filter(None, (x.strip() for x in re.split(SENTENCE, paragraph)))):
            words = [sentence] if whole or count(sentence) <= most else _slices(sentence, most, count)
            units += [(w, " " if i or j else "\n\n", count(w)) for j, w in enumerate(words)]
    sizes = [n for _, _, n in units]
    none = [False] * len(units)
    parts = [units[a:b] for a, b in cut_points(sizes, none, none, most)]
    return ["".join(x if k == 0 else gap + x for k, (x, gap, _) in enumerate(part)) for part in parts] or [text]


def _slices(sentence: str, most: int, count) -> list[str]:
    """Words in runs of at most ``most`` tokens; a longer word is cut by characters, as a character is a token at most."""
    words = [w[i : i + most] for w in sentence.split() for i in range(0, len(w), most if count(w) > most else len(w))]
    none = [False] * len(words)
    return [" ".join(words[a:b]) for a, b in cut_points([count(w) for w in words], none, none, most)]


def per_document(rows: DataFrame, order: list[str], made: Callable[[int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """made(doc_id, its rows in order) over every document; the first column is doc_id. One document is held at a time."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for pdf in batches:  # a document's rows follow each other, over batches too
            out = []
            for doc_id, *row in pdf.itertuples(index=False, name=None):
                if doc_id != last and held:
                    out += made(last, held)
                    held = []
                last = doc_id
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(made(last, held), columns=names)

    kept = [c for c in rows.columns if c not in order or c == "doc_id"]
    return rows.where("doc_id IS NOT NULL").repartition("doc_id").sortWithinPartitions("doc_id", *order).select("doc_id", *[c for c in kept if c != "doc_id"]).mapInPandas(run, schema)


def chunk(docs: DataFrame, kind: str = "otro") -> DataFrame:
    """Chunks of (doc_id, text) by the greedy fold, none over the greatest size."""
    return fold_segments(segments(docs), F.lit(kind))


def numbered(doc_id: int, chunks: list[tuple]) -> list[tuple]:
    return [(doc_id, i, *c) for i, c in enumerate(chunks)]


def segment_chunks(rows: list[tuple], target: int) -> list[tuple]:
    """(content, tokens, section, safety) of one document's segments (segment, is_heading, is_safety, section)."""
    return [(c, count_tokens(c), s, bool(f)) for text, _, s, f in fold(rows, target) for c in split_oversize(text)]


def fold_segments(rows: DataFrame, kind: Column) -> DataFrame:
    """Chunks of ``segments``; ``kind`` is the document type that sets the target of a document's chunks."""
    from ..functions.text import is_safety, looked_up

    def made(doc_id: int, rows: list[tuple]) -> list[tuple]:
        return numbered(doc_id, segment_chunks([r[:-1] for r in rows], rows[0][-1]))

    target = F.coalesce(looked_up(kind, TARGETS), F.lit(TARGETS["otro"]))
    rows = rows.withColumns({"safety": is_safety(F.col("segment")), "target": target})
    return per_document(rows.select("doc_id", "line_no", "part", "segment", "is_heading", "safety", "section", "target"), ["line_no", "part"], made, CHUNKS)


def sheet_line_chunks(rows: list[tuple], target: int) -> list[tuple]:
    """(content, tokens, section, safety) of one document's lines (sheet, text) in order: greedily up to the target, of one sheet each."""
    out = []
    for sheet, group in groupby(rows, key=lambda r: r[0]):
        texts = [r[1] for r in group]
        whole = "\n".join(texts)
        if (n := count_tokens(whole)) <= target:  # no token goes over a line's end
            out.append((whole, n, sheet, False))
            continue
        none = [False] * len(texts)
        for a, b in cut_points([count_tokens(t) for t in texts], none, none, target):
            text = "\n".join(texts[a:b])
            out.append((text, count_tokens(text), sheet, False))
    return out


def sheet_chunks(rows: DataFrame, kind: str = "tabla") -> DataFrame:
    """Rows of sheets (doc_id, sheet, row_no, text_line), greedily up to the target; a chunk holds rows of one sheet, which is its section."""
    target = TARGETS[kind]
    ordered = rows.select("doc_id", F.col("sheet").alias("by"), "row_no", F.col("text_line").alias("tie"), "sheet", "text_line")
    return per_document(ordered, ["by", "row_no", "tie"], lambda doc_id, lines_: numbered(doc_id, sheet_line_chunks(lines_, target)), CHUNKS)


def split_block(text: str, header_lines: int, target: int, count=count_tokens) -> list[str]:
    """A block over the target: groups of its paragraphs up to the target, each under its first lines."""
    if count(text) <= target:
        return [text]
    rows = text.split("\n")
    head, paragraphs = "\n".join(rows[:header_lines]), [p.strip() for p in "\n".join(rows[header_lines:]).split("\n\n") if p.strip()]
    none = [False] * len(paragraphs)
    return [f"{head}\n\n" + "\n\n".join(paragraphs[a:b]) for a, b in cut_points([count(p) for p in paragraphs], none, none, target)] or [text]


def block_piece_chunks(rows: list[tuple], header_lines: int, least: int, target: int, most: int = MOST, count=count_tokens) -> list[tuple]:
    """(content, tokens, section) of one document's blocks (text, section, whole) in order."""
    out: list[list] = []
    for text, section, whole in rows:
        if not text or not text.strip():
            continue
        for piece in [text] if whole and count(text) <= most else split_block(text, header_lines, target, count):
            n = count(piece)
            if out and n < least and out[-1][1] + n <= most:
                out[-1][0] += "\n\n" + piece
                out[-1][1] = count(out[-1][0])
            else:
                out += [[part, count(part), section] for part in split_oversize(piece, most, count)]
    return [tuple(x) for x in out]


def block_chunks(blocks: DataFrame, header_lines: int, least: int, target: int, most: int = MOST, count=count_tokens) -> DataFrame:
    """Chunks of document or slide blocks (doc_id, block_no, text, section, whole): a block is one chunk if it fits the target, or is ``whole`` and fits
    ``most``; longer ones are split with their header repeated. A chunk under ``least`` tokens joins the one before while that stays within ``most``."""
    from ..functions.text import is_safety

    made = lambda doc_id, rows: numbered(doc_id, [(*c, False) for c in block_piece_chunks(rows, header_lines, least, target, most, count)])
    chunks = per_document(blocks.select("doc_id", "block_no", "text", "section", "whole"), ["block_no"], made, CHUNKS)
    return chunks.withColumn("safety", is_safety(F.col("content")))


LEVELS = 9


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_no, kind, level, text) with ``section``: the headings they stand under, "A | B".

    A heading of level n stands n deep, or one deeper than the heading before it if that is less deep: its depth is i + the least of (level of heading j - j)
    over the headings up to it, the i-th. A block stands under the last heading of each depth down to that of the last heading; levels go to ``LEVELS``."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = (F.col("kind") == "heading") & F.col("level").isNotNull()
    nth = F.count(F.when(head, 1)).over(w)
    rows = blocks.withColumns({"_i": nth, "_head": F.coalesce(head, F.lit(False))})
    least = F.min(F.when(F.col("_head"), F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.col("level"))) - F.col("_i"))).over(w)
    rows = rows.withColumn("_depth", F.when(F.col("_head"), F.col("_i") + F.least(F.lit(0), least)))
    stands = F.coalesce(F.last("_depth", ignorenulls=True).over(w), F.lit(0))
    last = [F.when(stands >= d, F.last(F.when(F.col("_depth") == d, F.col("text")), ignorenulls=True).over(w)) for d in range(1, LEVELS + 1)]
    return rows.withColumn("section", F.concat_ws(" | ", *last)).drop("_i", "_head", "_depth")


def document_blocks(blocks: DataFrame, least_blocks: int = 3) -> DataFrame:
    """The context blocks of a document and, after them, the text of each of its sections that has so many blocks: what is cut into chunks."""
    own = block_context(blocks)
    rows = section_text(blocks, least_blocks)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))
    return own.unionByName(rows.select("doc_id", (nth + F.lit(1 << 40)).alias("block_no"), F.concat("section", F.lit("\n"), "content").alias("text"), "section", F.lit(True).alias("whole")))


def document_block_chunks(blocks: DataFrame, kind: str = "guia") -> DataFrame:
    return block_chunks(blocks, 5, 60, TARGETS[kind])


def slide_chunks(blocks: DataFrame) -> DataFrame:
    return block_chunks(blocks, 4, 40, TARGETS["presentacion"])


def slide_context(slides: DataFrame, dense: int = 450) -> DataFrame:
    """Blocks of slides (doc_id, slide, title, section, notes, elements array<string>): one text each, or one for each element of a dense slide; section path "section | Slide n: title"."""
    from ..functions.text import count_pieces

    title = F.concat(F.lit("Slide "), F.col("slide").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")))
    path = F.concat_ws(" | ", F.nullif("section", F.lit("")), title)
    body = F.array_join(F.filter("elements", lambda e: F.trim(e) != ""), "\n")
    rows = slides.withColumns({"section": path, "body": body, "n": count_pieces(body)})
    notes = F.when(F.coalesce(F.trim("notes"), F.lit("")) != "", F.concat(F.lit("\nNotas: "), "notes")).otherwise("")
    texts = F.when(F.col("n") <= dense, F.array(F.concat(F.col("section"), F.lit("\n"), F.col("body"), notes))).otherwise(F.transform(F.filter("elements", lambda e: F.trim(e) != ""), lambda e: F.concat(F.col("section"), F.lit("\n"), e)))
    return rows.select("doc_id", "slide", "section", F.posexplode(texts).alias("part", "text")).select("doc_id", (F.col("slide") * 10_000 + F.col("part")).alias("block_no"), "text", "section", F.lit(False).alias("whole"))


def block_context(blocks: DataFrame, dense: int = 450) -> DataFrame:
    """Blocks of documents (doc_id, block_no, kind, section, text): path and text as one, dense paragraphs by sentence."""
    from ..functions.text import count_pieces

    head = F.concat(F.coalesce(F.nullif("section", F.lit("")), F.lit("Documento")), F.lit(" | "), "kind")
    parts = F.when((F.col("kind") == "paragraph") & (count_pieces(F.col("text")) > dense), F.filter(F.split("text", SENTENCE), lambda x: F.trim(x) != "")).otherwise(F.array("text"))
    rows = blocks.select("doc_id", "block_no", "section", "kind", head.alias("head"), F.posexplode(parts).alias("part", "x"))
    return rows.select("doc_id", (F.col("block_no") * 10_000 + F.col("part")).alias("block_no"), F.concat("head", F.lit("\n"), "x").alias("text"), "section", (F.col("kind") != "paragraph").alias("whole"))


def ocr_chunks(blocks: DataFrame, pages: DataFrame, name: str, least: float = 0.60) -> DataFrame:
    """Chunks of recognised pages: blocks (doc_id, page, block_no, kind, text, confidence), pages (doc_id, page, status). Two lines or more of a page make one paragraph; rejected
    pages, blank and doubtful blocks are left out; a header tells document, page, region and confidence."""
    from ..functions.text import asset_tags

    kept = blocks.join(pages.where("status <> 'reject'").select("doc_id", "page"), ["doc_id", "page"], "left_semi").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    lines_ = kept.where("kind = 'line'").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    joined = F.array_join(F.transform(F.filter("b", lambda x: x["text"] != ""), lambda x: x["text"]), " ")
    merged = lines_.select("doc_id", "page", F.when(F.col("n") > 1, 0).otherwise(F.col("b")[0]["block_no"]).alias("block_no"), F.when(F.col("n") > 1, "paragraph").otherwise("line").alias("kind"), joined.alias("text"), F.col("c").alias("confidence"))
    every = merged.unionByName(kept.where("kind <> 'line'").select(*merged.columns)).where((F.col("text") != "") & (F.col("confidence").isNull() | (F.col("confidence") >= least)))
    region = F.concat(F.when(F.col("kind") == "table", "tabla t").otherwise("bloque b"), F.col("block_no").cast("string"))
    tags = asset_tags(F.col("text"))
    head = F.concat_ws(" | ", F.concat(F.lit("Documento: "), F.col(name).cast("string")), F.concat(F.lit("Página "), F.col("page").cast("string")), F.concat(F.lit("Región: "), region), F.when(F.size(tags) > 0, F.concat(F.lit("Activo: "), F.array_join(F.slice(tags, 1, 3), ", "))), F.concat(F.lit("Confianza bloque: "), F.coalesce(F.format_string("%.2f", F.col("confidence").cast("double")), F.lit("?"))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_no", "kind")) - 1
    return every.select("doc_id", nth.alias("chunk_index"), F.concat(head, F.lit("\n\n"), "text").alias("content"), "page", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("/b"), F.col("block_no").cast("string")).alias("section"))


CHUNKERS = {"pdf": chunk, "xlsx": sheet_chunks, "docx": document_block_chunks, "pptx": slide_chunks}


def chunk_any(extension: str, rows: DataFrame) -> DataFrame:
    return CHUNKERS[extension.lower().lstrip(".")](rows)


def beside(rows: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Rows with the column's value before and after them in their group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumns({"before": F.lag(column).over(w), "after": F.lead(column).over(w)})


def section_text(blocks: DataFrame, least_blocks: int) -> DataFrame:
    """Ordered text of every section (doc_id, section) with at least so many blocks."""
    grouped = blocks.groupBy("doc_id", "section").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b"))
    return grouped.where(F.col("n_blocks") >= least_blocks).select("doc_id", "section", "n_blocks", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("content"))
