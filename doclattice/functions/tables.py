"""Table functions for SQL: parsers as ports, and the chunkers of all formats over rows of a document in order."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..operators import chunking

BLOCKS = "block_no int, text string, page int, sheet string, section string, needs_ocr boolean"


def register_parsers(spark: SparkSession, parsers: dict[str, Callable[[str, bytes], list[dict]]], name: str = "parse_blocks") -> None:
    """``SELECT ... FROM files, LATERAL parse_blocks(path, content)``: the blocks of a file by the parser of its extension; a file without one, or without content, has none.
    Files are listed and read by Spark; a parser gets path and bytes and gives dicts."""
    table = {k.lower(): v for k, v in parsers.items()}

    class ParseBlocks:
        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            parse = next((f for ext, f in table.items() if path and path.lower().endswith(ext)), None)
            for i, b in enumerate(parse(path, bytes(content)) if parse and content is not None else []):
                row = {"text": "", "page": 0, "sheet": None, "section": None, "needs_ocr": False, **b}
                yield i, row["text"], row["page"], row["sheet"], row["section"], row["needs_ocr"]

    spark.udtf.register(name, udtf(ParseBlocks, returnType=BLOCKS, useArrow=True))


#: Header lines, least tokens and, where it is fixed, the document type of the formats that come as blocks.
BLOCK_FORMATS = {"docx": (5, 60, None), "pptx": (4, 40, "presentacion")}


def document_chunks(rows: list[tuple]) -> list[tuple]:
    """(content, tokens, section, safety) of one document's rows in order, (format, kind, text, section, mark, safety): segments of a pdf (mark: heading), lines of a spreadsheet (section: sheet), blocks of docx and pptx (mark: kept whole)."""
    form, kind = (rows[0][0] or "").lower().lstrip("."), rows[0][1]
    target = chunking.TARGETS.get(kind, chunking.TARGETS["otro"])
    if form == "pdf":
        return chunking.segment_chunks([(text, mark, safety, section) for _, _, text, section, mark, safety in rows], target)
    if form in ("xlsx", "xls", "csv"):
        return chunking.sheet_line_chunks([(section, text) for _, _, text, section, _, _ in rows], target)
    if form in BLOCK_FORMATS:
        head, least, fixed = BLOCK_FORMATS[form]
        return [(*c, False) for c in chunking.block_piece_chunks([(text, section, mark) for _, _, text, section, mark, _ in rows], head, least, chunking.TARGETS[fixed] if fixed else target)]
    raise ValueError(f"no chunker for {form!r}")


COLUMNS = ("doc_id", "format", "kind", "text", "section", "mark", "safety")
MADE = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("tokens", pa.int32()), ("section", pa.string()), ("safety", pa.bool_())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows that are sorted by document; a document's rows follow each other, over batches too."""
    last, held = None, []
    for batch in itertools.chain(batches, [None]):
        out: list[tuple] = []
        for doc_id, *row in [] if batch is None else zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and doc_id != last:
                out += chunking.numbered(last, document_chunks(held))
                held = []
            last = doc_id
            held.append(row)
        if batch is None and held:
            out += chunking.numbered(last, document_chunks(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MADE, strict=True)], schema=MADE)


def cut_rows(rows: DataFrame, *order: str) -> DataFrame:
    """What ``cut_chunks`` gives for ``rows`` partitioned by document and in order: a task runs through its sorted rows instead of a call for each row and document."""
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", *order).select(*COLUMNS).mapInArrow(_cut, chunking.CHUNKS)


class CutChunks:
    """The rows of one document in order, with the columns of ``COLUMNS``."""

    def __init__(self) -> None:
        self.rows: list = []

    def eval(self, row) -> None:
        self.rows.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from chunking.numbered(self.rows[0]["doc_id"], document_chunks([tuple(r[c] for c in COLUMNS[1:]) for r in self.rows]))


def register_chunkers(spark: SparkSession, name: str = "cut_chunks") -> None:
    """``SELECT * FROM cut_chunks(TABLE(...) PARTITION BY doc_id ORDER BY ...)``: the chunks of documents of any format."""
    spark.udtf.register(name, udtf(CutChunks, returnType=chunking.CHUNKS, useArrow=True))
