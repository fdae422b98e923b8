"""Token-ID output: every text is encoded and written as wavelet-matrix shards in ascending doc_id order.

Documents are range-partitioned by (doc_id, text hash) and sorted, so that partition, shard and
row order give the order of all documents. A task encodes its documents with a tokenizer of the
``tokenizers`` library and closes a shard after the document that brings it to
``shard_tokens`` ids. A shard is one self-contained file: document ids and lengths, the compressed
bit planes of the wavelet matrix, and their rank directory, so that access, count and occurrence lookup
(``WaveletMatrix``) need nothing else. The files are the ``file`` column of a Parquet table in the shared folder, which
also names partition, shard and sizes: billions of small objects would not serve a store. Task retries are safe, as Spark commits
each partition's file once. Reading back takes all positions of a shard at once, plane by plane (``decode``).

``by_word=True`` encodes each distinct word's letters once per worker. It holds for tokenizers whose
pre-tokenizer cuts at every ASCII blank and between letters or digits and signs, and whose normaliser is NFC and
lower case, as for word_bpe_49k; other tokenizers take ``by_word=False``.

Edge cases: null text counts as empty and gives the end id alone; a repeated doc_id gives a
row for each, ordered by text hash; a null doc_id comes first; one very long document makes one
longer shard; empty input writes no shard and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_batches, stash, text_of
from .wavelet import WaveletMatrix

SHARDS = "part int, shard int, n_tokens long, n_docs long, file binary"
MAGIC = b"TSH1"
_tokenizers: dict = {}


SIGNS = ".,;:!?()[]{}\"*-#$%&+=/@~"  # end a word's letters in every pre-tokenizer that cuts between letters and signs


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at starts, one after another."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values[np.repeat((starts - np.cumsum(sizes) + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)]


class WordEncoder:
    """ids of texts, with a bounded memory of parts of words already encoded.

    A word of Latin letters between signs is cut into signs, letters and signs, as the pre-tokenizer does. The letters go straight to the
    tokenizer's model in lower case, as normaliser and pre-tokenizer leave them whole; signs and other words, uncut, take the full path.
    """

    def __init__(self, path: str, by_word: bool, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.by_word, self.limit = Tokenizer.from_file(path), by_word, limit
        letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) == chr(c).lower() and c not in (0xAA, 0xB5, 0xBA)]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self.letters = re.compile(f"[{''.join(letters)}]+").fullmatch
        signs = f"[{re.escape(SIGNS)}]{{0,8}}"
        self.plain = f"^{signs}[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+{signs}$"
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.first, self.ids = array("q", [0, 0]), array("I")

    def rows(self, parts: pa.Array) -> np.ndarray:
        """Where the parts' ids are; new parts are encoded and remembered."""
        parts = parts.dictionary_encode()
        values, known = parts.dictionary.to_pylist(), self.known
        new = [w for w in values if w not in known]
        if new:
            tokenize, letters, table, ids, first = self.tokenizer.model.tokenize, self.letters, self.table, self.ids, self.first
            other = [w for w in new if not letters(w)]
            slow = dict(zip(other, (e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False)), strict=True))
            for w in new:
                ids.extend(slow[w] if w in slow else [t.id for t in tokenize(w if w.isascii() else w.translate(table))])
                first.append(len(ids))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        row = np.fromiter(map(known.__getitem__, values), np.int64, len(values))
        return row[parts.indices.to_numpy(zero_copy_only=False)] if len(values) else row

    def cut(self, words: pa.Array) -> np.ndarray:
        """(words, 3) rows of the parts of distinct words."""
        plain = pc.match_substring_regex(words, self.plain)
        out = np.zeros((len(words), 3), np.int64)
        out[:, 1] = self.rows(pc.if_else(plain, pc.utf8_lower(pc.utf8_trim(words, SIGNS)), words))
        whole, plain = pc.binary_length(words).to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)
        for column, trim in ((0, pc.utf8_ltrim), (2, pc.utf8_rtrim)):
            n = np.where(plain, whole - pc.binary_length(trim(words, SIGNS)).to_numpy(zero_copy_only=False), 0)
            for k in range(1, int(n.max(initial=0)) + 1):
                some = words.filter(pa.array(n == k))
                out[n == k, column] = self.rows(pc.utf8_slice_codeunits(some, -k) if column else pc.utf8_slice_codeunits(some, 0, k))
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and the number of ids of each text."""
        if not self.by_word:
            each = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        if len(self.known) > self.limit:
            self.clear()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        parts = self.cut(words.dictionary)
        first, ids = np.array(self.first, np.int64), np.array(self.ids, np.uint32)
        size = np.diff(first)[parts]
        vocabulary = np.append(_gather(ids, first[parts].ravel(), size.ravel()), np.uint32(end_id))
        size = np.append(size.sum(axis=1), 1)  # the end id is the last word
        offsets = np.asarray(lists.offsets)
        ends = (offsets[1:] - offsets[0]).astype(np.int64) + np.arange(len(texts))
        mask = np.ones(len(words) + len(texts), bool)
        mask[ends] = False
        word = np.full(len(mask), len(parts), np.int64)
        word[mask] = words.indices.to_numpy(zero_copy_only=False)
        sizes = size[word]
        return _gather(vocabulary, (np.cumsum(size) - size)[word], sizes), np.diff(np.cumsum(sizes)[ends], prepend=0)


def _encoder(path: str, by_word: bool) -> WordEncoder:
    if (path, by_word) not in _tokenizers:
        _tokenizers[path, by_word] = WordEncoder(path, by_word)
    return _tokenizers[path, by_word]


def pack_shard(doc_ids: pa.Array, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """One self-contained shard file: the documents' ids and lengths, then the matrix with its rank directory."""
    known = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    parts = [pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known.tobytes(), lengths.astype("<u8").tobytes()]
    index = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
    return MAGIC + struct.pack("<QQ", len(lengths), len(index)) + index + matrix.to_bytes()


def unpack_shard(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Document ids, their numbers of tokens, and the matrix of a shard file."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, size = struct.unpack_from("<QQ", data, 4)
    index = zstandard.ZstdDecompressor().decompress(data[20 : 20 + size])
    ids, known, lengths = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n), np.frombuffer(index, "<u8", n, 9 * n)
    return pa.array(ids, mask=known == 0), lengths.astype(np.int64), WaveletMatrix.from_bytes(data[20 + size :])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: int = 16, by_word: bool = True, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the shards, and return the table read back from its files."""
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = _encoder(tokenizer, by_word), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            file = pack_shard(pa.concat_arrays([h[0] for h in held]), lengths, WaveletMatrix.build(ids, bits))
            row = [part, shard, len(ids), len(lengths), file]
            shard, held = shard + 1, []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["part", "shard", "n_tokens", "n_docs", "file"])

        for batch in batches:
            ids, lengths = coder.encode(batch.column(1), end_id)
            ends, at, done = np.cumsum(lengths), 0, 0
            while at < len(lengths):
                room = shard_tokens - sum(len(h[1]) for h in held)
                stop = min(int(np.searchsorted(ends, done + room)) + 1, len(lengths))
                held.append((batch.column(0).slice(at, stop - at), ids[done : ends[stop - 1]], lengths[at:stop]))
                at, done = stop, int(ends[stop - 1])
                if sum(len(h[1]) for h in held) >= shard_tokens:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return stash(ordered.mapInArrow(encode, SHARDS), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written matrices."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, lengths, matrix = unpack_shard(row["file"])
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "part", "shard", "within", "n_tokens", "ids_crc32"])

    small_batches(shards.sparkSession)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_n")).select("part", (F.sum("part_n").over(Window.orderBy("part")) - F.col("part_n")).alias("part_start"))
    starts = shards.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("shard_start")).join(totals, "part")
    docs = shards.select("part", "shard", "file").mapInArrow(decode, "doc_id long, part int, shard int, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer, **options))
