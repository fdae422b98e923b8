"""Language identification by prediction by partial matching (PPM).

* For each language a tree of byte contexts of up to ``ORDER`` bytes is counted over all texts of that language: in tasks,
  by strings of ORDER + 1 bytes, whose counts Spark adds up; shorter contexts' counts follow from them.
* Contexts seen often enough in some language are broadcast, for all languages and with all their symbols; the least count is the
  smallest in steps of an eighth of a doubling that keeps ``tree_room`` entries or fewer, so the broadcast has a known size, and a longer context never
  outlives its suffix. No other context is lost: a string whose longest context isn't broadcast meets the counted strings under the
  same rare context in a shuffle (``rare_costs``), where its cost comes from the whole tree, and the difference goes back to its text.
* A symbol costs -log2 of its probability in the longest context there is; a symbol not seen there costs the escape
  (method C: as many escapes as different symbols) and is looked for in the next shorter context, from which the symbols
  of the longer one are excluded. What no context knows is one of the bytes left. The statistics are frozen: scoring
  a text does not change them. The code length of a text is the exact sum over its bytes.
* The language of least code length is predicted; equal lengths go to the smaller value by code point.
  ``score`` is its share of 2 ** (-length / temper) over all languages.

Edge cases: a null text and one without any letter is ``und`` with score 0, and so is every text if no labelled text
is there to learn from; a language whose texts are all empty has no tree and is not learned; rows with a null doc_id
are predicted too; repeated rows count and are predicted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, small_batches, stash, text_arrays, tidy, tidy_group

ORDER = 5
GROUP = 4
CHUNK = 1 << 20
FLUSH = 1 << 21
FEW = 1 << 16
ENTRY_BITS = 17
BUCKET = 1 << 20
SCORED = ["row", "doc_id", "letters", "bits", "key", "first", "times"]
PLACE = f"shiftleft(shiftright(key, 8 * ({ORDER + 1} - first)), 3) | first"
STEP = 1 << 24  # differences of costs are whole numbers of 1 / STEP bits, so that their sums don't depend on order


def tree_room(n_bytes: int) -> int:
    """Entries broadcast of all trees together: 2**17 for each doubling of the labelled text, 20 times 2**17 up to 1 MB."""
    return max(20, int(math.log2(max(2, n_bytes)))) << ENTRY_BITS


def byte_strings(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of the bytes: the first document, each byte's document from there, and a number of the ``order`` bytes before it,
    the nearest first, and the byte itself; zero bytes stand before a document's start. Shorter contexts are prefixes of
    longer ones, so numbers in order are in order at every depth. Chunks don't follow documents: no text is too long."""
    for a in range(0, len(buf), CHUNK):
        b = min(len(buf), a + CHUNK)
        first, last = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
        doc = np.repeat(np.arange(last - first), np.diff(np.clip(offs[first : last + 1], a, b)))
        place = np.arange(a, b) - offs[first + doc]
        key = buf[a:b].astype(np.int64)
        for back in range(1, order + 1):
            lo = max(0, a - back)
            before = np.zeros(b - a, np.int64)
            before[lo + back - a :] = buf[lo : b - back]
            key |= np.where(place >= back, before, 0) << (8 * (order + 1 - back))
        yield first, doc, key


def _pairs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys with their counts added, in order."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def string_counts(rows: DataFrame) -> DataFrame:
    """(language, key, n) of all byte strings of ORDER + 1 bytes; rows has language and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for language, parts in held.items():
                keys, counts = _pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for at in range(0, len(keys), FLUSH):
                    part = slice(at, at + FLUSH)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), language, np.int32)), pa.array(keys[part]), pa.array(counts[part])], ["language", "key", "n"])

        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            for language in np.unique(of):
                buf, offs = text_arrays(batch.column(1).filter(pa.array(of == language)))
                for _, _, key in byte_strings(buf, offs):
                    found = pa.array(key).value_counts()
                    part = (found.field("values").to_numpy(), found.field("counts").to_numpy())
                    held.setdefault(int(language), []).append(part)
                    size += len(part[0])
                    if size > FLUSH:
                        held = {k: [_pairs(np.concatenate([p[0] for p in v]), np.concatenate([p[1] for p in v]))] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > FLUSH // 2:
                            yield from emit()
                            held, size = {}, 0
        yield from emit()

    counted = rows.select("language", "text").mapInArrow(tidy(scan), "language int, key long, n long")
    return counted.groupBy("language", "key").agg(F.sum("n").alias("n"))


def context_nodes(strings: DataFrame) -> DataFrame:
    """(language, depth, context, seen, kinds, symbols, counts, most) of every context of 0 to ORDER bytes; most is the greatest ``seen`` of any language."""
    entries = strings.select("language", F.explode(F.lit(list(range(ORDER + 1)))).alias("depth"), "key", "n")
    entries = entries.groupBy("language", "depth", F.expr(f"shiftleft(shiftright(key, 8 * ({ORDER + 1} - depth)), 8) | (key & 255)").alias("key")).agg(F.sum("n").alias("n"))
    symbol = F.struct(F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
    entries = entries.withColumn("context", F.shiftright("key", 8)).repartition("depth", "context")  # one shuffle for both of the following
    nodes = entries.groupBy("language", "depth", "context").agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"), F.array_sort(F.collect_list(symbol)).alias("of"))
    most = F.max("seen").over(Window.partitionBy("depth", "context"))
    return nodes.select("language", "depth", "context", "seen", "kinds", F.col("of.symbol").alias("symbols"), F.col("of.n").alias("counts"), most.alias("most"))


def kept_nodes(nodes: DataFrame, room: int) -> DataFrame:
    """Nodes of contexts that some language saw at least as often as the smallest count, in steps of an eighth of a doubling, that leaves at most ``room`` entries; roots always stay."""
    level = F.floor(8 * F.log2("most")).cast("int")
    sizes = {r["level"]: r["size"] for r in nodes.groupBy(level.alias("level")).agg(F.sum("kinds").alias("size")).collect()}
    least, size = max(sizes, default=0) + 1, 0
    while least > 0 and size + sizes.get(least - 1, 0) <= room:
        least -= 1
        size += sizes.get(least, 0)
    return nodes.where((level >= least) | (F.col("depth") == 0))


def _entry(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of ``depth`` bytes of whole keys, and the contexts with the symbol."""
    context = keys >> (8 * (ORDER + 1 - depth))
    return context, (context << 8) | (keys & 255)


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values stand in a sorted table, -1 for those that don't."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1) if len(table) else np.full(len(values), -1)


class Group:
    """Context trees of up to ``GROUP`` languages, as sorted arrays with a column for each language.

    At each depth: contexts with the bytes ``seen`` after them, how many ``kinds``, and what is left of both in the parent once the
    node's own symbols are excluded (0 where a language has no such node); and entries (context and symbol) with counts.
    The costs of all entries of the greatest depth are worked out beforehand."""

    def __init__(self, width: int):
        self.width, self.depths = width, []

    def add(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        """The next depth: for each language contexts, ``seen``, ``kinds``, and entries with counts."""
        level = self._level(parts)
        if self.depths:
            self._exclude(level, self.depths[-1])
        del level["node"]
        self.depths.append(level)
        if len(self.depths) > ORDER:  # at this depth an entry is the whole key
            level["cost"] = np.concatenate([np.zeros((0, self.width), np.float32), *(self._costs(level["key"][a : a + FEW]).astype(np.float32) for a in range(0, len(level["key"]), FEW))])
            level["n"] = None

    def add_nodes(self, nodes: pa.Table, languages: list[int]) -> None:
        language = nodes["language"].to_numpy()

        def part(rows: pa.Table) -> tuple[np.ndarray, ...]:
            rows = rows.combine_chunks()
            flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in rows[name].chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
            context, kinds = rows["context"].to_numpy(), rows["kinds"].to_numpy().astype(np.int64)
            return context, rows["seen"].to_numpy().astype(np.int64), kinds, (np.repeat(context, kinds) << 8) | flat("symbols"), flat("counts")

        self.add([part(nodes.filter(pa.array(language == l))) for l in languages])

    def below(self, keys: np.ndarray, counts: np.ndarray, language: np.ndarray, first: np.ndarray) -> Group:
        """The whole trees over the contexts of ``keys``: strings with their counts in a language of this group, complete under every
        context of the depth ``first`` or more; shorter contexts are those of this group."""

        def parts(d: int) -> list[tuple[np.ndarray, ...]]:
            context, entry = _entry(keys, d)
            own, here = self.depths[d], first > d
            at = _find(own["context"], np.unique(context[here]))
            at = at[at >= 0]
            ranges = [np.searchsorted(own["key"], (own["context"][at] + k) << 8) for k in (0, 1)]
            size = ranges[1] - ranges[0]
            entries = np.repeat(ranges[0] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out = []
            for l in range(self.width):
                mine = ~here & (language == l)
                key, n = _pairs(entry[mine], counts[mine])
                new, begin, kinds = np.unique(key >> 8, return_index=True, return_counts=True)
                seen = np.add.reduceat(n, begin) if len(begin) else n
                if len(at):  # no context is in both
                    node, known = at[own["seen"][at, l] > 0], entries[own["n"][entries, l] > 0]
                    new, seen, kinds = (np.concatenate(x) for x in ((new, own["context"][node]), (seen, own["seen"][node, l]), (kinds, own["kinds"][node, l])))
                    key, n = np.concatenate([key, own["key"][known]]), np.concatenate([n, own["n"][known, l]])
                out.append((new, seen, kinds, key, n))
            return out

        whole = Group(self.width)
        for d in range(ORDER + 1):
            whole.add(parts(d))
        return whole

    def _level(self, parts: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
        context = np.unique(np.concatenate([x[0] for x in parts]))
        key = np.unique(np.concatenate([x[3] for x in parts]))
        kind = np.int32 if max((x[1].max(initial=0) for x in parts)) < 1 << 30 else np.int64
        out = {"context": context, "key": key, "node": np.searchsorted(context, key >> 8)}
        out |= {name: np.zeros((size, self.width), of) for name, size, of in (("seen", len(context), kind), ("kinds", len(context), np.int16), ("n", len(key), kind))}
        for i, (c, seen, kinds, k, n) in enumerate(parts):
            at = np.searchsorted(context, c)
            out["seen"][at, i], out["kinds"][at, i], out["n"][np.searchsorted(key, k), i] = seen, kinds, n
        return out

    @staticmethod
    def _exclude(own: dict[str, np.ndarray], up: dict[str, np.ndarray]) -> None:
        if not len(own["key"]):
            own["up_kinds"] = own["up_total"] = own["kinds"]
            return
        at = np.searchsorted(up["context"], own["context"] >> 8)
        taken = np.where(own["n"] > 0, up["n"][np.searchsorted(up["key"], ((own["key"] >> 16) << 8) | (own["key"] & 255))], 0)
        first = np.searchsorted(own["node"], np.arange(len(at)))
        own["up_kinds"] = up["kinds"][at] - own["kinds"]
        own["up_total"] = up["seen"][at] - np.add.reduceat(taken, first, axis=0) + own["up_kinds"]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """(keys, languages) bits of the symbols of sorted keys."""
        top = self.depths[-1]
        at = _find(top["key"], keys)
        out = np.empty((len(keys), self.width))
        out[at >= 0] = top["cost"][at[at >= 0]]
        out[at < 0] = self._costs(keys[at < 0])
        return out

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), self.width))
        left = np.arange(len(keys))
        alive = np.ones(out.shape, bool)
        child = np.zeros(out.shape, bool)  # where the key has escaped from a node one deeper
        total = kinds = np.zeros(out.shape, np.int64)
        for d in range(ORDER, -1, -1):
            own = self.depths[d]
            context, entry = _entry(keys[left], d)
            node, found = _find(own["context"], context), _find(own["key"], entry)
            seen = np.where(node[:, None] >= 0, own["seen"][node], 0) if len(own["seen"]) else np.zeros(alive.shape, np.int64)
            of = np.where(node[:, None] >= 0, own["kinds"][node], 0) if len(own["seen"]) else seen
            there = of > 0
            total, kinds = np.where(child, total, seen.astype(np.int64) + of), np.where(child, kinds, of)
            n = np.where(found[:, None] >= 0, own["n"][found], 0) if own["n"] is not None and len(own["n"]) else np.zeros(alive.shape, np.int64)
            hit = alive & (n > 0)
            gone = alive & ~hit & there & (kinds > 0)  # where all symbols are excluded, the escape is certain
            ratio = np.where(hit, total / np.maximum(n, 1), np.where(gone, total / np.maximum(kinds, 1), 1.0))
            out[left] += np.log2(ratio)
            alive &= ~hit
            if not d:
                out[left] += np.where(alive, np.log2(256 - of), 0.0)
                break
            more = alive.any(axis=1)
            left, alive, child, node = left[more], alive[more], there[more], node[more]
            total, kinds = (np.where(node[:, None] >= 0, own[x][node], 0) if len(own["seen"]) else np.zeros(alive.shape, np.int64) for x in ("up_total", "up_kinds"))
        return out


class Trees:
    """Context trees of all languages, in groups, so that a node takes no more room than ``GROUP`` languages need."""

    def __init__(self, nodes: Callable[[int], pa.Table], languages: int):
        """nodes(depth): those of all languages; one depth at a time, as the driver builds the trees."""
        self.languages = languages
        members = [list(range(l, min(l + GROUP, languages))) for l in range(0, languages, GROUP)]
        self.groups = [Group(len(m)) for m in members]
        for d in range(ORDER + 1):
            rows = nodes(d)
            for group, m in zip(self.groups, members, strict=True):
                group.add_nodes(rows, m)
            del rows
            give_back()
        self.contexts = [self.groups[0].depths[d]["context"] if len(self.groups) == 1 else np.unique(np.concatenate([g.depths[d]["context"] for g in self.groups])) for d in range(ORDER + 1)]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """(keys, languages) bits of the last byte of each string after the bytes before it; keys are in order."""
        return np.hstack([g.costs(keys) for g in self.groups])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """-1 for strings whose longest context is in the trees; for others a number of the shortest of its contexts that isn't, its depth in the last three bits."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for d in range(ORDER, 0, -1):
            context = _entry(keys[left], d)[0]
            rare = _find(self.contexts[d], context) < 0
            left = left[rare]
            out[left] = (context[rare] << 3) | d
        return out

    def whole_costs(self, asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, language: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``costs`` of ``asked`` from whole trees, where keys are all counted strings under the same places; first: the place's depth."""
        out, start = [], 0
        for group in self.groups:
            out.append(group.below(keys, counts, language - start, first).costs(asked))
            start += group.width
        return np.hstack(out)


def code_lengths(column: pa.Array, trees: Trees, whole: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(texts, languages) bits of whole texts by the broadcast trees; unless these are whole, the strings whose longest context isn't in them: text, key, depth of the first context that isn't, how often."""
    buf, offs = text_arrays(column)
    out, rare = np.zeros((len(offs) - 1, trees.languages)), []
    for first, doc, key in byte_strings(buf, offs):
        found = pa.array(key).dictionary_encode()
        keys = found.dictionary.to_numpy()
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        keys, at = keys[order], rank[found.indices.to_numpy()]
        bits = trees.costs(keys)
        n = int(doc[-1]) + 1
        for l in range(trees.languages):
            out[first : first + n, l] += np.bincount(doc, bits[at, l], n)
        if not whole:
            places = trees.places(keys)
            pick = np.flatnonzero((places >= 0)[at])
            both, times = np.unique(doc[pick] * len(keys) + at[pick], return_counts=True)
            of = both % len(keys)
            rare.append((first + both // len(keys), keys[of], (places[of] & 7).astype(np.int8), times.astype(np.int32)))
    return out, rare


def rare_costs(asked: DataFrame, strings: DataFrame, trees: Broadcast, size: int) -> DataFrame:
    """(key, more): by how many 1 / STEP bits each language's cost of ``asked`` strings (key, first: the depth of the first rare context) is above that of the broadcast trees.

    Rows of one place meet in a bucket, which holds about ``BUCKET`` of the ``size`` rows. A context that isn't broadcast was seen less often than the
    least count in every language, so no place has many strings. Strings at places without counted ones cost what the broadcast trees say, and give no row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            order = np.argsort(keys)
            place = np.empty(len(keys), np.int64)
            place[order] = trees.value.places(keys[order])
            rare = pa.array(place >= 0)
            yield pa.RecordBatch.from_arrays([c.filter(rare) for c in (batch.column(1), pa.array(place), batch.column(0), batch.column(2))], ["key", "place", "language", "n"])

    def settle(table: pa.Table) -> pa.Table:
        key, place, language, n = (table[c].to_numpy() for c in ("key", "place", "language", "n"))
        known = language >= 0
        ask = np.sort(key[~known & np.isin(place, place[known])])
        cost = trees.value.whole_costs(ask, key[known], n[known], language[known], place[known] & 7) - trees.value.costs(ask) if len(ask) else np.zeros((0, trees.value.languages))
        more = pa.ListArray.from_arrays(np.arange(len(ask) + 1, dtype=np.int32) * trees.value.languages, pa.array(np.rint(cost * STEP).astype(np.int64).ravel()))
        return pa.table({"key": pa.array(ask, pa.int64()), "more": more})

    known = strings.select("language", "key", "n").mapInArrow(tidy(scan), "key long, place long, language int, n long")
    rows = known.unionByName(asked.select("key", F.expr(PLACE).alias("place"), F.lit(-1).alias("language"), F.lit(0).cast("long").alias("n")))
    return rows.groupBy(F.pmod(F.xxhash64("place"), F.lit(1 + size // BUCKET)).alias("bucket")).applyInArrow(tidy_group(settle), "key long, more array<long>")


def identify(docs: DataFrame, labelled: DataFrame, temper: float = 8.0, und: str = "und") -> DataFrame:
    """doc_id, lang_pred, score and bits (code length in each language) of every row of ``docs``.

    ``labelled`` has text and lang; rows with a null lang or an empty text teach nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND octet_length(text) > 0")
    found = known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).collect()
    names = sorted((r["lang"] for r in found), key=lambda x: x.encode())
    if not names:
        return docs.select("doc_id", F.lit(und).alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("bits"))
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "language int, name string"))
    strings = stash(string_counts(known.join(number, F.col("lang") == F.col("name"))), "language-strings")
    nodes = stash(context_nodes(strings), "language-nodes")
    kept = kept_nodes(nodes, tree_room(sum(r["size"] for r in found))).drop("most")
    whole = kept.count() == nodes.count()
    trees = spark.sparkContext.broadcast(Trees(lambda d: kept.where(F.col("depth") == d).toArrow(), len(names)))
    give_back()
    discard(nodes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            bits, rare = code_lengths(batch.column(1), trees.value, whole)
            n = len(bits)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(names), pa.array(bits.ravel()))
            of = [pa.nulls(n, t) for t in (pa.int64(), pa.int8(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column(0), batch.column(2), lists, *of], SCORED)
            for text, *of in rare:
                n = len(text)
                yield pa.RecordBatch.from_arrays([pa.array(row + text), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, lists.type), *map(pa.array, of)], SCORED)
            row += len(bits)

    letters: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select("doc_id", "text", letters.alias("letters")).mapInArrow(tidy(scan), "row long, doc_id long, letters boolean, bits array<double>, key long, first byte, times int")
    if whole:
        discard(strings)
    else:
        scored = stash(scored, "language-scored")
        rare = scored.where("key IS NOT NULL").select("row", "key", "first", "times")
        more = rare_costs(rare.select("key", "first").distinct(), strings, trees, rare.count() + strings.count())
        more = rare.join(more, "key").groupBy("row").agg(F.array(*[F.sum(F.col("more")[l] * F.col("times")) for l in range(len(names))]).alias("more"))
        more = stash(more, "language-rare")
        discard(strings)
        scored = scored.where("key IS NULL").drop("key").join(more, "row", "left")
        scored = scored.withColumn("bits", F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda b, m: b + m / STEP)))
    scored = scored.withColumn("least", F.array_min("bits"))
    share = 1 / F.aggregate("bits", F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), (F.col("least") - b) / temper))
    name = F.element_at(F.array(*map(F.lit, names)), F.array_position("bits", F.col("least")).cast("int"))
    return scored.select("doc_id", F.when(F.col("letters"), name).otherwise(und).alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"), F.map_from_arrays(F.array(*map(F.lit, names)), F.col("bits")).alias("bits"))
