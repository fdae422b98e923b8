"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclattice.llm import decontamination, exact_dedup, fm_dedup, jaccard_join, learn, mixing, pii, quality, suffix_dedup, token_output, toxicity
from doclattice.llm.queries import ORACLE_SQL, QUERIES, word_tokenizer
from doclattice.llm.wavelet import WaveletMatrix

from ..oracle import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, label int, n string, at string, rank int, digest string, bucket string"


def corpus():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, line = say(60), say(12)
    texts = [say(int(n)) for n in rng.integers(3, 200, 24)]
    texts += [texts[0]] * 5 + [texts[1].upper(), texts[2].replace(" ", "\n  ")]
    for k in range(20):  # near copies, some of copies
        w = texts[3 if k < 10 else 31 + k - 10].split()
        w[int(rng.integers(len(w)))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [f"{say(20)} {passage} {say(30)}" for _ in range(4)] + [f"{line}\n{say(25)}" for _ in range(4)]
    texts += ["", "   \n", "one", "one two three four", "one two three four", "a" * 400, "é" * 120 + " " + "é" * 120, "ß x y", say(3000), f"{passage} {passage}"]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1000, None), (1001, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}", 1, "x", "y", 2, "z", "b") for i, t in rows], SCHEMA)


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}) if lower else text)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


EMPTY = []


def test_exact_dedup_equals_brute_force_even_when_digests_collide(spark):
    rows = corpus()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i))
    for digest in (lambda c: F.sha2(c, 256), lambda c: F.lit("same")):
        got = by_id(exact_dedup.exact_dedup(frame(spark, rows), digest))
        for i, t in rows:
            g = groups[strip(t)]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(strip(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(frame(spark, EMPTY)).count() == 0
    nameless = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (5, "a"), (None, "bb")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in nameless} == {(None, 5, 2), (5, 5, 2), (None, None, 1)}


def test_exact_dedup_query_equals_sql(spark):
    same(QUERIES["op4_exact_dedup"](spark, SF), SF, ORACLE_SQL["op4_exact_dedup"])


def test_jaccard_components_equal_brute_force(spark):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for rare in (1, 16):  # rare = 1 sends every list through the pair signatures and the block comparison
        got = by_id(jaccard_join.jaccard_classes(frame(spark, rows), rare))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), root(i)) for i in sets}
    assert jaccard_join.jaccard_classes(frame(spark, EMPTY)).count() == 0
    odd = jaccard_join.jaccard_classes(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (2, "other text here")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in odd) == [("1", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("None", "None")]


def test_jaccard_links_sets_of_four_and_texts_of_ids_set_aside(spark):
    letters = [f"l{k}" for k in range(60)]
    say = lambda a, n: " ".join(letters[a : a + n])
    texts = [say(0, 8), say(0, 9), say(1, 8), say(20, 7), say(20, 8), "p " + say(20, 8), say(40, 6), say(40, 7), "one two", "one two three"]
    texts += [f"{say(20, 8)} tail{k}" for k in range(30)] + [f"head{k} {say(0, 8)}" for k in range(4)]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = min(want[i], want[j])
    assert (len(sets[1]), len(sets[2]), want[2]) == (4, 5, 1)
    for rare in (1, 16):
        got = by_id(jaccard_join.jaccard_classes(frame(spark, rows), rare))
        assert {i: r["component_id"] for i, r in got.items()} == want
    long = say(0, 30)
    clash = [(1, long), (1, "some other text of seven words"), (2, long), (3, long), (4, long + " more"), (5, "a b"), (5, "c d"), (6, "a b"), (7, "a b")]
    for parts in (1, 9):
        table = spark.createDataFrame(clash, "doc_id long, text string").repartition(parts)
        assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_classes(table).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 5)}
    chain = [(10, long), (10, "one two three four five six"), (11, long), (12, "one two three four five six"), (9, "one two three four five six seven"), (8, None), (8, "one two three four five six seven"), (13, ""), (13, None)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(8, 8), (8, 8), (9, 8), (10, 10), (10, 10), (11, 10), (12, 10), (13, 13), (13, 13)]


def test_suffix_dedup_equals_brute_force(spark):
    rows = corpus()
    got, seen = by_id(suffix_dedup.suffix_dedup(frame(spark, rows))), set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        starts = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, s in enumerate(starts):
            if s in seen:
                gone[k : k + 50] = True
        seen.update(starts)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.suffix_dedup(frame(spark, EMPTY)).count() == 0
    nameless = suffix_dedup.suffix_dedup(spark.createDataFrame([(None, "q" * 80), (3, "q" * 80)], "doc_id long, text string")).collect()
    assert {r["n_removed"] for r in nameless} == {0}


def test_word_dedup_equals_brute_force(spark):
    rows = corpus()
    seen = collections.Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    got = by_id(fm_dedup.substring_dedup(frame(spark, rows)))
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()), i
    assert fm_dedup.substring_dedup(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("shift", [0, -(1 << 62)])
def test_repeated_ids_with_different_texts_keep_their_own_ranges(spark, shift):
    rng = np.random.default_rng(16)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    p = say(60)
    rows = [(1 + shift, p), (2 + shift, p + " " + say(40)), (2 + shift, say(120)), (2 + shift, p), (3 + shift, say(50)), (3 + shift, say(50)), (5 + shift, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    starts = lambda t, n: {t[k : k + n] for k in range(len(t) - n + 1)}
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(table).collect())
    want = []
    for i, t in rows:
        b = (t or "").encode()
        seen = set().union(*[starts((u or "").encode(), 50) for j, u in rows if j < i], set())
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            gone[k : k + 50] |= b[k : k + 50] in seen
        want.append((i, len(b), int(gone.sum())))
    assert got == sorted(want)
    counts = collections.Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            gone[k : k + 35] |= counts[tuple(w[k : k + 35])] > 1
        want.append((i, len(w), int(gone.sum())))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in fm_dedup.substring_dedup(table).collect()) == sorted(want)


def test_columnwise_order_and_prefixes():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, int(n)).astype(np.uint8) for n in rng.integers(4, 12, 40)]
    offset = np.array([int(rng.integers(0, 3)) for _ in texts])
    sizes = np.array([len(t) for t in texts])
    for column, order, lcp in suffix_dedup.columnwise(offset, sizes, np.concatenate(texts), 6):
        tails = [texts[k][column + offset[k] :].tobytes() for k in order]
        assert tails == sorted(tails)
        for k in range(1, len(tails)):
            a, b = tails[k - 1], tails[k]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert lcp[k] == min(n, 6)


def test_matching_statistics():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 4, 30), 0) for _ in range(5)])
    index = fm_dedup.FMIndex(text, 9)
    ends = np.array([k for k in range(len(text)) if k % 31 >= 8 and k % 31 < 30])
    raw = text.tolist()
    for e, n in zip(ends.tolist(), index.matching(text, ends, 8).tolist(), strict=True):
        expect = 0
        while expect < 8 and sum(raw[k : k + expect + 1] == raw[e - expect : e + 1] for k in range(len(raw))) > 1:
            expect += 1
        assert n == expect


def test_wavelet_matrix_round_trip_and_lookups():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 300, n)
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(values, 9).to_bytes())
        assert m.decode().tolist() == values.tolist()
        full = WaveletMatrix.build(values, 9)
        full.ones()
        for level in range(9):  # a loaded matrix answers from the stored directory
            assert m._ones is None and m.rank1(level, np.arange(n + 1)).tolist() == full.rank1(level, np.arange(n + 1)).tolist()
        if n:
            assert m.access(np.arange(n)).tolist() == values.tolist()
            v = int(values[n // 2])
            assert m.count(v) == (values == v).sum() and m.positions(v) == np.flatnonzero(values == v).tolist() and m.select(v, n) == -1
            assert m.rank(v, np.arange(n + 1)).tolist() == [int((values[:k] == v).sum()) for k in range(n + 1)]
            assert m.locate(values, np.arange(n)).tolist() == [int((values[:k] == values[k]).sum()) for k in range(n)]


def test_token_output_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(), (2000, "it's <|endoftext|> İstanbul é 'S ẛ̣ 漢字 12ab heed, Heed. heed.., é. 3.5. x\u0301. \u0301. ., '. it's.")]
    coder, start = Tokenizer.from_file(word_tokenizer()), 0
    for options in ({"shard_tokens": 500}, {"by_word": False}):
        got, start = by_id(token_output.token_output(frame(spark, rows), word_tokenizer(), **options)), 0
        for i, t in sorted(rows):
            ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), i
            start += len(ids)
    assert token_output.token_output(frame(spark, EMPTY), word_tokenizer()).count() == 0
    twice = token_output.token_output(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string"), word_tokenizer()).collect()
    assert sorted(r["start"] for r in twice) == [0, 2, 4] and [r["start"] for r in twice if r["doc_id"] is None] == [0]


def test_words_are_cut_as_whole_texts_are():
    import pyarrow as pa
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_tokenizer())
    texts = ["Xİ, İ. (heed) Heed$$$ heed&&& \"Éa-b\" don't, 'S x='s ==a== a\u0338= =\u0338a 12, ½. ª, µ. K, ßÿ×÷; <a> |b| <|endoftext|>, --- " + "-" * 9 + "a" + "." * 300, "", "heed", " \t"]
    encoder = token_output.WordEncoder(word_tokenizer(), True, limit=5)
    for batch in (texts, texts[1:], [], texts[::-1]):
        ids, sizes = encoder.encode(pa.array(batch, pa.string()), 2)
        want = [[*coder.encode(t, add_special_tokens=False).ids, 2] for t in batch]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    encoder = token_output.WordEncoder(word_tokenizer(), True)
    encoder.encode(pa.array(["heed Heed, heed. HEED### (heed)"]), 2)
    assert sum("heed" in w.lower() for w in encoder.known) == 1  # one part for all of them


def test_mixing_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(n)), "abcde"[i % 5] if i % 11 else None) for i, n in enumerate(rng.integers(0, 40, 2000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df)
    taken = plan.groupBy("source").agg(F.sum(F.col("mix_size") * F.size("mix_shards")).alias("taken"), F.first("mix_target").alias("target"), F.first("mix_source_size").alias("size"), F.max(F.size("mix_shards")).alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 and r["most"] <= 2 for r in taken)
    sizes = {r["source"]: r["size"] for r in taken}
    order = sorted((s for s in sizes if s is not None)) + [None]
    expect = mixing.targets([sizes[s] for s in order], [5, 2, 1, 5, 2, 1], 1.5, 2.0)
    assert {r["source"]: pytest.approx(r["target"]) for r in taken} == dict(zip(order, expect, strict=True))
    assert sorted(map(str, mixing.mix_plan(df).select("doc_id", "mix_shards").collect())) == sorted(map(str, plan.select("doc_id", "mix_shards").collect()))
    shard = mixing.mix_sources(df).withColumn("part", F.spark_partition_id()).select("part", "mix_shard").distinct()
    assert shard.count() == shard.select("mix_shard").distinct().count()  # a shard stands together
    many = mixing.mix_plan(df, shard_words=1000)
    assert many.select(F.explode("mix_shards").alias("s")).distinct().count() > 30
    assert many.agg(F.sum(F.size("mix_shards"))).first() == plan.agg(F.sum(F.size("mix_shards"))).first()
    hot = spark.createDataFrame([(i, "w w w", "one", 1, "t") for i in range(500)] + [(5, "w", "two", 2, "u"), (5, "w w", "two", 3, "v")], "doc_id long, text string, source string, mix_size int, mix_s string")
    got = mixing.mix_sources(hot)
    assert got.where("mix_size in (1, 2, 3)").count() == got.count() > 500 and got.columns.count("mix_size") == 1
    rows = mixing.mix_sources(df)
    assert rows.count() == plan.agg(F.sum(F.size("mix_shards"))).first()[0] and set(df.columns) <= set(rows.columns)
    assert mixing.mix_plan(df.limit(0)).count() == 0
    blank = mixing.mix_plan(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert len(blank) == 2 and all(r["mix_size"] == 0 for r in blank)


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 3, 0, 77])
    out = mixing.split_quotas(quotas, 16, 1)
    assert out.sum(axis=0).tolist() == quotas.tolist() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 5
    assert mixing.targets([10, 10, 1000], [5, 2, 1], 1.5, 2)[:2] == [20.0, 20.0]


def test_top_k_equals_sorting(spark):
    keys = [5, 5, 5, 9, 1 << 50, 0, 7, (1 << 50) + 1]
    df = spark.createDataFrame(list(enumerate(keys)), "doc_id long, key long")
    for k in range(len(keys) + 2):
        expect = sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k]
        assert sorted(r["doc_id"] for r in quality.top_k(df, "key", k).collect()) == sorted(expect)


def junk(i):
    return " ".join(f"w{(i * 7 + k) % 90}%%% &&&" for k in range(30))


def test_quality_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    kept = quality.quality_sample(docs, labels.where(seen)).select("doc_id").distinct().withColumn("kept", F.lit(1))
    rates = {r["quality"]: r["rate"] for r in labels.where(~seen).join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("rate")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.15


def test_log_ratio_equals_plain_counts(spark):
    texts = [("a b a b c", 1), ("xx yy xx", 0), ("abcd", None), ("é e", 1), ("", 1)]
    counts, buckets = np.zeros((2, (1 << 16) + quality.RECENT), np.int64), 1 << 16
    quality._counter(buckets)(pa.RecordBatch.from_arrays([pa.array([t for t, _ in texts]), pa.array([y for _, y in texts], pa.int32())], ["text", "label"]), counts)
    want = np.zeros_like(counts)
    for t, y in texts:
        b, w = t.encode(), t.split()
        last = [next((d for d in range(1, 5) if i - d >= 0 and w[i - d] == w[i]), 0) for i in range(len(w))]
        cells = [(int.from_bytes(b[k : k + 4], "little") * 0x9E3779B1 % (1 << 32)) >> 16 for k in range(len(b) - 3)]
        cells += [buckets + last[k] * 25 + last[k + 1] * 5 + last[k + 2] for k in range(len(w) - 2)]
        for c in cells:
            want[0, c] += 1
            want[1, c] += y == 1
    assert (counts == want).all() and [quality.byte_buckets(n) for n in (0, 10**8, 4 * 10**8, 10**14)] == [1 << 16, 1 << 16, 1 << 17, 1 << 22]


def test_quality_keeps_clean_documents_held_out(spark):
    clean = [(i, " ".join(f"w{(i * 13 + k * k) % 90}" for k in range(40))) for i in range(0, 200, 2)]
    bad = [(i, junk(i)) for i in range(1, 200, 8)]
    docs = frame(spark, [*clean, *bad, (1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in [*clean, *bad] if i < 120], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.quality_sample(docs, labels).collect()}
    assert len(kept & {i for i, _ in clean}) >= 98 and len(kept & {i for i, _ in bad}) <= 1
    assert {r["doc_id"] for r in quality.quality_sample(docs, labels, most_broadcast=7).collect()} == kept
    assert quality.quality_sample(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_sample(docs.limit(0), labels).count() == 0


def test_one_letter():
    import itertools

    words = ["".join(w) for n in range(4) for w in itertools.product("abc", repeat=n)]

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = step(row, i, x, b)
        return row[-1]

    def step(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out

    assert all(decontamination.one_letter(a, b) == (apart(a, b) <= 1) for a in words for b in words)


def test_leaks_with_edited_letters(spark):
    """One letter changed in every fourth word, a letter added to five of twenty words; other texts of the same words stay."""
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(4, 9))))
    vocabulary = [word() for _ in range(1500)]
    say = lambda n: [vocabulary[i] for i in rng.integers(0, 1500, n)]

    def changed(w, add):
        i, x = int(rng.integers(len(w))), letters[int(rng.integers(26))]
        return w[:i] + x + w[i + (0 if add else 1) :]

    items = [(k, say(40)) for k in range(150)] + [(1000 + k, say(20)) for k in range(100)]
    rows = []
    for k, w in items:
        add = k >= 1000
        edited = [changed(x, add) if i % 4 == 1 else x for i, x in enumerate(w)]
        rows.append((k, " ".join(say(30) + edited + say(30))))
    clean = [(5000 + k, " ".join(say(300))) for k in range(100)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    assert not [d for d, _ in got if d >= 5000] and all(d == i for d, i in got)
    assert len([d for d, _ in got if d < 1000]) >= 0.9 * 150 and len([d for d, _ in got if d >= 1000]) >= 0.9 * 100, (len([d for d, _ in got if d < 1000]), len(got))


def test_leaks_exact_edited_and_clean(spark):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.integers(3, 8))))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)]
    edited = items[1][1].split()
    edited[5], edited[20] = "zzz", "qqqq"
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, f"{noise(50)} {items[0][1].upper()} {noise(50)}"), (2, f"{noise(9)}\n{' '.join(edited)}"), (3, noise(400)), (4, items[2][1].replace(" ", ", \n ")), (5, None), (6, ""), (7, items[3][1][:100] + noise(50)), (8, items[4][1] + " " + items[4][1] + " " + items[5][1]), (9, noise(30000) + " " + items[3][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, "..."), (92, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 0): 0, (1, 92): 0, (2, 1): 2, (4, 2): 0, (8, 4): 0, (8, 5): 0, (9, 3): 0}
    blocks = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(frame(spark, rows), bench, block_bytes=500).collect()}
    assert blocks == got
    assert decontamination.find_leaks(frame(spark, EMPTY), bench).count() == 0 and decontamination.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0
    long = (100, noise(3000))
    giant = decontamination.find_leaks(frame(spark, [(1, f"x {long[1]} y"), (2, long[1].replace("a", "b", 200)), (3, noise(3000))]), spark.createDataFrame([long], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in giant} == {1, 2}


def plain_words(text):
    return re.findall("[a-z0-9]+", text)


def distances(item, docs):
    """Least word edit distance of the item to any part of each document, by the plain table."""
    flat, first = [], []
    for d in docs:
        first.append(len(flat))
        flat += [None, *d]
    code = {w: i for i, w in enumerate(dict.fromkeys(item), 1)}
    y = np.array([-1 if w is None else code.get(w, 0) for w in flat])
    wall = y < 0
    prev = np.zeros(len(y), int)
    ramp = np.arange(len(y))
    for i, w in enumerate(item, 1):
        now = np.minimum(np.concatenate([[i], prev[:-1]]) + (y != code[w]), prev + 1)
        now[wall] = i  # a document begins
        prev = np.minimum.accumulate(now - ramp) + ramp
        prev[wall] = i
    return np.minimum.reduceat(prev, first)


def test_leaks_equal_brute_force_over_all_pairs(spark):
    rng = np.random.default_rng(11)
    vocabulary, share = [f"v{i}" for i in range(500)], 1 / np.arange(1, 501)
    say = lambda n: list(rng.choice(vocabulary, n, p=share / share.sum()))
    items = [say(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 30, 40, 40, 60, 120)]
    docs = []
    for item in items[3:]:
        for k in range(len(item) // 5 + 2):
            w = list(item)
            for _ in range(k):
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[at : at + (kind != 1)] = [f"z{int(rng.integers(999))}"] * (kind != 2)
            docs.append([*say(15), *w, *say(15)])
    docs += [say(400) for _ in range(10)] + [[w if i % 5 != 2 else f"z{i}" for i, w in enumerate(item)] for item in items[3:]]
    want = {(d, i): int(e) for i, item in enumerate(items) for d, e in enumerate(distances(item, docs)) if e <= len(item) // 5}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got) and len(got) >= 0.98 * len(want) and len(want) > 200
    exact = {k for k in want if len(items[k[1]]) < decontamination.SHORT}
    assert exact <= set(got)  # nothing is left to chance for short items


def test_leak_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    raw = lambda t: plain_words(re.sub(r"[^\x00-\x7f]", lambda m: "q%xq" % ord(m.group().lower()), (t or "").lower()))
    texts = [raw(r["text"]) for r in docs]
    want = set()
    for b in bench:
        item = raw(b["text"])
        want |= {(docs[d]["doc_id"], b["item_id"], int(e)) for d, e in enumerate(distances(item, texts)) if e <= len(item) // 5}
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert got == want and want


def test_lsh_reaches_its_recall_at_the_limit():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 7))))
    texts = [[word() for _ in range(int(n))] for n in rng.integers(10, 120, 150)]
    items = decontamination.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
    for kind in ("change", "mixed", "spread"):
        found = 0
        for i, t in enumerate(texts):
            w, k = list(t), len(t) // 5
            for j in range(k):
                at, how = (2 + j * 5 if kind == "spread" else int(rng.integers(len(w)))), int(rng.integers(3)) if kind == "mixed" else 0
                w[at : at + (how != 1)] = ["#" and f"z{j}"] * (how != 2)
            raw = np.frombuffer(" ".join([word() for _ in range(40)] + w + [word() for _ in range(40)]).encode(), np.uint8)
            words_, begin = decontamination.word_sequences(raw, np.array([0, len(raw)]))
            found += any((m[1] == i).any() for m in items.matches(words_, begin))
        assert found >= 0.95 * len(texts), kind


def test_semiglobal_distance_equals_table():
    rng = np.random.default_rng(10)
    sizes = np.array([12, 12, 9, 5, 3])
    patterns, rows = rng.integers(1, 5, (5, 12)).astype(np.uint64), rng.integers(1, 5, (5, 30)).astype(np.uint64)
    best, end = decontamination.semiglobal(patterns, sizes, rows, np.full(5, 99))
    short, _ = decontamination.semiglobal(patterns, sizes, rows, np.full(5, 1))
    for n, pattern, row, b, e, s in zip(sizes, patterns, rows, best, end, short, strict=True):
        d = np.zeros((n + 1, 31), int)
        d[:, 0] = range(n + 1)
        for i in range(1, n + 1):
            for j in range(1, 31):
                d[i, j] = min(d[i - 1, j - 1] + (pattern[i - 1] != row[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        assert b == d[n].min() and d[n][e] == b and (s == b if b <= 1 else s > 1)


def test_words_of_the_search():
    text = "Ärger ÉTÉ x×y «so» l’été 日本語 don't 3.5 É"
    raw = np.frombuffer(text.encode(), np.uint8)
    low, starts, ends, _ = decontamination.word_spans(raw, np.array([0, len(raw)]))
    assert [low[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ärger", "été", "x×y", "so", "l", "été", "日", "本", "語", "don", "t", "3", "5", "é"]


def test_base_spans():
    text = "a.b+c@x.de, 10.20.30.40 or 300.1.1.1 or 4111 1111 1111 1111 or 4111111111111112 or +49 30 901820 +1 2"
    got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b+c@x.de"), ("ip", "10.20.30.40"), ("card", "4111 1111 1111 1111"), ("phone", "+49 30 901820")]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_base(text):
    """The four patterns applied as they stand."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_scan_equals_the_patterns_on_random_text():
    rng = np.random.default_rng(15)
    for alphabet in ("a1.@- ", "12.", "a@.", "0123456789 -+()."):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), int(rng.integers(1, 60))))
            assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_base(text), text


def test_base_scan_is_linear_in_long_words():
    import time

    began = time.perf_counter()
    for text in ("x" * 1_000_000 + "@", "1" * 1_000_000 + ".", "1." * 500_000, "a@" * 500_000, "+1" + " " * 1_000_000, "@" + "a." * 500_000 + "@"):
        pii.base_spans(text)
    assert time.perf_counter() - began < 20


def test_pii_query_equals_an_independent_scan(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = 0
    for r in QUERIES["op7_pii"](spark, SF).collect():
        want = plain_base(docs[r["doc_id"]])
        n += len(want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r["spans"].split(",") if r["spans"] else [])
    assert n > 10


def test_random_field_adds_spans_and_keeps_the_base(spark):
    text = 'é call token = "aa31dfe8b1eb9c654e721b4f812088970e66a634" and 4417744280351548 or und.34@mail7.example.com end'
    rows = [(1, text), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0. in 2021"), (5, "x" * 1_000_000), (6, "the password = swordfish of us"), (7, "a long walk home\n" * 2000 + text)]
    got = by_id(pii.find_pii(frame(spark, rows)))
    assert [text[s["start"] : s["end"]] for s in got[1]["base"]] == ["und.34@mail7.example.com"]
    assert [text[s["start"] : s["end"]] for s in got[1]["added"]] == ["4417744280351548", '"aa31dfe8b1eb9c654e721b4f812088970e66a634"']
    assert [rows[5][1][s["start"] : s["end"]] for s in got[6]["added"]] == ["swordfish"]  # neither digit nor "@"
    assert all(not got[i]["base"] and not got[i]["added"] for i in (2, 3, 4, 5))
    assert [(s["kind"], s["start"] - 34000, s["end"] - 34000) for s in got[7]["added"]] == [(s["kind"], s["start"], s["end"]) for s in got[1]["added"]]
    assert pii.find_pii(frame(spark, EMPTY)).count() == 0


def test_training_lines_are_not_of_the_tables(spark):
    docs = " ".join(r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect())
    marked = re.findall(r"\[(?:number|secret|contact|ip|email|phone|card) ([^\]]+)\]", pii.LABELLED)
    assert len(marked) > 30 and not [m for m in marked if len(m) > 8 and m.strip('"') in docs]
    plain = [re.sub(r"\[\w+ ([^\]]+)\]", r"\1", line) for line in pii.LABELLED.splitlines()]
    runs = {" ".join(w[i : i + 5]) for w in map(str.split, plain) for i in range(len(w) - 4)} | {line for line in plain if len(line) > 12}
    assert not [r for r in runs if r in docs]  # whole lines, and any five words of one


def test_viterbi_equals_the_whole_path():
    rng = np.random.default_rng(11)
    k = len(pii.LABELS)
    step = rng.normal(size=(k, k))
    for i, name in enumerate(pii.LABELS):
        if name[0] == "I":
            step[[j for j, other in enumerate(pii.LABELS) if other[1:] != name[1:]], i] = -1e4
    model = pii.ChainField(np.zeros((1, k)), step)
    for tilt in (0.0, 2.0, 4.0, 6.0):
        sizes = rng.integers(1, 60, 30)
        text = np.repeat(np.arange(30), sizes)
        each = rng.normal(size=(len(text), k))
        each[:, 0] += tilt
        at, label = model.label(each, text)
        got = np.zeros(len(text), int)
        got[at] = label
        for t in range(30):
            x, y = each[text == t], got[text == t]
            score, back = x[0] + [-1e4 if n[0] == "I" else 0.0 for n in pii.LABELS], []
            for row in x[1:]:
                way = score[:, None] + step
                back.append(way.argmax(axis=0))
                score = way.max(axis=0) + row
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert y.tolist() == path[::-1]


def test_emissions_equal_features():
    field = pii.ChainField.train("pay [number 12345] now\nthe key = [secret abc1] here", rounds=3)
    for text in ("one", "Key = Éa11-x  \n42 ü", 'token: "0123456789abcdefABCDEF" at'):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = pii.word_spans(raw, np.array([0, len(raw)]))
        got = pii.Reader(field).emissions(raw, starts, ends, np.zeros(len(starts), int))
        assert got == pytest.approx(field.scores(pii.sentence_features(text.split())))


def test_segments_equal_brute_force():
    rng = np.random.default_rng(12)
    for n in (0, 1, 5, 40):
        x = rng.normal(-0.3, 1, n)
        best = max([0.0, *(x[a:b].sum() for a in range(n) for b in range(a + 1, n + 1))])
        assert toxicity.best_segments(x, np.array([0, n]))[0] == pytest.approx(best)
        found = toxicity.maximal_segments(x)
        assert max([0.0, *(s for _, _, s in found)]) == pytest.approx(best)
        assert all(a < b for a, b, _ in found) and all(p[1] <= q[0] for p, q in zip(found, found[1:], strict=False))


def test_toxicity_separates_held_out_rows(spark):
    rng = np.random.default_rng(13)
    say = lambda bad: " ".join("scum" if bad and rng.random() < 0.2 else f"w{int(rng.integers(200))}" for _ in range(60))
    rows = [(i, say(i % 4 == 0)) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(frame(spark, [*rows, (900, None), (901, "")]), labels))
    held = [(got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(120, 160)]
    assert sum(held) >= 38 and all(got[i]["score"] < 0.5 and not got[i]["passages"] for i in (900, 901)) and got[120]["passages"]
    assert toxicity.toxicity(frame(spark, rows), labels.limit(0)).first()["score"] == 0.0
    assert toxicity.toxicity(frame(spark, EMPTY), labels).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    scored = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = scored["score"].rank()
    n1 = int((scored["toxic"] == 1).sum())
    n0 = len(scored) - n1
    assert (rank[scored["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert (scored["predicted"] == scored["toxic"]).mean() > max(n0, n1) / len(scored)


def test_toxicity_counts_every_significant_passage(spark):
    rng = np.random.default_rng(17)
    say = lambda n, bad: ["scum" if bad and rng.random() < 0.5 else f"w{int(rng.integers(200))}" for _ in range(n)]
    rows = [(i, " ".join(say(60, i % 4 == 0))) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    one, quiet = say(20, False) + ["scum"] * 2 + say(20, False), say(200, False)
    got = by_id(toxicity.toxicity(frame(spark, [*rows, (900, " ".join(say(30, True) + quiet)), (901, " ".join(say(30, True) + quiet + say(30, True) + quiet + say(30, True))), (902, " ".join(one))]), labels))
    assert len(got[901]["passages"]) > len(got[900]["passages"]) >= 1
    nameless = QUERIES["op8_toxicity"]
    assert nameless(spark, SF).where("held_out IS NULL").count() == 0


def test_logistic_fit():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert learn.fit_logistic(x, y) == pytest.approx([2, -1, 0.5], abs=0.25)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("more", F.lit(1))
    kept = p.quality(spark, docs, SF)
    assert tuple(kept.columns) == p.COLUMNS and 0 < kept.count() <= docs.count()
    unique = p.near_duplicates(spark, docs, SF)
    classes = jaccard_join.jaccard_classes(docs).select("component_id").distinct().count()
    assert unique.count() == classes
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct().count()
    assert p.decontaminate(spark, docs, SF).count() == docs.count() - leaks
    assert p.mix(spark, docs, SF).count() > docs.count() / 2
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    whole = p.run(spark, SF).orderBy("start").collect()
    assert [r["start"] for r in whole] == [sum(x["n_tokens"] for x in whole[:k]) for k in range(len(whole))] and 0 < len(whole) <= 2 * docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(word_tokenizer())
    for r in whole[:40]:
        ids = np.array([*coder.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    odd = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y", "en", "t", 3)], docs.drop("more").schema.simpleString()[7:-1].replace(":", " "))
    assert p.near_duplicates(spark, odd, SF).count() == 4 and p.decontaminate(spark, odd, SF).count() == 4 and p.tokens(spark, odd, SF).count() == 4 and p.mix(spark, odd, SF).count() >= 4
    assert p.tokens(spark, odd.limit(0), SF).count() == 0 and p.quality(spark, odd, SF).count() >= 2
    assert p.mix(spark, docs.limit(0), SF).count() == 0 and p.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_text_blocks_split_words_at_document_ends():
    from doclattice.llm.common import text_arrays, word_spans

    buf, offs = text_arrays(pa.array(["ab c", None, "", "d\x0be", "é "]))
    starts, ends, first = word_spans(buf, offs)
    assert [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "d", "e", "é"] and first.tolist() == [0, 2, 2, 2, 4, 5]
