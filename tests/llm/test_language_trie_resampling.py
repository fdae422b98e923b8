"""Language identification, the prefix trie and target resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from doclattice.llm import language, prefix_trie, target_resampling
from doclattice.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same
from .test_llm import SF, corpus

LETTERS = re.compile(r"[^\W\d_]")


# ---------------------------------------------------------------- language


def ppm_bits(texts, text):
    """Code length of text by method C with exclusion, from plain dictionaries of all contexts."""
    tree = collections.defaultdict(collections.Counter)
    for t in texts:
        b = bytes(language.ORDER) + t.encode()
        for i in range(language.ORDER, len(b)):
            for d in range(language.ORDER + 1):
                tree[b[i - d : i]][b[i]] += 1
    b, bits = bytes(language.ORDER) + text.encode(), 0.0
    for i in range(language.ORDER, len(b)):
        excluded = set()
        for d in range(language.ORDER, -1, -1):
            seen = {s: n for s, n in tree.get(b[i - d : i], {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
            excluded |= set(seen)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


TAUGHT = [("en", "the cat sat on the mat and the dog sat on the cat"), ("en", "there is nothing in the house"), ("fr", "le chat est sur la table et le chien est là"), ("fr", "où est la maison près de l'été"), ("de", "der Hund läuft über die Straße und die Katze schläft"), (None, "the the the"), ("xx", ""), ("xx", None)]
ASKED = [(1, "the dog is in the house"), (2, "le chien est sur la table"), (3, "die Straße über der Katze"), (4, ""), (5, None), (6, "123 456 !!"), (7, "zzz \x00 ð" * 3), (8, "the"), (None, "la maison est là"), (2, "le chien est sur la table"), (9, "the cat and " * 4000)]


def test_code_lengths_equal_brute_force(spark, monkeypatch):
    taught = spark.createDataFrame([(t, lang, 1, "x") for lang, t in TAUGHT], "text string, lang string, key int, n string")
    asked = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in ASKED], "doc_id long, text string, lang string, score int, letters string")
    for chunk, group in ((1 << 21, 4), (7, 2)):  # chunks that cut texts
        monkeypatch.setattr(language, "GROUP", group)
        if chunk == 7:
            asked = asked.where("doc_id <> 9 OR doc_id IS NULL")
            monkeypatch.setattr(language, "CHUNK", 7)
        rows = language.identify(asked, taught).collect()
        assert len(rows) == asked.count()
        for r in rows:
            text = next(t for i, t in ASKED if i == r["doc_id"])
            if not LETTERS.search(text or ""):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
                continue
            want = {g: ppm_bits([t for lang, t in TAUGHT if lang == g and t], text) for g in ("de", "en", "fr")} if len(text) < 1000 else None
            if want:
                assert r["bits"] == pytest.approx(want)  # costs are kept to seven digits
                assert r["lang_pred"] == min(want, key=want.get)
                assert r["score"] == pytest.approx(1 / sum(2 ** ((min(want.values()) - w) / 8) for w in want.values()))
            else:
                assert r["lang_pred"] == "en"
    untaught = language.identify(asked, taught.where("lang = 'xx'")).collect()
    assert {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)} and len(untaught) == asked.count()
    assert language.identify(asked.limit(0), taught).count() == 0


@pytest.mark.parametrize(("room", "group", "bucket"), [(0, 4, 1 << 20), (20, 2, 5), (60, 4, 50), (200, 2, 1 << 20)])
def test_contexts_beyond_the_room_count_too(spark, monkeypatch, room, group, bucket):
    """Code lengths are those of whole trees, however few contexts are broadcast."""
    monkeypatch.setattr(language, "GROUP", group)
    monkeypatch.setattr(language, "BUCKET", bucket)
    monkeypatch.setattr(language, "tree_room", lambda n: room)
    taught = spark.createDataFrame([(t, lang) for lang, t in TAUGHT], "text string, lang string")
    rows = language.identify(spark.createDataFrame(ASKED[:-1], "doc_id long, text string"), taught).collect()
    assert len(rows) == len(ASKED) - 1
    for r in rows:
        text = next(t for i, t in ASKED if i == r["doc_id"]) or ""
        want = {g: ppm_bits([t for lang, t in TAUGHT if lang == g and t], text) for g in ("de", "en", "fr")}
        assert r["bits"] == pytest.approx(want, abs=1e-4)
        assert r["lang_pred"] == (min(want, key=want.get) if LETTERS.search(text) else "und")


def test_trees_keep_whole_contexts_within_their_room(spark):
    taught = spark.createDataFrame([(0, t) for lang, t in TAUGHT if lang == "en"], "language int, text string")
    nodes = language.context_nodes(language.string_counts(taught))
    every = nodes.collect()
    entries = sum(r["kinds"] for r in every)
    assert all(r["kinds"] == len(r["symbols"]) == len(r["counts"]) and r["seen"] == sum(r["counts"]) for r in every)
    for room in (entries, entries // 3, 20, 0):
        kept = language.kept_nodes(nodes, room).collect()
        least = min((r["seen"] for r in kept if r["depth"]), default=10**9)
        assert sum(r["kinds"] for r in kept if r["depth"]) <= room
        assert {(r["depth"], r["context"]) for r in kept} == {(r["depth"], r["context"]) for r in every if not r["depth"] or r["seen"] >= least}
    assert language.tree_room(1 << 47) << 1 < 1 << 24


def test_string_counts_survive_flushing(spark, monkeypatch):
    taught = spark.createDataFrame([(i % 2, t) for i, (_, t) in enumerate(TAUGHT) if t], "language int, text string")
    want = {(r["language"], r["key"]): r["n"] for r in language.string_counts(taught).collect()}
    assert sum(want.values()) == sum(len(t.encode()) for _, t in TAUGHT if t)
    monkeypatch.setattr(language, "FLUSH", 16)
    assert {(r["language"], r["key"]): r["n"] for r in language.string_counts(taught).collect()} == want


def test_held_out_languages(spark):
    rows = QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])[c].to_pylist() for c in ("doc_id", "lang")), strict=True))
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert right / len(held) >= 0.97, (right, len(held))
    assert all(0 <= r["score"] <= 1 for r in rows)


# ---------------------------------------------------------------- prefix trie

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    turns = collections.defaultdict(list)
    sha = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), role, sha(role, text), text))
    turns = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.Counter()
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if p in ends else EMPTY_SHA) for p, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df).collect())


def talks():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["a", "b", "ü", "yes", "no"]) for _ in range(n))
    rows = []
    for c in range(0, 90):
        if c in (40, 41, 43):  # an absent base, and convs of which one turn is there at most
            continue
        n = 1 if c in (42, 44, 45, 46) else rng.randint(1, 6)
        rows += [(c, t, rng.choice(["user", "assistant", None]), say(rng.randint(0, 2)) or None) for t in range(n)]
    rows += [(200, t, "user", f"turn {t}") for t in range(300)] + [(201 + k, t, "user", f"turn {t}") for k in range(4) for t in range(300 - 40 * k)]  # long chains
    rows += [(300 + k, t, "user", f"same {t}") for k in range(60) for t in range(5)]  # copies of one conversation
    rows += [(400, None, "user", "first"), (400, 3, "user", "third"), (400, 3, "user", "third"), (400, 1, "user", "second"), (401, 1, "a", "bc"), (402, 1, "ab", "c")]
    rows += [(None, 1, "user", "nobody"), (500, 1, "user", "x " * 50000)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = talks()
    schema = "conv_id long, turn long, role string, text string, id int, parent string, depth int, row int, a int, part string"
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "z") for r in rows], schema)
    want = brute_trie(rows)
    for parts in (1, 7):
        assert trie(table.repartition(parts)) == want
    assert trie(table.limit(0)) == []
    assert trie(table.where("conv_id IS NULL")) == []


def test_a_conversation_goes_on_over_ranges(spark, monkeypatch):
    """One conversation of many turns, in more ranges than tasks."""
    rows = [(20, t, "user", f"turn {t}") for t in range(2000)] + [(40, t, "user", f"turn {t}") for t in range(1500)] + [(60, 0, "user", "alone")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_contraction_of_any_tree(spark):
    rng = random.Random(3)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: rng.randrange(i), lambda i: max(0, i - rng.choice([1, 1, 1, 2, 9]))):
        parent = {0: None} | {i: shape(i) for i in range(1, 150)}
        kids, depth = collections.Counter(parent.values()), {0: 0}
        for i in range(1, 150):
            depth[i] = depth[parent[i]] + 1
        want = {i: i * i + 1 for i in parent}
        for i in range(149, 0, -1):
            want[parent[i]] += want[i]
        tree = spark.createDataFrame([(i, p, depth[i], kids[i], i * i + 1) for i, p in parent.items()], "id long, parent long, depth long, kids long, value long")
        assert {r["id"]: r["value"] for r in prefix_trie.contract(tree, ["value"]).collect()} == want


def test_trie_query_equals_sql(spark):
    same(QUERIES["op12_prefix_trie"](spark, SF), SF, ORACLE_SQL["op12_prefix_trie"])


# ---------------------------------------------------------------- target resampling

RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = RUN.findall((text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, share=(5, 100)):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, aim = collections.Counter(), collections.Counter()
    for counts, texts in ((raw, [t for _, t in docs]), (aim, target)):
        for t in texts:
            counts.update(bucket(f) for f in runs(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    out = []
    for i, t in docs:
        n, found = runs(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = collections.defaultdict(list)
    for k, r in enumerate(able[: share[0] * len(able) // share[1]]):
        rank[id(r)] = k + 1
    return sorted((str(r[0]), r[1], r[2], r[3], rank.get(id(r)) or 0) for r in out)


def resampled(docs, target, **options):
    return sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in target_resampling.target_resample(docs, target, **options).collect())


def odd_documents():
    rows = corpus() + [(2000, "Straße ÉTÉ naïve_word x-y 12a34 `tick` " * 8), (2001, "q" * 200 + " " + "w" * 64 + " " + "e" * 63 + " " + "tail " * 30), (2002, "\x00 nul\x00byte " * 15), (None, "some words of a row without a name " * 5)]
    return rows + [(3000, "the same row thrice " * 9)] * 3


def wide(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], "doc_id long, text string, score int, rank string, at int, k_id int, weight int")


def test_resampling_equals_brute_force(spark):
    rows = odd_documents()
    target = ["w1 w2 w3 w4", None, "", "Straße été one two three", "w10 w11 w12 " * 5]
    items = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    for share in ((5, 100), (60, 100), (1, 1), (0, 1)):
        assert resampled(wide(spark, rows), items, share=share) == brute_resample(rows, target, share)
    assert resampled(wide(spark, rows), items.limit(0)) == brute_resample(rows, [])
    assert resampled(wide(spark, []), items) == []


def test_resampling_query_equals_brute_force(spark):
    table = lambda name, *columns: list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))[c].to_pylist() for c in columns), strict=True))
    got = sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in QUERIES["op13_target_resampling"](spark, SF).collect())
    assert got == brute_resample(table("documents", "doc_id", "text"), [t for (t,) in table("benchmark", "text")])


def test_resampling_query_equals_sql(spark):
    same(QUERIES["op13_target_resampling"](spark, SF), SF, ORACLE_SQL["op13_target_resampling"])


def test_cut_by_bracketing(spark):
    rng = random.Random(2)
    tables = [[rng.randint(-(10**12), 10**12) for _ in range(4000)], [rng.choice([0, 0, 0, 1, 5]) for _ in range(3000)], [7] * 500, [*range(1000), *[500] * 3000], [-3]]
    for values in tables:
        rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
        for k in sorted({1, len(values) // 3 or 1, len(values) // 2 or 1, len(values)}):
            want = sorted(values)[k - 1]
            for accuracy, most in ((10_000, 100), (20, 100), (10_000, 1)):  # a coarse sketch has to be widened
                assert target_resampling.kth_value(rows, "v", k, accuracy, most) == (want, sum(v < want for v in values))
