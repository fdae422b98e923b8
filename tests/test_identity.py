"""Identity of files: keys, titles, and the replay of decisions against a plain sequential registry."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from doclattice.functions import text as T
from doclattice.operators import components, identity

FILE = "tenant string, file_id long, arrival long, logical_key string, file_hash string, content_hash string, name string, code string, asset string, confidence string"


def plain(text):
    left = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", left.lower()))


def title(name):
    stem = name.rsplit("/", 1)[-1]
    cut = stem.rfind(".")
    stem = stem[:cut] if 0 < cut < len(stem) - 1 else stem
    stem = re.sub(r"\b(rev\.?\s*[a-z0-9]+|revision\s*[a-z0-9]+)\b", " ", stem, flags=re.I)
    return plain(re.sub(r"\b(20\d{2}[-_/]?\d{2}[-_/]?\d{2}|\d{2}[-_/]\d{2}[-_/]20\d{2})\b", " ", stem))


def sequential(rows):
    """The rules one file after another; records are searched one by one."""
    known, out = {}, {}
    for tenant, file_id, _, key, h, content, name, code, asset, confidence in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        records, latest = known.setdefault(tenant, ([], {}))
        low = confidence == "low"
        clash = [r for k, r in latest.items() if k != key]
        if h and any(r["h"] == h for r in records):
            said = "duplicate"
        elif code and any(r["code"] == code and (asset and r["asset"] and asset != r["asset"] or low or r["low"]) for r in clash):
            said = "review", "code"
        elif low and any(r["key"] != key and r["name"].lower() == name.lower() for r in records):
            said = "review", "name"
        elif low and title(name) and any(title(r["name"]) == title(name) for r in clash):
            said = "review", "title"
        elif key not in latest:
            said = "new_document"
        elif content and latest[key]["content"]:
            said = "same_content" if content == latest[key]["content"] else "new_version"
        else:
            said = "review" if low else "new_version"
        if said in ("new_document", "new_version"):
            rec = {"key": key, "h": h, "content": content, "name": name, "code": code, "asset": asset, "low": low}
            records.append(rec)
            if key not in latest or content and latest[key]["content"] != content:
                latest[key] = rec
        out[tenant, file_id] = said if isinstance(said, str) else said[0], said[1] if isinstance(said, tuple) else None
    return out


def some_files(seed, n=400):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(n):
        key = f"k{rng.randrange(30)}"
        name = pick(f"doc {rng.randrange(25)}.pdf", f"Doc {rng.randrange(25)} rev {rng.randrange(3)}.PDF", f"doc {rng.randrange(25)} 2024-01-1{rng.randrange(3)}.pdf", "rev 1.pdf", "readme.txt")
        rows.append((pick("t1", "t2"), i, rng.randrange(n), key, f"h{rng.randrange(200)}", pick(None, f"c{rng.randrange(4)}", f"c{rng.randrange(4)}"), name, pick("", "", f"C{rng.randrange(12)}"), pick("", "P-1", "P-2"), pick("low", "medium", "high", "high")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_sequential_registry(spark, seed):
    rows = some_files(seed)
    want = sequential(rows)
    got = identity.replay(spark.createDataFrame(rows, FILE).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        decision, rule = want[r["tenant"], r["file_id"]]
        assert r["decision"] == decision and rule in (None, r["rule"]), r
        assert r["indexed"] == (decision in ("new_document", "new_version"))
    assert {r["rule"] for r in got} == {"file_hash", "code", "name", "title", "new_key", "content_hash", "no_content_hash"}


def test_histories_are_smaller_than_tenants(spark):
    rows = [("t", i, i, f"k{i // 3}", f"h{i}", "c", f"n{i}.pdf", "", "", "high") for i in range(60)]
    rows += [("t", 100, 100, "a", "h100", "c", "same.pdf", "", "", "high"), ("t", 101, 101, "b", "h101", "c", "Same.pdf", "", "", "high")]  # no one is unsure
    rows += [("t", 102, 102, "d", "h102", "c", "x.pdf", "C", "P-1", "high"), ("t", 103, 103, "e", "h103", "c", "y.pdf", "C", "", "high"), ("t", 104, 104, "f", "h102", "c", "z.pdf", "", "", "high")]
    found = {r["file_id"]: r["history"] for r in identity.histories(spark.createDataFrame(rows, FILE)).collect()}
    assert len(set(found.values())) == 20 + 2 + 2
    assert found[102] == found[104] != found[103]


def test_replay_on_a_store(spark):
    stored = [("t", 1, "k", "h1", None, "Manual NCC-7 a.pdf", "", "active", True), ("t", 2, "k", "h2", "c2", "Manual.pdf", "", "indexed", False), ("t", 3, "k3", "h3", "c3", "x.pdf", "", "failed", True), ("t", 4, " ", "h4", "c4", "y.pdf", "", "active", True)]
    store = spark.createDataFrame(stored, "tenant string, doc_id long, logical_key string, file_hash string, content_hash string, name string, path string, status string, is_current boolean")
    files = [("t", 11, 1, "k", "h2", "c", "a.pdf", "", "", "high"), ("t", 12, 2, "k3", "h3", "c", "b.pdf", "", "", "high"), ("t", 13, 3, "k4", "h4", "c", "c.pdf", "", "", "high"), ("t", 14, 4, "k", "h5", "c2", "d.pdf", "", "", "low"), ("t", 15, 5, "z", "h6", "c", "e.pdf", "NCC-7", "", "low"), ("t", 16, 6, "y", "h7", "c", "manual.pdf", "", "", "low")]
    got = {r["file_id"]: (r["decision"], r["rule"]) for r in identity.replay(spark.createDataFrame(files, FILE), identity.known_versions(store)).collect()}
    # the current row of k has no content hash, so that nothing can be compared; only its name and code are known
    assert got == {11: ("duplicate", "file_hash"), 12: ("new_document", "new_key"), 13: ("new_document", "new_key"), 14: ("review", "no_content_hash"), 15: ("review", "code"), 16: ("new_document", "new_key")}
    assert identity.replay(spark.createDataFrame([], FILE)).count() == 0


NAMES = ["Bomba Rev 2.pdf", "Bomba revision b.pdf", "Guía_20240115.pdf", "x 15-01-2024 REV. c.docx", "a/b/Ñandú ﬁltro ½ ™ Ⅷ.tar.gz", ".hidden", "no suffix", "rev 1.pdf", "", "2024-01-15.pdf", "ÇA—Œuvre №5.pdf", "name."]


def test_titles_and_key_parts(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", T.title_key(F.col("n")).alias("t"), T.key_part(F.col("n")).alias("k")).collect()
    assert [(r["n"], r["t"], r["k"]) for r in rows] == [(n, title(n), plain(n)) for n in NAMES]


def test_logical_keys_leave_empty_parts_out(spark):
    rows = [("NCC-12 Ensayo.pdf", "Planta/MYC", "", ""), ("GUIGS-3 guía.docx", "", "", ""), ("Bomba Siemens FT-405 rev 2.pdf", "", "", ""), ("x.pdf", "", "K-1", ""), ("Manual.pdf", "", "", "S7"), (".pdf", "", "", "")]
    df = spark.createDataFrame([("T 1", "Local", "Guía", n, p, h, m) for n, p, h, m in rows], "tenant string, origin string, kind string, name string, path string, hint string, model string")
    got = [(r["logical_key"], r["confidence"]) for r in identity.with_identity(df).collect()]
    assert got == [("t 1|local|ncc 12|ncc 12|guia|myc", "high"), ("t 1|local|guigs 3|guia", "medium"), ("t 1|bomba siemens ft 405|ft 405 rev 2|siemens", "medium"), ("K-1", "high"), ("t 1|manual|s7", "low"), ("t 1|pdf", "low")]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    chain, star = [(i, i + 1) for i in range(200)], [(1000 + i, 1000) for i in range(1, 60)]
    loose = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = chain + star + loose
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}


def test_content_of_extractions(spark):
    schema = "id int, markdown string, format string, quality string, source_path string, counts array<struct<name:string,value:long>>, parts array<struct<name:string,title:string,text:string,markdown:string>>"
    rows = [(1, "Some  TEXT", "pdf", None, None, None, None), (2, None, "xlsx", "pass", "", [("sheet_count", 2), ("page_count", None)], [("S1", None, "t" * 600, None)] * 60), (3, None, None, "", None, None, None)]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows, schema).withColumn("h", identity.content_of_extraction()).select("id", "h").collect()}
    import hashlib

    want = "\n".join(["xlsx", "pass", "sheet_count:2"] + ["S1", "t" * 500] * 50)
    assert got == {1: hashlib.sha256(b"some text").hexdigest(), 2: hashlib.sha256(" ".join(want.lower().split()).encode()).hexdigest(), 3: None}


def test_histories_over_many_ranges(spark):
    """A key with half of all rows, null keys and null values, in one range and in many."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "b", None, f"k{i % 50}"]), rng.randrange(100), i, rng.choice([None, "x", "y"])) for i in range(2000)]
    want, last = {}, {}
    for key, at, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        n, before = last.get(key, (0, None))
        want[i] = (n + 1, before)
        last[key] = (n + 1, v)
    table = spark.createDataFrame(rows, "k string, at int, id int, v string").repartition(6)
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            got = identity.in_history(table.withColumnRenamed("k", "key"), "key", ["at", "id"], "v").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert {r["id"]: (r["nth"], r["before"]) for r in got} == want
