"""Operators with random or trained parts, and the pipeline, against plain computations of their whole results."""

import collections
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from doclattice.llm import decontamination, learn, quality
from doclattice.llm.queries import QUERIES

from .test_llm import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(name, *columns):
    table = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))
    return list(zip(*(table[c].to_pylist() for c in columns), strict=True))


def shares(sizes):
    """Targets by weight 5, 2, 1, repeating, of 150 % of all sizes, none above twice its source: sources are filled one after the other as the level rises."""
    weights = [Fraction((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    left, level, full = Fraction(3 * sum(sizes), 2), Fraction(0), {}
    for i in sorted(range(len(sizes)), key=lambda i: 2 * sizes[i] / weights[i]):
        free = sum(w for j, w in enumerate(weights) if j not in full)
        rise = 2 * sizes[i] / weights[i]
        if (rise - level) * free > left:
            level += left / free
            break
        left -= (rise - level) * free
        level, full[i] = rise, 2 * sizes[i]
    return [float(full.get(i, w * level)) for i, w in enumerate(weights)]


def test_mix_query_meets_plain_targets(spark):
    sources = dict(rows_of("documents", "doc_id", "source"))
    size = {i: len(WORD.findall(t or "")) for i, t in rows_of("documents", "doc_id", "text")}
    total = collections.Counter()
    for i, s in sources.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, shares([total[s] for s in order]), strict=True))
    got = QUERIES["op1_mix_sources"](spark, SF).collect()
    taken = collections.Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], total[sources[i]]) and math.isclose(r["target"], want[sources[i]])
        assert r["taken"] in (0, size[i], 2 * size[i])
        taken[sources[i]] += r["taken"]
    longest = {s: max(size[i] for i in size if sources[i] == s) for s in order}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in order)
    assert sorted((r["doc_id"], r["taken"]) for r in QUERIES["op1_mix_sources"](spark, SF).collect()) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_quality_draw_equals_a_plain_one(spark):
    """Counts, ratios, means and the draw of the k greatest keys, document by document."""
    docs, label = rows_of("documents", "doc_id", "text"), dict(rows_of("labels", "doc_id", "quality"))
    buckets, cells = 1 << 16, {}
    for i, t in docs:
        b, w = (t or "").encode(), WORD.findall(t or "")
        grams = [(int.from_bytes(b[k : k + 4], "little") * 0x9E3779B1 % (1 << 32)) >> 16 for k in range(len(b) - 3)]
        last = [next((d for d in range(1, 5) if k >= d and w[k - d] == w[k]), 0) for k in range(len(w))]
        cells[i] = grams, [last[k] * 25 + last[k + 1] * 5 + last[k + 2] for k in range(len(w) - 2)]
    ratios = []
    for part, n in ((0, buckets), (1, quality.RECENT)):
        raw, good = np.zeros(n), np.zeros(n)
        for i, both in cells.items():
            np.add.at(raw, both[part], 1)
            if label.get(i) == 1:
                np.add.at(good, both[part], 1)
        ratios.append(np.log(good + 1) - np.log(good.sum() + n) - np.log(raw + 1) + np.log(raw.sum() + n))
    x = {i: [ratios[p][both[p]].mean() if both[p] else 0.0 for p in (0, 1)] for i, both in cells.items()}
    known = [i for i, _ in docs if i in label and cells[i][0]]
    a, y = np.array([x[i] for i in known]), np.array([label[i] for i in known], float)
    mean, std = a.mean(axis=0), a.std(axis=0)
    clip = lambda v: np.clip((np.asarray(v) - mean) / std, -4, 4)
    w = learn.fit_logistic(clip(a), y)
    lowest = min(float(clip(v) @ w[:2] + w[2]) for v in a)
    odds = {i: float(clip(x[i]) @ w[:2] + w[2]) if cells[i][0] else lowest for i, _ in docs}
    u = {r["doc_id"]: r["u"] for r in spark.createDataFrame([(i,) for i, _ in docs], "doc_id long").withColumn("u", quality.uniform(F.col("doc_id"), 11)).collect()}
    key = {i: 4 * odds[i] - math.log(-math.log(u[i])) for i in odds}
    k = round(sum(1 / (1 + math.exp(-o)) for o in odds.values()))
    cut = sorted(key.values(), reverse=True)[k - 1]
    got = {r["doc_id"]: r["log_odds"] for r in QUERIES["op5_quality_classifier"](spark, SF).collect()}
    assert abs(len(got) - k) <= 1
    assert all(math.isclose(o, odds[i], abs_tol=1e-3) for i, o in got.items())
    assert {i for i in key if key[i] > cut + 0.01} <= set(got) <= {i for i in key if key[i] > cut - 0.01}


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least_edits(item, words):
    """Edit distance of an item's words to the nearest part of a text."""
    row = np.zeros(len(words) + 1, int)
    steps = np.arange(len(words) + 1)
    for i, w in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (words != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_pipeline_keeps_what_plain_rules_keep(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = {r["doc_id"] for r in QUERIES["op5_quality_classifier"](spark, SF).select("doc_id").collect()}
    texts = {i: t for i, t in rows_of("documents", "doc_id", "text") if i in drawn}
    assert {r["doc_id"] for r in p.quality(spark, docs, SF).collect()} == drawn
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(texts)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    unique = [i for i in order if root(i) == i]
    words = lambda t: (lambda r, s, e: np.array([r[a:b].tobytes() for a, b in zip(s, e, strict=True)], object))(*decontamination.word_spans(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[:3]) if t else np.zeros(0, object)
    ids = {}
    number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in words(t)], int)
    items = [number(t) for (t,) in rows_of("benchmark", "text")]
    clean = [i for i in unique if not any(len(item) and least_edits(item, number(texts[i])) <= len(item) // 5 for item in items)]
    kept = docs.where(F.col("doc_id").isin(unique))
    assert sorted(r["doc_id"] for r in p.decontaminate(spark, kept, SF).collect()) == clean
    whole = collections.Counter(r["doc_id"] for r in p.run(spark, SF).collect())
    assert set(whole) <= set(clean) and max(whole.values()) <= 2
    size = {i: len(WORD.findall(texts[i] or "")) for i in clean}
    share, source = collections.Counter(), dict(rows_of("documents", "doc_id", "source"))
    for i in clean:
        share[source[i]] += size[i]
    names = sorted(share, key=lambda s: (s is None, s or ""))
    for s, want in zip(names, shares([share[s] for s in names]), strict=True):
        assert abs(sum(n * size[i] for i, n in whole.items() if source[i] == s) - want) <= max(size[i] for i in clean if source[i] == s)
