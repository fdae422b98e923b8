"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .fm_dedup import substring_dedup
from .jaccard_join import jaccard_classes
from .language import identify
from .mixing import mix_plan
from .pii import find_pii
from .prefix_trie import prefix_trie
from .quality import quality_sample
from .suffix_dedup import suffix_dedup
from .target_resampling import target_resample
from .token_output import token_output
from .toxicity import toxicity

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_shards")).alias("taken"), F.col("mix_shards").alias("shards"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rank = {k: i for i, k in enumerate(("email", "ip", "card", "phone", "number", "secret", "contact"))}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), word_tokenizer())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_token_output": op9_token_output,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_target_resampling": op13_target_resampling,
}

#: The CRC-32 byte table, and a function of it for the UTF-8 bytes of x.
CRC_TABLE = """steps AS (
            SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8)"""


def crc_sql(x: str) -> str:
    byte = f"('0x' || substr(hex(encode({x})), 2 * k::INT + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))), lambda k: {byte})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL = {
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, translate(coalesce(text, ''), {SPACES}, '') AS norm FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
    "op12_prefix_trie": f"""
        WITH RECURSIVE {CRC_TABLE},
        o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT conv_id, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
        built AS (
            SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.pos <= i.h
            UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN o ON o.conv_id = i.conv_id AND o.pos > i.h
        ),
        paths AS (
            SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(r := role, t := text)) OVER w AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
            FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT conv_id, 0, [], 0 FROM ids
        ),
        nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY ALL),
        named AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM paths p JOIN nodes n USING (depth, path)),
        kids AS (SELECT n.conv_id, n.depth, n.n_convs, n.words, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN named u ON u.member = n.conv_id AND u.depth = n.depth - 1),
        counts AS (SELECT k.*, count(c.depth) AS n_children FROM kids k LEFT JOIN kids c ON c.parent_conv_id = k.conv_id AND c.depth = k.depth + 1 GROUP BY ALL),
        totals AS (SELECT a.conv_id, a.depth, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens FROM counts c JOIN named a ON a.member = c.conv_id AND a.depth <= c.depth GROUP BY ALL),
        ends AS (SELECT conv_id, depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM (SELECT member, depth, conv_id, max(depth) OVER (PARTITION BY member) AS deepest FROM named) WHERE depth = deepest GROUP BY ALL)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM counts JOIN totals USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
    """,
    "op13_target_resampling": f"""
        WITH RECURSIVE {CRC_TABLE},
        texts AS (SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
        words AS (SELECT target, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
        places AS (SELECT target, r, unnest(w) AS w1, unnest(range(len(w))) AS i FROM words),
        grams AS (SELECT target, r, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3 FROM places WINDOW o AS (PARTITION BY target, r ORDER BY i)),
        features AS (SELECT target, r, unnest([w1, w2, w3]) AS f FROM grams),
        counted AS (SELECT target, r, f, count(*) AS n FROM features WHERE f IS NOT NULL GROUP BY ALL),
        buckets AS (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM counted), crc),
        sums AS (SELECT b, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM counted JOIN buckets USING (f) GROUP BY b),
        whole AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM sums),
        gains AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM sums, whole),
        weighed AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN buckets USING (f) JOIN gains USING (b) WHERE target = 0 GROUP BY r),
        scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN weighed USING (r) WHERE target = 0
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
    """,
}
