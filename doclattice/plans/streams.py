"""Registered queries over streams, with their oracle SQL: what is closed by the last watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.keyed import KeyedTable
from ..sources.sinks import shared_folder
from ..streaming import state, streams
from .corpus import query, table


def event_stream(spark, d, name="events"):
    """The files of a table as a stream, whether it is one file or a folder of them."""
    path = f"{d}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    return streams.read_folder(spark, path if folder else d, "*.parquet" if folder else f"{name}.parquet", table(spark, d, name).schema)


LAST = "(SELECT max(ts) FROM events)"


@query(f"SELECT day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day FROM events) WHERE day + INTERVAL 1 DAY <= {LAST} - INTERVAL 10 MINUTE GROUP BY day, event_type")
def stream_event_counts(spark, d):
    """Daily counts of the events, read as a stream until what is there is used up; the last window stays open and isn't emitted."""
    flat = streams.windowed_counts(event_stream(spark, d)).select(F.col("w.start").alias("day"), "event_type", "n", "total")
    return state.to_table(flat, shared_folder(spark))


TTL, CAPACITY = 2 * 86400, 5


@query(f"""WITH s AS (SELECT user_id AS owner, event_id AS session_id, epoch_us(ts) // 1000 AS created_ms, lead(epoch_us(ts) // 1000, {CAPACITY}) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS pushed FROM events)
SELECT owner, session_id, created_ms, CASE WHEN pushed <= created_ms + {TTL * 1000} THEN pushed ELSE created_ms + {TTL * 1000} END AS ended_ms, CASE WHEN pushed <= created_ms + {TTL * 1000} THEN 'capacity' ELSE 'time' END AS reason FROM s WHERE created_ms + {TTL * 1000} < epoch_us({LAST}) // 1000 - 600000""")
def session_ends(spark, d):
    """How every session ended that can't be open any more: pushed out by newer ones of its owner, or by its time to live."""
    puts = event_stream(spark, d).select(F.col("user_id").alias("owner"), F.col("event_id").alias("session_id"), F.col("ts").cast("timestamp").alias("created"))
    with state.rocks(spark):
        return state.to_table(state.session_ends(puts, TTL, CAPACITY, "10 minutes"), shared_folder(spark))


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS file_hash FROM documents")
def replay_safe_files(spark, d):
    """File hashes that a stream lets pass: a file that comes again inside the watermark doesn't."""
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600)
    files = event_stream(spark, d, "documents").select(T.file_hash(F.coalesce("text", F.lit(""))).alias("file_hash"), arrived.alias("arrived"))
    return state.to_table(streams.once_only(files).select("file_hash"), shared_folder(spark))


PROGRESS = r"^\[(\d+)/(\d+)\] (\w+) user"
LINES = {"source": "'log ' || (user_id % 40)", "line_no": "event_id", "line": "CASE WHEN event_type = 'error' THEN 'ERROR at ' || event_id ELSE '[' || event_id || '/' || user_id || '] ' || event_type || ' user' END"}


@query(f"""WITH l AS (SELECT {', '.join(f'{x} AS {c}' for c, x in LINES.items())} FROM events), m AS (SELECT source, max(line_no) AS line_no, max_by(line, line_no) AS line FROM l WHERE regexp_matches(line, '{PROGRESS}') GROUP BY source)
SELECT source, line_no, regexp_extract(line, '{PROGRESS}', 1) AS done, regexp_extract(line, '{PROGRESS}', 2) AS total, regexp_extract(line, '{PROGRESS}', 3) AS activity FROM m""")
def live_activity(spark, d):
    """The last activity of every log, followed as a stream into a keyed table."""
    folder = shared_folder(spark)
    found = KeyedTable(spark, f"{folder}/activity", state.ACTIVITY, ["source"], 8)
    lines = event_stream(spark, d).select(*[F.expr(x).alias(c) for c, x in LINES.items()])
    state.follow_logs(lines, PROGRESS, found, f"{folder}/checkpoint")
    return found.rows().select("source", "line_no", *[F.regexp_extract("line", PROGRESS, i + 1).alias(c) for i, c in enumerate(("done", "total", "activity"))])
