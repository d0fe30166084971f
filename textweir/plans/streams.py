"""Streaming queries: each runs its source to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.readers import chunk_texts, read_chunk_stream
from ..streaming import live, ordered, sanitize
from . import oracle as o
from .operations import LIMIT_SQL, _DAY
from .policies import HOUSE, PII_ONLY, TOPICS_ONLY
from .registry import query
from .tables import drain, finish, load, stream, work_path

_CHUNK = 40
_ID = "conv_id || '-' || turn"


def _chunks(spark, sf_dir, ending: str = ""):
    """Every turn as a stream of chunks, straight from the table's file stream."""
    turns = stream(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("sid"), F.concat("text", F.lit(ending)).alias("text"))
    return chunk_texts(turns, "sid", "text", _CHUNK)


_STREAMED = (f"c AS (SELECT {_ID} AS stream_id, text FROM conversations WHERE text <> ''),\n"
             f"{o.sentence_rows('c', 'text', 'stream_id')},\n"
             f"{o.scan_ctes('sent_s', HOUSE, 'sentence', 'false')},\n"
             "em AS (SELECT stream_id, pos::BIGINT AS ord, action, CASE WHEN valid THEN sanitized_text ELSE "
             "'[BLOCKED: ' || reason || ']' END || separator AS emitted FROM s)")


@query("stream_sanitize", f"WITH {_STREAMED} SELECT stream_id, ord, action, emitted FROM em")
def stream_sanitize(spark, sf_dir):
    out = sanitize.sanitize_stream(_chunks(spark, sf_dir), HOUSE)
    return drain(out.select("stream_id", "ord", "action", "emitted"), "sanitized")


# A mark after every chunk; a sentence also ends where a mark follows its .?!
_MARK = chr(1)
_MARKED = f"""m AS (SELECT {_ID} AS stream_id, regexp_replace(text, '(?s)(.{{1,{_CHUNK}}})', '\\1{_MARK}', 'g') AS t FROM conversations),
p AS (SELECT stream_id, regexp_extract_all(t, '(?s)(?:.*?[.?!](?:{_MARK}|\\s+)|.+\\z)') AS raw FROM m),
q AS (SELECT stream_id, list_filter(list_transform(raw, lambda x: replace(x, '{_MARK}', '')), lambda x: x <> '') AS pieces FROM p),
u AS (SELECT stream_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM q),
v AS (SELECT *, CASE WHEN regexp_matches(piece, '[.?!]\\s+\\z') THEN regexp_replace(piece, '\\s+\\z', '') ELSE piece END AS sentence FROM u),
w AS (SELECT *, substr(piece, length(sentence) + 1) AS separator FROM v)"""


@query("stream_sanitize_chunk_mode", f"WITH {_MARKED}, {o.scan_ctes('w', HOUSE, 'sentence', 'false')} "
       "SELECT stream_id, pos::BIGINT AS ord, CASE WHEN regexp_matches(piece, '[.?!]\\s*\\z') THEN 'sentence' ELSE 'tail' "
       "END AS kind, action, CASE WHEN valid THEN sanitized_text ELSE '[BLOCKED: ' || reason || ']' END || separator AS emitted FROM s")
def stream_sanitize_chunk_mode(spark, sf_dir):
    """Sentences also end where a chunk ends in ``.?!``."""
    out = sanitize.sanitize_stream(_chunks(spark, sf_dir), HOUSE, mode="chunk")
    return drain(out.select("stream_id", "ord", "kind", "action", "emitted"), "chunk-mode")


_OPEN_END = " and then license"


@query("stream_flush", rf"""WITH t AS (SELECT conv_id || '-' || turn AS stream_id,
  regexp_extract(text || '{_OPEN_END}', '(?s)^(?:.*[.?!]\s+)?(.*)\z', 1) AS sentence FROM conversations),
{o.scan_ctes('t', HOUSE, 'sentence', 'false')}
SELECT stream_id, sentence, CASE WHEN valid THEN sanitized_text ELSE '[BLOCKED: ' || reason || ']' END AS emitted FROM s""")
def stream_flush(spark, sf_dir):
    """What is left of each stream when it ends; here every text ends in mid-sentence."""
    out = sanitize.sanitize_stream(_chunks(spark, sf_dir, _OPEN_END), HOUSE).filter("kind = 'tail'")
    return drain(out.select("stream_id", "sentence", "emitted"), "tails")


@query("stream_passthrough", f"SELECT {_ID} AS stream_id, count(*)::BIGINT AS n_pass, '' AS content FROM conversations "
       "GROUP BY ALL")
def stream_passthrough(spark, sf_dir):
    """One empty chunk in front of every stream comes out as it went in."""
    chunks = _chunks(spark, sf_dir)
    # seq 0 doubles into an empty chunk and the text's first chunk
    lead = F.when(F.col("seq") == 0, F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("chunk"),
                                                      F.lit(False).alias("eos"))))
    own = F.array(F.struct((F.col("seq") + 1).alias("seq"), F.col("chunk"), F.col("eos")))
    none = F.array().cast("array<struct<seq:bigint,chunk:string,eos:boolean>>")
    rows = chunks.select("stream_id", "ts", F.inline(F.concat(F.coalesce(lead, none), own)))
    out = sanitize.sentence_stream(rows.select("stream_id", "seq", "ts", "chunk", "eos")).filter("kind = 'pass'")
    got = drain(out.select("stream_id", "ord", F.col("sentence").alias("content")), "passed")
    return got.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_pass"), F.max("content").alias("content"))


@query("src_chunk_stream", f"""SELECT {_ID} AS stream_id, greatest(ceil(length(text) / {_CHUNK}.0), 1)::BIGINT AS n_chunks,
  length(text)::BIGINT AS n_chars FROM conversations""")
def src_chunk_stream(spark, sf_dir):
    """Chunk files written by a batch job, read back as a stream."""
    turns = load(spark, sf_dir, "conversations").withColumn("sid", F.concat_ws("-", "conv_id", "turn"))
    path = work_path(spark, "chunk-files")
    chunk_texts(turns, "sid", "text", _CHUNK).write.parquet(path)
    got = drain(read_chunk_stream(spark, path, max_files=4), "chunks")
    return got.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_chunks"),
                                        F.sum(F.length("chunk")).cast("bigint").alias("n_chars"))


_CLIENT = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 50 END"


@query("rate_limit_ordered", LIMIT_SQL.replace("event_id, user_id, epoch_us(ts) AS us", f"event_id, {_CLIENT} AS user_id, epoch_us(ts) AS us")
       .replace("PARTITION BY user_id", f"PARTITION BY {_CLIENT}").replace("< 3", "< 20"))
def rate_limit_ordered(spark, sf_dir):
    """Four micro-batches, one client with a third of all requests, and requests that arrive a batch late:
    each is decided at its place in time. The last row closes the stream."""
    log = load(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 50).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    feed = work_path(spark, "ordered-feed")
    bounds = log.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    share = (F.unix_micros("ts") - F.unix_micros(F.lit(bounds["low"]))) / (F.unix_micros(F.lit(bounds["high"])) - F.unix_micros(F.lit(bounds["low"])) + 1)
    lag = F.when(F.col("event_id") % 10 == 0, 0.1).otherwise(0.0)  # arrives later than its time says
    part = F.least(F.floor((share + lag) * 4), F.lit(3)).cast("int")
    closing = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(log.schema["user_id"].dataType).alias("user_id"),
                                    F.timestamp_add("DAY", F.lit(400), F.lit(bounds["high"])).alias("ts"))
    rows = log.withColumn("part", part).unionByName(closing.withColumn("part", F.lit(4)))
    for p in range(5):  # in this order, whatever the file times
        rows.filter(F.col("part") == p).drop("part").write.mode("append").parquet(f"{feed}/part={p}")
    out, state = work_path(spark, "ordered-out"), work_path(spark, "ordered-state")
    span = (bounds["high"] - bounds["low"]).total_seconds()
    for p in range(5):
        # a source that has grown by one part
        source = spark.readStream.schema(log.schema).parquet(f"{feed}/part=[0-{p}]")
        judged = ordered.rate_limit_in_order(source, "user_id", "ts", "event_id", 20, _DAY, late=f"{int(span * 0.2)} seconds",
                                             slot_seconds=span / 16)
        finish(judged.writeStream.format("parquet").option("path", out), spark, "ordered", checkpoint=state)
    return spark.read.parquet(out).filter("event_id >= 0").select("event_id", "user_id", "admitted")


@query("rate_limit_stream", LIMIT_SQL)
def rate_limit_stream(spark, sf_dir):
    log = stream(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = live.rate_limit_stream(log, "user_id", "ts", "event_id", 3, _DAY)
    return drain(out.select("event_id", "user_id", "admitted"), "admitted")


@query("audit_stream", f"WITH {o.scan_ctes('conversations', HOUSE)} SELECT conv_id, turn, 'House_v1' AS profile, "
       "'input' AS source, valid, action, reason, length(text)::BIGINT AS input_len FROM s")
def audit_stream(spark, sf_dir):
    verdicts, log = work_path(spark, "verdicts"), work_path(spark, "audit")
    body = live.audit_batch(lambda: HOUSE, [live.batch_parquet_sink(verdicts), sinks.jsonl_sink(log), sinks.null_sink()],
                            keys=("conv_id", "turn"))
    finish(stream(spark, sf_dir, "conversations").writeStream.foreachBatch(body), spark, "audit")
    stored = ("conv_id bigint, turn bigint, profile string, source string, valid boolean, action string, reason string, "
              "input_len int")
    return spark.read.schema(stored).json(f"{log}/batch_id=*").select("conv_id", "turn", "profile", "source", "valid", "action", "reason",
                                          F.col("input_len").cast("bigint").alias("input_len"))


@query("audit_tumbling", """SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day,
  event_type AS action, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def audit_tumbling(spark, sf_dir):
    feed = stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("action"))
    path = work_path(spark, "tumbling")
    counts = live.audit_tumbling(feed, window="1 day")

    def write(batch, batch_id):
        live.batch_parquet_sink(path)(batch, batch_id)

    finish(counts.writeStream.outputMode("update").foreachBatch(write), spark, "tumbling")
    # the last update of a window holds its count
    got = spark.read.schema("window_start timestamp, action string, n bigint, batch_id bigint").parquet(path)
    return got.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "action").agg(
        F.max_by("n", "batch_id").alias("n"))


@query("policy_hot_swap", f"""SELECT * FROM (WITH a AS (SELECT * FROM conversations WHERE turn % 2 = 0),
  {o.scan_ctes('a', TOPICS_ONLY)} SELECT conv_id, turn, 'Topics_only' AS policy, sanitized_text, action FROM s)
UNION ALL SELECT * FROM (WITH b AS (SELECT * FROM conversations WHERE turn % 2 = 1),
  {o.scan_ctes('b', PII_ONLY)} SELECT conv_id, turn, 'Pii_only' AS policy, sanitized_text, action FROM s)""")
def policy_hot_swap(spark, sf_dir):
    """Even turns arrive under one policy; it is replaced before the odd ones do.
    The second run goes on from the first one's checkpoint."""
    feed, out, state = (work_path(spark, n) for n in ("swap-feed", "swap-out", "swap-state"))
    turns = load(spark, sf_dir, "conversations")
    active = {"policy": TOPICS_ONLY}
    body = live.audit_batch(lambda: active["policy"], [live.batch_parquet_sink(out)])
    for parity, policy in ((0, TOPICS_ONLY), (1, PII_ONLY)):
        active["policy"] = policy
        turns.filter(F.col("turn") % 2 == parity).write.mode("append").parquet(feed)
        source = spark.readStream.schema(turns.schema).parquet(feed)
        finish(source.writeStream.foreachBatch(body), spark, "swap", checkpoint=state)
    return spark.read.parquet(out).select("conv_id", "turn", "policy", "sanitized_text", "action")
