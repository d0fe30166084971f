"""Rate limits, audit, compliance, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, compliance, ratelimit
from ..operators.scan import scan
from ..session import materialize
from ..sources import readers, sinks
from . import oracle as o
from .policies import HOUSE, PII_ONLY, SHADOW
from .registry import query
from .tables import events, load, work_path

_DAY = 86400
_DAY_US = _DAY * 1_000_000


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


# --- rate limits ---------------------------------------------------------------

LIMIT_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, us, rn, true AS admitted, [us] AS log FROM e WHERE rn = 1
  UNION ALL SELECT event_id, user_id, us, rn, len(kept) < 3 AS admitted,
    CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END AS log
  FROM (SELECT e.event_id, e.user_id, e.us, e.rn, list_filter(r.log, lambda t: e.us - t < {_DAY_US}) AS kept
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, user_id, admitted FROM r"""


@query("rate_limit_batch", LIMIT_SQL)
def rate_limit_batch(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return ratelimit.rate_limit(log, "user_id", "ts", "event_id", 3, _DAY).drop("ts")


@query("rate_limit_rounds", LIMIT_SQL)
def rate_limit_rounds(spark, sf_dir):
    """The same result with the long stretches replayed in several rounds."""
    log = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return ratelimit.rate_limit(log, "user_id", "ts", "event_id", 3, _DAY, group_rows=50).drop("ts")


_TIMELESS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts"


def _with_gaps(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return log.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))


@query("rate_limit_untimed", LIMIT_SQL.replace("FROM events)", "FROM events WHERE event_id % 7 <> 0)")
       + " UNION ALL SELECT event_id, user_id, true FROM events WHERE event_id % 7 = 0")
def rate_limit_untimed(spark, sf_dir):
    """A log in which every seventh request has no time."""
    return ratelimit.rate_limit(_with_gaps(spark, sf_dir), "user_id", "ts", "event_id", 3, _DAY).drop("ts")


@query("request_rate_untimed", f"""SELECT event_id, user_id, CASE WHEN ts IS NOT NULL THEN count(*) OVER (
  PARTITION BY user_id, ts IS NULL ORDER BY epoch_us(ts) RANGE BETWEEN {_DAY_US - 1} PRECEDING AND CURRENT ROW)::BIGINT END AS rate
  FROM (SELECT event_id, user_id, {_TIMELESS} FROM events)""")
def request_rate_untimed(spark, sf_dir):
    return ratelimit.request_rate(_with_gaps(spark, sf_dir), "user_id", "ts", _DAY).drop("ts")


@query("request_rate", f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {_DAY_US - 1} PRECEDING AND CURRENT ROW)::BIGINT AS rate FROM events""")
def request_rate(spark, sf_dir):
    log = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return ratelimit.request_rate(log, "user_id", "ts", _DAY).drop("ts")


# --- audit ---------------------------------------------------------------------

_EVENTS_SQL = f"{o.scan_ctes('documents', HOUSE)}"


def _audit(spark, sf_dir, policy=HOUSE):
    scanned = scan(_docs(spark, sf_dir), policy)
    return audit.audit_events(scanned, policy, keys=("doc_id",))


_JSONL_SQL = (f"WITH {_EVENTS_SQL} SELECT doc_id, 'House_v1' AS profile, 'input' AS source, valid, action, reason, "
              "false AS shadow_mode, length(text)::BIGINT AS input_len FROM s")


@query("sink_audit_jsonl", _JSONL_SQL)
def sink_audit_jsonl(spark, sf_dir):
    path = work_path(spark, "audit-jsonl")
    out = _audit(spark, sf_dir)
    sinks.jsonl_sink(path)(out)
    back = spark.read.schema(out.schema).json(path)
    return back.select("doc_id", "profile", "source", "valid", "action", "reason", "shadow_mode",
                       F.col("input_len").cast("bigint").alias("input_len"))


@query("sink_audit_console", f"WITH {o.scan_ctes('documents', SHADOW)} SELECT doc_id, '[Audit] ' || CASE WHEN valid THEN "
       "'ALLOWED' ELSE 'BLOCKED' END || ' (SHADOW) | Rule: ' || reason || ' | Latency: n/ams' AS line FROM s")
def sink_audit_console(spark, sf_dir):
    """The lines go through the sink on the executors (which prints none of them here), and are returned."""
    out = materialize(_audit(spark, sf_dir, SHADOW), "console")
    sinks.console_sink(lambda line: None)(out)
    return out.select("doc_id", audit.console_line().alias("line"))


@query("sink_audit_null", "SELECT count(*)::BIGINT AS n FROM documents")
def sink_audit_null(spark, sf_dir):
    out = _audit(spark, sf_dir)
    sinks.null_sink()(out)
    return out.agg(F.count(F.lit(1)).alias("n"))


_VERDICT_SQL = "CASE WHEN action = 'blocked' THEN 'BLOCKED: ' || reason ELSE 'PASSED' END"


def _gateway(spark, sf_dir):
    verdict = F.when(F.col("action") == "blocked", F.concat(F.lit("BLOCKED: "), F.col("reason"))).otherwise("PASSED")
    scanned = scan(_docs(spark, sf_dir), HOUSE)
    return audit.gateway_rows(scanned, "doc_id", verdict, F.lit(0.5), F.struct("action"))


@query("sink_audit_table", f"WITH {_EVENTS_SQL} SELECT doc_id::VARCHAR AS client_ip, sha256(text) AS original_prompt, "
       f"sanitized_text AS sanitized_prompt, {_VERDICT_SQL} AS verdict, 0.5::DOUBLE AS latency, "
       "'{\"action\":\"' || action || '\"}' AS metadata, 7::BIGINT AS batch_id FROM s")
def sink_audit_table(spark, sf_dir):
    path = work_path(spark, "audit-table")
    sinks.table_sink(path)(_gateway(spark, sf_dir), 7)
    back = spark.read.option("mergeSchema", "false").parquet(path)
    return back.select("client_ip", "original_prompt", "sanitized_prompt", "verdict", "latency", "metadata",
                       F.col("batch_id").cast("bigint").alias("batch_id"))


def _two_batches(spark, sf_dir):
    """An audit table of two batches (even documents, then odd ones), and the mark after the first."""
    path = work_path(spark, "audit-batches")
    sink, rows = sinks.table_sink(path), _gateway(spark, sf_dir)
    odd = F.col("client_ip").cast("bigint") % 2
    sink(rows.filter(odd == 0), 1)
    mark = audit.high_water_mark(spark.read.parquet(path))
    sink(rows.filter(odd == 1), 2)
    return spark.read.parquet(path), mark


@query("audit_table_marks", f"WITH {_EVENTS_SQL} SELECT doc_id::VARCHAR AS client_ip, {_VERDICT_SQL} AS verdict, 2::BIGINT AS batch_id "
       "FROM s WHERE doc_id % 2 = 1")
def audit_table_marks(spark, sf_dir):
    """What a second batch adds to an audit table, seen from the mark after the first."""
    table, mark = _two_batches(spark, sf_dir)
    return audit.new_audit_rows(table, mark).select("client_ip", "verdict", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("audit_table_latest", "SELECT 2::BIGINT AS batch_id, least(20, count(*) FILTER (doc_id % 2 = 1))::BIGINT AS n FROM documents")
def audit_table_latest(spark, sf_dir):
    """The newest twenty rows are of the last batch."""
    table, _ = _two_batches(spark, sf_dir)
    return audit.audit_latest(table).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count("*").alias("n"))


@query("sink_result_json", f"WITH {_EVENTS_SQL} SELECT valid, action, reason, sanitized_text FROM s")
def sink_result_json(spark, sf_dir):
    path = work_path(spark, "result-json")
    sinks.result_json_sink(path)(scan(_docs(spark, sf_dir), HOUSE))
    return spark.read.schema("valid boolean, action string, reason string, sanitized_text string").json(path)


@query("audit_counts", f"""WITH {_EVENTS_SQL}, c AS (SELECT 'House_v1' AS profile, 'input' AS source, action,
  length(text) / 8.0::DOUBLE AS lat FROM s)
SELECT profile, source, action, count(*)::BIGINT AS n, round(avg(lat), 4) AS avg_latency_ms,
  grouping(profile, source, action)::BIGINT AS level FROM c GROUP BY CUBE (profile, source, action)""")
def audit_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("latency_ms", F.length("text") / 8.0)
    out = audit.audit_counts(audit.audit_events(scan(docs, HOUSE), HOUSE))
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


@query("rule_frequency", f"""WITH {_EVENTS_SQL}, l AS (SELECT unnest(string_split(triggered, '|')) AS label FROM s
  WHERE triggered <> '') SELECT label, count(*)::BIGINT AS n, split_part(label, ':', 1) AS detector FROM l GROUP BY label""")
def rule_frequency(spark, sf_dir):
    return audit.rule_frequency(scan(_docs(spark, sf_dir), HOUSE))


def _log_rows(spark, sf_dir):
    scanned = scan(_docs(spark, sf_dir), PII_ONLY)
    return scanned.select(F.col("doc_id").alias("id"), F.col("text").alias("original_prompt"),
                          F.col("sanitized_text").alias("sanitized_prompt"), F.lit("PASSED").alias("verdict"))


_LOG_SQL = f"""WITH {o.scan_ctes('documents', PII_ONLY)}, g AS (SELECT doc_id AS id, text AS original_prompt,
  sanitized_text AS sanitized_prompt, 'PASSED' AS verdict FROM s)"""


@query("audit_latest", f"{_LOG_SQL} SELECT * FROM g ORDER BY id DESC LIMIT 20")
def audit_latest(spark, sf_dir):
    return audit.audit_latest(_log_rows(spark, sf_dir))


@query("new_audit_rows", f"{_LOG_SQL} SELECT id, verdict, original_prompt <> sanitized_prompt AS notice FROM g WHERE id > 100")
def new_audit_rows(spark, sf_dir):
    return audit.new_audit_rows(_log_rows(spark, sf_dir), (100,)).select("id", "verdict", "notice")


# --- compliance ----------------------------------------------------------------

# every thirteenth prompt is blank, and every eleventh meets a failing upstream
_CORPUS = """corpus AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS prompt, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 0
  THEN 'redacted_or_blocked' ELSE 'passed' END AS expected FROM documents JOIN labels USING (doc_id))"""
_DETAILS = f"""WITH {_CORPUS}, {o.scan_ctes('corpus', HOUSE, 'prompt')},
d AS (SELECT doc_id, prompt, expected, reason, CASE WHEN prompt IS NOT NULL THEN action END AS action,
  CASE WHEN prompt IS NULL THEN NULL WHEN action = 'blocked' THEN 400 WHEN doc_id % 11 = 0 THEN 502 ELSE 200 END AS http_code,
  CASE WHEN prompt IS NULL THEN NULL WHEN action = 'blocked' THEN 'blocked' WHEN doc_id % 11 = 0 THEN 'error' ELSE 'passed' END AS status,
  CASE WHEN prompt IS NOT NULL THEN (CASE expected WHEN 'redacted_or_blocked' THEN action IN ('redacted', 'blocked') WHEN 'passed' THEN action <> 'blocked'
    ELSE action = 'blocked' END) AND (action = 'blocked' OR doc_id % 11 <> 0) END AS met FROM s)"""


def _details(spark, sf_dir):
    expected = (F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "redacted_or_blocked")
                .otherwise("passed"))
    corpus = _docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("prompt"), expected.alias("expected"))
    return compliance.run_corpus(corpus, HOUSE, upstream=F.when(F.col("doc_id") % 11 == 0, 502).otherwise(200))


@query("compliance_status", f"{_DETAILS} SELECT doc_id, expected, status, http_code, action, met FROM d")
def compliance_status(spark, sf_dir):
    return _details(spark, sf_dir).select("doc_id", "expected", "status", "http_code", "action", "met")


_SUMMARY = """count(*)::BIGINT AS total, count(*) FILTER (status = 'blocked')::BIGINT AS blocked,
  count(*) FILTER (status = 'passed')::BIGINT AS passed, count(*) FILTER (status = 'error')::BIGINT AS errors,
  round(count(*) FILTER (status = 'blocked') * 100.0::DOUBLE / count(*), 6) AS compliance_rate"""


@query("compliance_summary", f"{_DETAILS} SELECT {_SUMMARY} FROM d")
def compliance_summary(spark, sf_dir):
    out = compliance.compliance_summary(_details(spark, sf_dir))
    return out.withColumn("compliance_rate", F.round("compliance_rate", 6))


@query("compliance_confusion", f"{_DETAILS} SELECT expected, action AS actual, count(*)::BIGINT AS n, "
       "count(*) FILTER (met)::BIGINT AS n_met FROM d WHERE status IS NOT NULL GROUP BY 1, 2")
def compliance_confusion(spark, sf_dir):
    return compliance.compliance_confusion(_details(spark, sf_dir))


@query("sink_compliance_report", f"{_DETAILS} SELECT doc_id, status, http_code, prompt_preview FROM (SELECT *, CASE WHEN "
       "length(prompt) > 50 THEN substr(prompt, 1, 50) || '...' ELSE prompt END AS prompt_preview FROM d WHERE status IS NOT NULL)")
def sink_compliance_report(spark, sf_dir):
    path = work_path(spark, "report")
    sinks.compliance_report_sink(path, keys=("doc_id",))(_details(spark, sf_dir))
    stored = spark.read.schema("doc_id bigint, status string, http_code int, prompt_preview string")
    return stored.json(f"{path}/details")


@query("sink_compliance_summary", f"{_DETAILS} SELECT {_SUMMARY} FROM d")
def sink_compliance_summary(spark, sf_dir):
    """The summary of a written report, read back."""
    path = work_path(spark, "report")
    sinks.compliance_report_sink(path, keys=("doc_id",))(_details(spark, sf_dir))
    stored = spark.read.schema("total bigint, blocked bigint, passed bigint, errors bigint, compliance_rate double").json(f"{path}/summary")
    return stored.withColumn("compliance_rate", F.round("compliance_rate", 6))


# --- sources -------------------------------------------------------------------

@query("src_attack_csv", "SELECT text AS prompt, CASE WHEN role = 'user' THEN 'passed' ELSE 'blocked' END AS expected "
       "FROM conversations")
def src_attack_csv(spark, sf_dir):
    """Files with a header (even conversations) and without one in one folder."""
    turns = load(spark, sf_dir, "conversations")
    path = work_path(spark, "attacks")
    for odd, header in ((0, True), (1, False)):
        rows = turns.filter(F.col("conv_id") % 2 == odd).select(
            F.col("text").alias("prompt"), F.when(F.col("role") == "user", "passed").alias("expected"))
        rows.write.mode("append").option("header", header).option("escape", '"').option("quoteAll", True).option(
            "nullValue", "").option("emptyValue", "").csv(path)
    return readers.read_attack_csv(spark, path)


@query("src_text_files", "SELECT item_id, text FROM benchmark")
def src_text_files(spark, sf_dir):
    """Files of forty benchmark texts each, read back whole and cut at their marks."""
    path, mark = work_path(spark, "texts"), chr(1)
    rows = load(spark, sf_dir, "benchmark").select(F.concat_ws(mark, "item_id", "text").alias("value"))
    rows.write.option("lineSep", chr(2)).option("maxRecordsPerFile", 40).text(path)  # the files follow the rows
    files = readers.read_text_files(spark, path)
    rows = files.select(F.explode(F.split("text", chr(2))).alias("r")).filter("r <> ''")
    return rows.select(F.substring_index("r", mark, 1).cast("bigint").alias("item_id"),
                       F.regexp_replace("r", f"^[0-9]+{mark}", "").alias("text"))


@query("src_documents", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def src_documents(spark, sf_dir):
    docs = readers.read_documents(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n"))
