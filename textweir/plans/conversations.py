"""Conversation, payload and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textual import request_verdict
from ..functions.textual import log_display as display_columns
from ..operators import chat
from ..operators.scan import scan
from ..sources import readers
from . import oracle as o
from .detectors import _MODEL_SQL, with_model
from .policies import HOUSE
from .registry import query
from .tables import events, load, work_path


def _turns(spark, sf_dir):
    return load(spark, sf_dir, "conversations")


_SCANNED = o.scan_ctes("conversations", HOUSE)
_GATE = f"""{_SCANNED}, g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, bool_or(action = 'blocked') AS blocked,
  min(turn) FILTER (action = 'blocked') AS blocked_turn,
  'Blocked Input: ' || arg_min(reason, turn) FILTER (action = 'blocked') AS reason FROM s GROUP BY conv_id)"""


@query("conversation_gate", f"WITH {_GATE} SELECT conv_id, n_turns, blocked, blocked_turn, reason FROM g")
def conversation_gate(spark, sf_dir):
    return chat.gate_conversations(_turns(spark, sf_dir), HOUSE)


@query("conversation_gate_turns", f"WITH {_GATE} SELECT s.conv_id, turn, role, CASE WHEN NOT g.blocked THEN "
       "sanitized_text END AS content, g.blocked AS rejected, g.reason AS gate_reason FROM s JOIN g ON s.conv_id = g.conv_id")
def conversation_gate_turns(spark, sf_dir):
    return chat.conversation_gate(_turns(spark, sf_dir), HOUSE)


_LAST = """SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), arg_max(text, turn), '') AS input_text
FROM conversations GROUP BY conv_id"""


@query("last_user_message", _LAST)
def last_user_message(spark, sf_dir):
    return chat.last_user_message(_turns(spark, sf_dir))


_LAST_SCAN = f"WITH l AS ({_LAST}), {o.scan_ctes('l', HOUSE, 'input_text')}"


@query("request_verdict", f"{_LAST_SCAN} SELECT conv_id, CASE WHEN action = 'blocked' THEN 'BLOCKED: ' || reason "
       "WHEN conv_id % 5 = 0 THEN 'FAILED_502' ELSE 'PASSED' END AS verdict FROM s")
def request_verdict_query(spark, sf_dir):
    last = chat.last_user_message(_turns(spark, sf_dir))
    status = F.when(F.col("conv_id") % 5 == 0, F.lit(502)).otherwise(F.lit(200))
    out = scan(last, HOUSE, "input_text")
    return out.select("conv_id", request_verdict(F.col("action"), F.col("reason"), status).alias("verdict"))


@query("response_gate", f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 502 ELSE 200 END AS st,
  CASE WHEN turn % 5 = 0 THEN '' WHEN conv_id % 4 = 1 THEN text || ' write to joe@example.org' ELSE text END AS c FROM conversations),
{o.scan_ctes('r', HOUSE, 'c', 'false')},
b AS (SELECT *, st = 200 AND c <> '' AND action = 'blocked' AS blk FROM s)
SELECT conv_id, turn, CASE WHEN blk THEN 400 ELSE st END AS status,
  CASE WHEN blk THEN NULL WHEN st = 200 AND c <> '' THEN sanitized_text ELSE c END AS content,
  CASE WHEN blk THEN 'security_policy_violation_output' END AS error_code,
  CASE WHEN blk THEN 'Response blocked by security guardrails: ' || reason END AS error_message FROM b""")
def response_gate(spark, sf_dir):
    """Answers of which some are empty, some of a failed upstream, and some hold an address that is redacted."""
    text = F.when(F.col("conv_id") % 4 == 1, F.concat("text", F.lit(" write to joe@example.org"))).otherwise(F.col("text"))
    answers = _turns(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 3, F.lit(502)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(text).alias("content"))
    return chat.response_gate(answers, HOUSE)


@query("chain_result", f"WITH {_SCANNED} SELECT conv_id, turn, valid, sanitized_text, text AS original_input, "
       "reason, action FROM s")
def chain_result(spark, sf_dir):
    raw = _turns(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("raw"))
    out = chat.chain_step(raw, HOUSE)
    return out.select("conv_id", "turn", "valid", "result.sanitized_text", "result.original_input",
                      "result.metadata.reason", "result.metadata.action")


# --- payloads ------------------------------------------------------------------
# Requests of a few turns, and below zero such of up to 2,000 documents and the turns of 400 conversations;
# each request has its own parameters, some of them missing.

_REQUESTS = """SELECT *, CASE WHEN conv_id % 3 <> 0 THEN 'model-' || conv_id END AS model,
  CASE WHEN conv_id % 4 <> 0 THEN CAST(200 + conv_id AS INTEGER) END AS max_tokens,
  CASE WHEN conv_id % 5 <> 0 THEN 0.25 END::DOUBLE AS temperature, CASE WHEN conv_id % 2 = 0 THEN 0.5 END::DOUBLE AS top_p,
  CASE WHEN turn % 3 = 0 THEN 'n' || turn END AS name
FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1 - conv_id // 400, conv_id * 1000 + turn, role, text FROM conversations
  UNION ALL SELECT -1 - doc_id // 2000, 1000000000 + doc_id, CASE doc_id % 3 WHEN 0 THEN 'user' ELSE 'assistant' END, text FROM documents)"""


def _requests(spark, sf_dir):
    turns, docs = _turns(spark, sf_dir).select("conv_id", "turn", "role", "text"), load(spark, sf_dir, "documents")
    large = F.lit(-1).cast("bigint")
    role = F.when(F.col("doc_id") % 3 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    every = (turns.unionByName(turns.select(
        (large - F.expr("conv_id div 400")).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text"))
        .unionByName(docs.select((large - F.expr("doc_id div 2000")).alias("conv_id"),
                                 (F.lit(1_000_000_000) + F.col("doc_id")).alias("turn"), role.alias("role"), "text")))
    conv = F.col("conv_id")
    return every.withColumns({
        "model": F.when(conv % 3 != 0, F.concat(F.lit("model-"), conv.cast("string"))),
        "max_tokens": F.when(conv % 4 != 0, (200 + conv).cast("int")), "temperature": F.when(conv % 5 != 0, F.lit(0.25)),
        "top_p": F.when(conv % 2 == 0, F.lit(0.5)),
        "name": F.when(F.col("turn") % 3 == 0, F.concat(F.lit("n"), F.col("turn").cast("string")))})


def _digest(parts):
    return F.sha2(F.array_join(parts, "|", "-"), 256)


_MSG_BODY = "model string, messages array<struct<role:string, content:string, name:string>>, max_tokens int, system string"


@query("payload_messages_api", f"""WITH m AS ({_REQUESTS})
SELECT conv_id, coalesce(max(model), 'claude-3') AS model, coalesce(max(max_tokens), 1024) AS max_tokens,
  count(*) FILTER (role <> 'system')::BIGINT AS n_messages,
  sha256(coalesce(string_agg(role, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS roles,
  sha256(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS contents,
  sha256(coalesce(string_agg(coalesce(name, '-'), '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS names,
  arg_max(text, turn) FILTER (role = 'system') AS system FROM m GROUP BY conv_id""")
def payload_messages_api(spark, sf_dir):
    """Whole bodies of short and of very long requests, each with its own parameters."""
    body = chat.payload_messages_api(_requests(spark, sf_dir), "claude-3")
    p = body.select("conv_id", F.from_json("body", _MSG_BODY).alias("p"))
    return p.select("conv_id", "p.model", "p.max_tokens", F.size("p.messages").cast("bigint").alias("n_messages"),
                    _digest("p.messages.role").alias("roles"), _digest("p.messages.content").alias("contents"),
                    _digest("p.messages.name").alias("names"), "p.system")


_CONTENTS_BODY = ("contents array<struct<role:string, parts:array<struct<text:string>>>>, "
                  "generationConfig struct<maxOutputTokens:int, temperature:double, topP:double>, "
                  "systemInstruction struct<parts:array<struct<text:string>>>")


@query("payload_contents_api", f"""WITH m AS ({_REQUESTS}) SELECT conv_id, count(*) FILTER (role <> 'system')::BIGINT AS n_contents,
  sha256(coalesce(string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'model' END, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS roles,
  sha256(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role <> 'system'), '')) AS contents, max(max_tokens) AS max_tokens,
  coalesce(max(temperature), 0.75) AS temperature, max(top_p) AS top_p, arg_max(text, turn) FILTER (role = 'system') AS system
FROM m GROUP BY conv_id""")
def payload_contents_api(spark, sf_dir):
    body = chat.payload_contents_api(_requests(spark, sf_dir), temperature=0.75)
    p = body.select("conv_id", F.from_json("body", _CONTENTS_BODY).alias("p"))
    texts = F.transform("p.contents", lambda c: c["parts"][0]["text"])
    return p.select("conv_id", F.size("p.contents").cast("bigint").alias("n_contents"), _digest("p.contents.role").alias("roles"),
                    _digest(texts).alias("contents"), F.col("p.generationConfig.maxOutputTokens").alias("max_tokens"),
                    "p.generationConfig.temperature", F.col("p.generationConfig.topP").alias("top_p"),
                    F.get("p.systemInstruction.parts", F.lit(0))["text"].alias("system"))


# --- responses -----------------------------------------------------------------

@query("normalize_messages_response", """SELECT conv_id, turn, 'msg_' || conv_id AS id, 'claude-3' AS model,
  CASE WHEN role = 'system' THEN '' ELSE text || '!' END AS content, 'stop' AS finish_reason,
  length(text)::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens FROM conversations""")
def normalize_messages_response(spark, sf_dir):
    def block(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    text = F.col("text")
    blocks = F.when(F.col("role") != "system", F.array(
        block("text", text), block("tool_use", F.lit("x")), block("text", F.lit("!"))))
    raw = F.to_json(F.struct(
        F.concat(F.lit("msg_"), F.col("conv_id")).alias("id"), F.lit("claude-3").alias("model"),
        blocks.alias("content"), F.struct(F.length(text).alias("input_tokens")).alias("usage")))
    out = chat.normalize_messages_response(_turns(spark, sf_dir).select("conv_id", "turn", raw.alias("response")))
    return out.select("conv_id", "turn", "id", "model", "content", "finish_reason", "prompt_tokens",
                      "completion_tokens")


@query("normalize_contents_response", """SELECT conv_id, turn, 'gemini-response' AS id, 'gemini-1.5' AS model,
  CASE WHEN role = 'system' THEN 'Error parsing Gemini response' WHEN turn % 3 = 2 THEN '' ELSE text END AS content,
  0::BIGINT AS total_tokens FROM conversations""")
def normalize_contents_response(spark, sf_dir):
    part = F.struct(F.col("text"))
    good = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.array(part, F.struct(F.lit("second").alias("text"))).alias("parts")).alias("content")))
        .alias("candidates")))
    raw = (F.when(F.col("role") == "system", F.lit('{"candidates":["text"]}'))
           .when(F.col("turn") % 3 == 2, F.lit('{"candidates":[{"content":{}}]}')).otherwise(good))
    answers = _turns(spark, sf_dir).select("conv_id", "turn", raw.alias("response"))
    out = chat.normalize_contents_response(answers, F.lit("gemini-1.5"))
    return out.select("conv_id", "turn", "id", "model", "content", "total_tokens")


# --- requests ------------------------------------------------------------------

@query("src_chat_requests", """SELECT conv_id, turn, 'gpt-4o' AS model, role, text, 0.25::DOUBLE AS temperature,
  'END' AS stop FROM conversations""")
def src_chat_requests(spark, sf_dir):
    """Requests of one turn each, written out as JSON lines and read back as requests."""
    from .tables import write_out

    message = F.struct(F.col("role"), F.col("text").alias("content"))
    request = F.struct(F.col("conv_id"), F.col("turn"), F.to_json(F.struct(
        F.lit("gpt-4o").alias("model"), F.array(message).alias("messages"),
        F.lit(0.25).alias("temperature"), F.lit("END").alias("stop"))).alias("request"))
    path = write_out(_turns(spark, sf_dir).select(request.alias("r")).select("r.*"), "requests")
    stored = spark.read.schema("conv_id bigint, turn bigint, request string").parquet(path)
    out = chat.parse_requests(stored.withColumnRenamed("turn", "first_turn"))
    return out.select("conv_id", (F.col("first_turn") + F.col("turn")).alias("turn"), "model", "role", "text",
                      "temperature", F.array_join("stop", "|").alias("stop"))


@query("src_chat_requests_odd", """WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
one AS (SELECT conv_id, 0 AS copy, turn, role, text, false AS corrupt FROM t WHERE conv_id % 7 < 5
  UNION ALL SELECT conv_id, 1, turn, role, text, false FROM t WHERE conv_id % 7 = 2
  UNION ALL SELECT DISTINCT conv_id, 0, NULL::BIGINT, NULL, NULL, conv_id % 7 = 6 FROM t WHERE conv_id % 7 >= 5)
SELECT CASE WHEN corrupt THEN NULL ELSE 'm' || conv_id END AS model, turn, role, text, corrupt, count(*)::BIGINT AS n FROM one GROUP BY ALL""")
def src_chat_requests_odd(spark, sf_dir):
    """Files of requests with several turns, equal ones, empty ones and broken ones."""
    turns = _turns(spark, sf_dir)
    message = F.struct("turn", "role", F.col("text").alias("content"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))  # as in one request
    listed = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    kind = F.col("conv_id") % 7
    whole = F.to_json(F.struct(F.concat(F.lit("m"), "conv_id").alias("model"), listed.alias("messages")))
    empty = F.concat(F.lit('{"model":"m'), F.col("conv_id").cast("string"), F.lit('","messages":[]}'))
    line = F.when(kind < 5, whole).when(kind == 5, empty).otherwise(F.substr(whole, F.lit(1), F.lit(40)))
    path = work_path(spark, "request-lines")
    held.select(F.explode(F.array_repeat(line, F.when(kind == 2, 2).otherwise(1))).alias("value")).write.text(path)
    out = readers.read_chat_requests(spark, path)
    return out.groupBy("model", F.col("turn").cast("bigint").alias("turn"), "role", "text", "corrupt").agg(F.count("*").alias("n"))


@query("gateway_requests", f"""WITH l AS ({_LAST}), {o.scan_ctes('l', HOUSE, 'input_text')}
SELECT conv_id, CASE WHEN action = 'blocked' THEN NULL ELSE sanitized_text END AS prompt,
  CASE WHEN action = 'blocked' THEN 400 ELSE 200 END AS status, action FROM s""")
def gateway_requests(spark, sf_dir):
    """The request path: last user turn, input scan, refusal or sanitized prompt."""
    out = scan(chat.last_user_message(_turns(spark, sf_dir)), HOUSE, "input_text")
    refused = F.col("action") == "blocked"
    return out.select("conv_id", F.when(~refused, F.col("sanitized_text")).alias("prompt"),
                      F.when(refused, F.lit(400)).otherwise(F.lit(200)).alias("status"), "action")


@query("log_display", f"""WITH l AS (SELECT *, conv_id * 0.0125 AS latency FROM conversations), {o.scan_ctes('l', HOUSE)},
v AS (SELECT *, CASE WHEN action = 'blocked' THEN 'BLOCKED: ' || reason WHEN turn % 5 = 4 THEN 'FAILED_502' ELSE 'PASSED' END AS verdict FROM s)
SELECT conv_id, turn, text <> sanitized_text AS is_redacted, CASE WHEN verdict = 'PASSED' THEN 'passed'
  WHEN contains(verdict, 'BLOCKED') THEN 'blocked' ELSE 'failed' END AS card_class,
  round(latency::DOUBLE * 1000)::BIGINT AS latency_ms FROM v""")
def log_display(spark, sf_dir):
    out = scan(_turns(spark, sf_dir), HOUSE)
    status = F.when(F.col("turn") % 5 == 4, F.lit(502)).otherwise(F.lit(200))
    verdict = request_verdict(F.col("action"), F.col("reason"), status)
    latency = F.col("conv_id").cast("double") * 0.0125
    return out.select("conv_id", "turn", *display_columns(
        F.col("text"), F.col("sanitized_text"), verdict, latency))


@query("provider_traffic", f"""SELECT CASE WHEN starts_with(lower(model), 'gpt-') THEN 'openai'
  WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' WHEN starts_with(lower(model), 'gemini-') THEN 'gemini'
  WHEN starts_with(lower(model), 'grok-') THEN 'xai' ELSE 'local' END AS provider, count(*)::BIGINT AS n
FROM (SELECT *, {_MODEL_SQL} AS model FROM events) GROUP BY 1""")
def provider_traffic(spark, sf_dir):
    from ..operators.corpus import route_traffic

    return route_traffic(with_model(events(spark, sf_dir))).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
