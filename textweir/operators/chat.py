"""Conversation operators: gates, last-turn pick, provider payloads, responses.

Conversations come in long form ``(conv_id, turn, role, text)`` with ``turn`` a
non-negative ordinal. A conversation may be of any length, so nothing gathers a
whole conversation into one row: per-conversation facts are partial
aggregates, and payloads are streamed into files, turn after turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textual import coerce_text
from ..policy import Policy
from ..session import materialize, work_path
from .scan import Models, scan

#: Turns of a conversation that share a join key with its verdict.
PART_TURNS = 1000
#: Characters of one written piece of a body.
_PIECE_CHARS = 1 << 20


# --- gates ---------------------------------------------------------------------

_BLOCK_PREFIX = "Blocked Input: "


def gate_conversations(df: DataFrame, policy: Policy, models: Models = Models()) -> DataFrame:
    """One row per conversation: the first block, in turn order, rejects it. Every role is checked as input."""
    scanned = scan(df, policy, models=models)
    block = F.when(F.col("action") == "blocked", F.struct("turn", "reason"))
    facts = scanned.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min(block).alias("f"))
    return facts.select("conv_id", "n_turns", F.col("f").isNotNull().alias("blocked"), F.col("f.turn").alias("blocked_turn"),
                        F.concat(F.lit(_BLOCK_PREFIX), F.col("f.reason")).alias("reason"))


def conversation_gate(df: DataFrame, policy: Policy, models: Models = Models()) -> DataFrame:
    """All turns with their sanitized text and the verdict on their conversation.

    The turns are scanned once and stored with their verdicts. Only rejected conversations are joined back.
    The join key holds a block of turns besides the conversation, so a very long conversation is
    spread over many tasks; its verdict is repeated once per block it has.
    """
    block = F.floor(F.col("turn") / PART_TURNS)
    turns = materialize(scan(df, policy, models=models).select(
        "conv_id", "turn", "role", "sanitized_text", F.when(F.col("action") == "blocked", F.col("reason")).alias("__reason"),
        block.alias("__block")), "gate")
    first = turns.filter("__reason is not null").groupBy("conv_id").agg(F.min(F.struct("turn", "__reason")).alias("f"))
    rejected = first.select("conv_id", F.concat(F.lit(_BLOCK_PREFIX), F.col("f.__reason")).alias("gate_reason"))
    blocks = turns.select("conv_id", "__block").distinct()
    verdicts = blocks.join(rejected, "conv_id").select("conv_id", "__block", "gate_reason")
    joined = turns.join(verdicts, ["conv_id", "__block"], "left")
    refused = F.col("gate_reason").isNotNull()
    return joined.select("conv_id", "turn", "role", F.when(~refused, F.col("sanitized_text")).alias("content"),
                         refused.alias("rejected"), "gate_reason")


def last_user_message(df: DataFrame) -> DataFrame:
    """Text of the last user turn, else of the last turn, else ``''``."""
    rank = F.struct(F.col("role") == "user", F.col("turn"))
    return df.groupBy("conv_id").agg(F.coalesce(F.max_by("text", rank), F.lit("")).alias("input_text"))


# --- requests ------------------------------------------------------------------

REQUEST_SCHEMA = (
    "model string, messages array<struct<role:string, content:string, name:string>>, "
    "temperature double, top_p double, n int, stream boolean, stop array<string>, "
    "max_tokens int, presence_penalty double, frequency_penalty double, "
    "logit_bias map<string,double>, user string, _corrupt string"
)
_PARAMETERS = ("model", "temperature", "top_p", "n", "stream", "stop", "max_tokens", "presence_penalty",
               "frequency_penalty", "logit_bias", "user")


def parse_requests(df: DataFrame, json_col: str = "request") -> DataFrame:
    """Nested chat requests -> long form ``(…, turn, role, text, name)`` and the request's parameters.

    ``stop`` may be one string or a list; a single string is read as a list of one. A request
    without messages is one row with a NULL turn; ``corrupt`` marks what is not a JSON object.
    """
    single_stop = F.regexp_replace(F.col(json_col), r'"stop"\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', r'"stop":[$1]')
    keep = [c for c in df.columns if c != json_col]
    parsed = F.from_json(single_stop, REQUEST_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    req = df.select(*keep, parsed.alias("__r"))
    return (req.select(*keep, "__r", F.posexplode_outer("__r.messages").alias("turn", "__m"))
            .select(*keep, "turn", F.col("__m.role").alias("role"), F.col("__m.content").alias("text"),
                    F.col("__m.name").alias("name"), *(F.col(f"__r.{p}").alias(p) for p in _PARAMETERS),
                    (F.col("__r").isNull() | F.col("__r._corrupt").isNotNull()).alias("corrupt")))


# --- payloads ------------------------------------------------------------------
# Field names of the two providers' request bodies.

def _json_string(col: Column) -> Column:
    wrapped = F.to_json(F.struct(col.alias("v")))  # {"v":"..."}
    return F.when(col.isNull(), F.lit("null")).otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def _field(df: DataFrame, name: str, kind: str, default: object) -> Column:
    """A parameter of the request: its column, or the default where that is missing or NULL."""
    given = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), given) if name in df.columns else given


def _messages_parts(df: DataFrame, defaults: dict) -> tuple[Column, Column, Column, Column]:
    name = [F.col("name").cast("string").alias("name")] if "name" in df.columns else []
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")), {"ignoreNullFields": "false"})
    named = F.to_json(F.struct(F.col("role"), F.col("text").alias("content"), *name), {"ignoreNullFields": "false"})
    message = F.when(F.col("name").isNotNull(), named).otherwise(plain) if name else plain
    head = F.concat(F.lit('{"model":'), _json_string(_field(df, "model", "string", defaults.get("model"))), F.lit(',"messages":['))
    limit = _field(df, "max_tokens", "int", defaults.get("max_tokens", 1024))
    tail = F.concat(F.lit('],"max_tokens":'), F.coalesce(limit.cast("string"), F.lit("null")))
    system = F.when(F.length("text") > 0, F.concat(F.lit(',"system":'), _json_string(F.col("text")))).otherwise(F.lit(""))
    return head, message, tail, system


def _contents_parts(df: DataFrame, defaults: dict) -> tuple[Column, Column, Column, Column]:
    role = F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("model"))
    keep = {"ignoreNullFields": "false"}
    message = F.to_json(F.struct(role.alias("role"), F.array(F.struct("text")).alias("parts")), keep)
    options = F.to_json(F.struct(*(_field(df, name, kind, defaults.get(name)).alias(field) for name, kind, field in (
        ("max_tokens", "int", "maxOutputTokens"), ("temperature", "double", "temperature"), ("top_p", "double", "topP")))), keep)
    tail = F.concat(F.lit('],"generationConfig":'), options)
    system = F.concat(F.lit(',"systemInstruction":'), F.to_json(F.struct(F.array(F.struct("text")).alias("parts")), keep))
    return F.lit('{"contents":['), message, tail, system


_APIS = {"messages": _messages_parts, "contents": _contents_parts}


def _stream_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to pieces of JSON lines ``{"conv_id":…,"body":…}``; a body is never held as a whole."""
    key, system, tail, some = None, "", "", False
    held: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(["".join(held)], pa.string())], names=["value"])
        held.clear()
        return out

    for batch in batches:
        for conv, head, message, end, given in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "message", "tail", "system"))):
            if conv != key:
                if key is not None:
                    held.append(f"{tail}{system}}}}}\n")
                held.append(f'{{"conv_id":{conv},"body":{head}')
                key, system, tail, some = conv, "", end, False
            if given is not None:
                system = given
            elif message is not None:
                held.append("," + message if some else message)
                some = True
            size += len(message or "") + len(given or "")
            if size > _PIECE_CHARS:
                yield flush()
                size = 0
    if key is not None:
        held.append(f"{tail}{system}}}}}\n")
    if held:
        yield flush()


def write_payloads(df: DataFrame, path: str, api: str = "messages", **defaults: object) -> None:
    """Request bodies of conversations as JSON lines ``{"conv_id":…,"body":…}`` below ``path``.

    ``df`` has conv_id (a whole number), turn, role, text, and may have name and each request's own parameters
    (model, max_tokens, temperature, top_p; those of its first row count), as ``parse_requests`` gives them;
    ``defaults`` stand for what is missing. ``api`` is 'messages' (system turns leave the list, the last
    one becomes ``system`` unless it is empty; 1024 tokens by default) or 'contents' (every role but
    ``user`` is ``model``, unset options are null). Rows without a turn hold parameters only; rows without a
    conv_id belong to no request.

    A conversation is one line whatever its length: turns are sorted within partitions and written in
    pieces, between which Spark's text writer puts a blank.
    """
    head, message, tail, system = _APIS[api](df, defaults)
    is_system = F.col("role").eqNullSafe("system") & F.col("turn").isNotNull()
    rows = df.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", head.alias("head"),
        F.when(~is_system & F.col("turn").isNotNull(), message).alias("message"), tail.alias("tail"), F.when(is_system, system).alias("system"))
    order = ["conv_id", "turn", "system", "message"]
    (rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_stream_bodies, "value string")
     .write.option("lineSep", " ").text(path))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(conv_id, body)`` of what ``write_payloads`` wrote; a body is JSON text."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", "conv_id bigint, body string").alias("r")).select("r.*")


def _payloads(df: DataFrame, api: str, **defaults: object) -> DataFrame:
    path = work_path(df.sparkSession, "payloads")
    write_payloads(df, path, api, **defaults)
    return read_payloads(df.sparkSession, path)


def payload_messages_api(df: DataFrame, model: str | None = None, max_tokens: int = 1024) -> DataFrame:
    """``(conv_id, body)`` for the messages API; a request's own parameters go before the given ones."""
    return _payloads(df, "messages", model=model, max_tokens=max_tokens)


def payload_contents_api(df: DataFrame, max_tokens: int | None = None, temperature: float | None = None,
                         top_p: float | None = None) -> DataFrame:
    """``(conv_id, body)`` for the contents API; a request's own parameters go before the given ones."""
    return _payloads(df, "contents", max_tokens=max_tokens, temperature=temperature, top_p=top_p)


# --- responses -----------------------------------------------------------------

_MESSAGES_RESPONSE = ("id string, model string, content array<struct<type:string, text:string>>, "
                      "usage struct<input_tokens:bigint, output_tokens:bigint>")


def _response(id_: Column, model: Column, content: Column, prompt: Column, completion: Column) -> list[Column]:
    return [id_.alias("id"), F.lit("chat.completion").alias("object"), F.lit(0).alias("created"),
            model.alias("model"), F.lit("assistant").alias("role"), content.alias("content"),
            F.lit("stop").alias("finish_reason"), prompt.alias("prompt_tokens"),
            completion.alias("completion_tokens"), F.lit(0).cast("bigint").alias("total_tokens")]


def normalize_messages_response(df: DataFrame, json_col: str = "response") -> DataFrame:
    """Text blocks concatenated; token counts default to 0."""
    keep = [c for c in df.columns if c != json_col]
    r = F.col("__r")
    texts = F.transform(F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: b["text"])
    zero = F.lit(0).cast("bigint")
    return df.withColumn("__r", F.from_json(json_col, _MESSAGES_RESPONSE)).select(
        *keep, *_response(r["id"], r["model"], F.coalesce(F.array_join(texts, ""), F.lit("")),
                          F.coalesce(r["usage"]["input_tokens"], zero),
                          F.coalesce(r["usage"]["output_tokens"], zero)))


def normalize_contents_response(df: DataFrame, model: Column, json_col: str = "response") -> DataFrame:
    """First part of the first candidate, ``''`` if absent, an error text on a wrong shape.

    Parsed by path, step by step, because a wrong shape must be told from an
    absent field: an object must be an object and a list a list where present.
    """
    keep = [c for c in df.columns if c != json_col]
    raw = F.col(json_col)

    def get(path: str) -> Column:
        value = F.get_json_object(raw, path)
        # an empty value of any type counts as absent
        return F.when(~value.isin("", "{}", "[]", "0", "false"), value)

    def opens(value: Column, ch: str) -> Column:
        return value.isNull() | value.startswith(ch)

    candidates, first = get("$.candidates"), F.get_json_object(raw, "$.candidates[0]")
    content, parts = F.get_json_object(first, "$.content"), get("$.candidates[0].content.parts")
    part = F.get_json_object(raw, "$.candidates[0].content.parts[0]")
    null_content = F.array_contains(F.json_object_keys(first), "content") & content.isNull()
    well_shaped = (F.get_json_object(raw, "$").startswith("{") & opens(candidates, "[") & opens(first, "{")
                   & ~F.coalesce(null_content, F.lit(False))
                   & opens(content, "{") & opens(parts, "[") & opens(part, "{"))
    text = F.coalesce(F.get_json_object(raw, "$.candidates[0].content.parts[0].text"), F.lit(""))
    body = F.when(F.coalesce(well_shaped, F.lit(False)), text).otherwise(F.lit("Error parsing Gemini response"))
    zero = F.lit(0).cast("bigint")
    return df.select(*keep, *_response(F.lit("gemini-response"), model, body, zero, zero))


def response_gate(df: DataFrame, policy: Policy, models: Models = Models()) -> DataFrame:
    """Gate ``(…, status, content)``: only content of a 200 is checked, as output."""
    keep = [c for c in df.columns if c not in ("status", "content")]
    checked = scan(df, policy, "content", "output", models)
    live = (F.col("status") == 200) & (F.length("content") > 0)
    blocked = F.coalesce(live & (F.col("action") == "blocked"), F.lit(False))
    redacted = F.coalesce(live, F.lit(False)) & ~blocked
    return checked.select(
        *keep, F.when(blocked, F.lit(400)).otherwise(F.col("status")).alias("status"),
        F.when(blocked, F.lit(None)).when(redacted, F.col("sanitized_text"))
        .otherwise(F.col("content")).alias("content"),
        F.when(blocked, F.lit("security_policy_violation_output")).alias("error_code"),
        F.when(blocked, F.concat(F.lit("Response blocked by security guardrails: "), F.col("reason")))
        .alias("error_message"))


# --- chain steps ---------------------------------------------------------------

def chain_step(df: DataFrame, policy: Policy, raw_col: str = "raw", check_input: bool = True,
               on_block: str = "keep", models: Models = Models()) -> DataFrame:
    """Coerce a message to text, validate it, and wrap the result for the next step."""
    keep = [c for c in df.columns if c != raw_col]
    checked = scan(df.withColumn("__text", coerce_text(F.col(raw_col))), policy, "__text",
                   "input" if check_input else "output", models)
    checked = fail_on_block(checked, "Blocked Request") if on_block == "fail" else checked
    return checked.select(*keep, F.struct(
        F.col("sanitized_text"), F.col(raw_col).alias("original_input"),
        F.struct("reason", "action").alias("metadata")).alias("result"), "valid")


def fail_on_block(scanned: DataFrame, prefix: str = "Blocked Request") -> DataFrame:
    """Fail the query at the first blocked row, with its reason."""
    message = F.concat(F.lit(f"{prefix}: "), F.col("reason"))
    # the check is part of a column that is kept, so it cannot be pruned away
    return scanned.withColumn("sanitized_text", F.when(
        F.col("action") == "blocked", F.raise_error(message).cast("string")).otherwise(F.col("sanitized_text")))
