import json

import pytest
from pyspark.sql import functions as F

from textweir import Policy
from textweir.functions.textual import coerce_text, log_display, preview, request_verdict, route_provider
from textweir.operators import chat

POLICY = Policy(name="p", pii_enabled=True, pii_patterns=("EMAIL",), topics=("crypto",))
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "mail a@b.co"), (1, 2, "assistant", "ok"), (1, 3, "system", "be brief"),
    (2, 0, "user", "crypto first"), (2, 1, "user", "a@b.co and crypto"), (2, 2, "user", "fine"),
    (3, 0, "assistant", "hello"), (4, 0, "system", "only"), (5, 0, "tool", "x\"y\n"), (5, 1, "user", ""),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")


def test_gate(turns):
    got = {r.conv_id: r for r in chat.gate_conversations(turns, POLICY).collect()}
    assert got[2].blocked and got[2].blocked_turn == 0 and got[2].reason == "Blocked Input: Topic:crypto"
    assert not got[1].blocked and got[1].reason is None and got[1].n_turns == 4


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_gate_turns(turns, monkeypatch, block):
    monkeypatch.setattr(chat, "PART_TURNS", block)
    got = {(r.conv_id, r.turn): r for r in chat.conversation_gate(turns, POLICY).collect()}
    assert len(got) == len(TURNS)
    assert all(got[2, t].rejected and got[2, t].content is None for t in range(3))
    assert got[1, 1].content == "mail <EMAIL_REDACTED>" and not got[1, 1].rejected


def test_last_user_message(turns):
    got = {r.conv_id: r.input_text for r in chat.last_user_message(turns).collect()}
    assert got == {1: "mail a@b.co", 2: "fine", 3: "hello", 4: "only", 5: ""}


def bodies(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: json.loads(r.body) for r in rows}


def expected(conv):
    return [t for t in TURNS if t[0] == conv]


def test_messages_payload(turns):
    got = bodies(chat.payload_messages_api(turns, "claude-3"))
    for conv in range(1, 6):
        want = {"model": "claude-3", "messages": [{"role": r, "content": t} for _, _, r, t in expected(conv) if r != "system"],
                "max_tokens": 1024}
        system = [t for _, _, r, t in expected(conv) if r == "system"]
        if system:
            want["system"] = system[-1]
        assert got[conv] == want


def test_contents_payload(turns):
    got = bodies(chat.payload_contents_api(turns, max_tokens=5))
    for conv in range(1, 6):
        want = {"contents": [{"role": "user" if r == "user" else "model", "parts": [{"text": t}]}
                             for _, _, r, t in expected(conv) if r != "system"],
                "generationConfig": {"maxOutputTokens": 5, "temperature": None, "topP": None}}
        system = [t for _, _, r, t in expected(conv) if r == "system"]
        if system:
            want["systemInstruction"] = {"parts": [{"text": system[-1]}]}
        assert got[conv] == want


def test_payloads_of_parsed_requests_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(chat, "_PIECE_CHARS", 700)
    texts = ["a\nb\r\u2028c", 'quo"te\\', "", None, "é😀", "}\n{", "x" * 3_000]
    requests = [
        {"model": "m1", "messages": [{"role": "user", "content": t} for t in texts], "max_tokens": 7, "temperature": 0.1, "top_p": 0.2},
        {"model": "m2", "messages": [{"role": "system", "content": "s1"}, {"role": "user", "content": "u", "name": "joe"},
                                     {"role": "system", "content": ""}]},
        {"messages": []},
        {"model": "m4", "messages": [{"role": "assistant", "content": f"t{i}"} for i in range(2_500)], "top_p": 0.5},
        {"model": "m5", "messages": [{"role": "user", "content": "q"}, {"role": "system", "content": "last"}], "max_tokens": 9}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(requests)] + [(None, json.dumps(requests[0]))]
    turns = chat.parse_requests(spark.createDataFrame(rows, "conv_id bigint, request string")).repartition(5)
    got, other = bodies(chat.payload_messages_api(turns)), bodies(chat.payload_contents_api(turns, temperature=1.5))
    assert set(got) == set(other) == set(range(5))
    for i, r in enumerate(requests):
        system = [m["content"] for m in r["messages"] if m["role"] == "system"]
        want = {"model": r.get("model"), "messages": [m for m in r["messages"] if m["role"] != "system"], "max_tokens": r.get("max_tokens", 1024)}
        if system and system[-1]:
            want["system"] = system[-1]
        assert got[i] == want
        want = {"contents": [{"role": "user" if m["role"] == "user" else "model", "parts": [{"text": m["content"]}]}
                             for m in r["messages"] if m["role"] != "system"],
                "generationConfig": {"maxOutputTokens": r.get("max_tokens"), "temperature": r.get("temperature", 1.5), "topP": r.get("top_p")}}
        if system:
            want["systemInstruction"] = {"parts": [{"text": system[-1]}]}
        assert other[i] == want
    assert chat.payload_messages_api(turns.limit(0)).collect() == []


def test_responses(spark):
    rows = ['{"id":"m","model":"c","content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}],'
            '"usage":{"input_tokens":3,"output_tokens":4}}', '{"id":"n","content":"text"}', "{}"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, response string")
    got = chat.normalize_messages_response(df).orderBy("i").collect()
    assert [(r.content, r.prompt_tokens, r.completion_tokens, r.total_tokens) for r in got] == [
        ("ab", 3, 4, 0), ("", 0, 0, 0), ("", 0, 0, 0)]
    bad = "Error parsing Gemini response"
    cases = [('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}', "a"), ('{"candidates":[]}', ""), ("{}", ""),
             ('{"candidates":[{}]}', ""), ('{"candidates":[{"content":{"parts":[]}}]}', ""), ('{"candidates":[{"content":[]}]}', bad),
             ('{"candidates":["x"]}', bad), ('{"candidates":{"a":1}}', bad), ("not json", bad), ("[]", bad),
             ('{"candidates":{}}', ""), ('{"candidates":null}', ""), ('{"candidates":"ab"}', bad),
             ('{"candidates":[{"content":null}]}', bad), ('{"candidates":[{"content":{"parts":{}}}]}', ""),
             ('{"candidates":[{"content":{"parts":["x"]}}]}', bad)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, response string")
    got = chat.normalize_contents_response(df, F.lit("g")).orderBy("i").collect()
    assert [r.content for r in got] == [w for _, w in cases]


def test_response_gate(spark):
    df = spark.createDataFrame([(1, 200, "crypto"), (2, 200, "a@b.co"), (3, 502, "crypto"), (4, 200, "")],
                               "i int, status int, content string")
    got = [(r.status, r.content, r.error_code) for r in chat.response_gate(df, POLICY).orderBy("i").collect()]
    assert got == [(400, None, "security_policy_violation_output"), (200, "<EMAIL_REDACTED>", None),
                   (502, "crypto", None), (200, "", None)]


def test_requests(spark):
    body = ('{"model":"gpt-4o","messages":[{"role":"user","content":"say \\"stop\\": \\"x\\""},{"role":"assistant","content":"b"}],'
            '"stop":"END","temperature":0.5}')
    listed = '{"model":"m","messages":[{"role":"user","content":"c"}],"stop":["A","B"],"logit_bias":{"5":1.5}}'
    df = spark.createDataFrame([(1, body), (2, listed)], "conv_id int, request string")
    got = chat.parse_requests(df).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [
        (1, 0, "user", 'say "stop": "x"'), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    assert got[0].stop == ["END"] and got[2].stop == ["A", "B"] and got[0].temperature == 0.5


def test_chain_step(spark):
    raws = ["plain a@b.co", '{"content":"x a@b.co"}', '{"content":"","text":"t"}', '{"k": 69}', "crypto"]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = chat.chain_step(df, POLICY).orderBy("i").collect()
    assert [r.result.sanitized_text for r in got][:4] == ["plain <EMAIL_REDACTED>", "x <EMAIL_REDACTED>", "t", '{"k": 69}']
    assert got[0].result.original_input == raws[0] and got[4].result.metadata.action == "blocked"
    with pytest.raises(Exception, match="Blocked Request: Topic:crypto"):
        chat.chain_step(df, POLICY, on_block="fail").collect()
    assert df.select(coerce_text(F.col("raw"))).count() == 5


def test_scalars(spark):
    models = ["GPT-4o", "o1-mini", "claude-3", "gemini-1.5", "grok-2", "llama3", "xgpt-"]
    df = spark.createDataFrame([(m,) for m in models], "m string").select(route_provider(F.col("m")).alias("p"))
    assert [tuple(r.p) for r in df.collect()] == [
        ("openai", "openai"), ("openai", "openai"), ("anthropic", "anthropic"), ("gemini", "gemini"),
        ("xai", "openai"), ("local", "openai"), ("local", "openai")]
    df = spark.createDataFrame([("blocked", "r", 400), ("blocked", "", 400), ("allowed", "", 200), ("allowed", "", 502)],
                               "action string, reason string, status int")
    assert [r[0] for r in df.select(request_verdict(F.col("action"), F.col("reason"), F.col("status"))).collect()] == [
        "BLOCKED: r", "BLOCKED: Unknown", "PASSED", "FAILED_502"]
    df = spark.createDataFrame([("a", "a", "PASSED", 0.5), ("a", "b", "BLOCKED: x", 0.0125), ("a", "a", "FAILED_502", 0.0)],
                               "o string, s string, v string, l double")
    assert [tuple(r) for r in df.select(*log_display(F.col("o"), F.col("s"), F.col("v"), F.col("l"))).collect()] == [
        (False, "passed", 500), (True, "blocked", 13), (False, "failed", 0)]
    assert spark.range(1).select(preview(F.lit("x" * 51))).first()[0] == "x" * 50 + "..."
