"""Entity spans and failing models against plain statements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from textweir.functions import similarity
from textweir.functions.models import call_each, model_message, model_result
from textweir.functions.spans import Recognizer, span_rules, sweep
from textweir.operators.corpus import sanitize_by_sentence
from textweir.operators.scan import Models, redact_entities, scan
from textweir.policy import Policy


def test_sweep_gives_each_position_to_its_best_span():
    rng = random.Random(4)
    for _ in range(400):
        spans = []
        for _ in range(rng.randint(0, 9)):
            s = rng.randint(0, 18)
            spans.append((s, s + rng.randint(1, 9), rng.choice("ABC"), rng.choice([0.1, 0.5, 0.9])))
        owner = {}
        for p in range(30):
            over = [(-sc, s - e, s, i) for i, (s, e, _, sc) in enumerate(spans) if s <= p < e]
            if over:
                owner[p] = min(over)[3]
        got = {}
        for s, e, kind, score in sweep(spans):
            for p in range(s, e):
                got[p] = (kind, score)
        assert got == {p: spans[i][2:] for p, i in owner.items()}
        runs = sum(owner.get(p) is not None and owner.get(p) != owner.get(p - 1) for p in range(30))
        assert len(sweep(spans)) == runs


@pytest.fixture
def names():
    def find(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[(t.find("Ann Lee"), t.find("Ann Lee") + 7, "PERSON", 0.9)] if "Ann Lee" in t else [] for t in texts]

    return find


def test_recognizer_with_rules_nulls_and_failures(texts, names):
    rows = ["Ann Lee 4111 1111 1111 1111", None, "", "boom Ann Lee a@b.co", "plain", "DE89370400440532013000 EUR", "x" * 50_000 + " Ann Lee"]
    df = texts(rows)
    got = {}
    for rule in ("open", "closed"):
        out = redact_entities(df, span_rules(), Recognizer(lambda: names, on_error=rule)).orderBy("i").collect()
        got[rule] = [(r.sanitized_text, r.redacted_types) for r in out]
    same = [("<PERSON_REDACTED> <CREDIT_CARD_REDACTED>", ["CREDIT_CARD", "PHONE_NUMBER", "PERSON"]), (None, []), ("", [])]
    assert got["open"][:3] == got["closed"][:3] == same
    assert got["open"][3] == ("boom Ann Lee <EMAIL_ADDRESS_REDACTED>", ["EMAIL_ADDRESS"])
    assert got["closed"][3] == ("<TEXT_REDACTED>", ["TEXT"])
    assert got["open"][4:6] == [("plain", []), ("<IBAN_CODE_REDACTED> EUR", ["IBAN_CODE"])]
    assert got["open"][6] == ("x" * 50_000 + " <PERSON_REDACTED>", ["PERSON"])
    with pytest.raises(Exception, match="RuntimeError: no"):
        redact_entities(df, span_rules(), Recognizer(lambda: names)).collect()
    outside = Recognizer(lambda: lambda ts: [[(0, len(t) + 1, "PERSON", 1.0)] for t in ts], on_error="open")
    assert redact_entities(texts(["a b"]), [], outside).first().sanitized_text == "a b"


def test_policy_with_a_recognizer(texts, names):
    policy = Policy(name="P", pii_enabled=True, pii_engine="entities", topics=("secret",))
    models = Models(recognizer=Recognizer(lambda: names, on_error="open"))
    out = scan(texts(["Ann Lee knows a secret", "nothing", None]), policy, models=models).orderBy("i").collect()
    assert [(r.sanitized_text, r.triggered, r.action) for r in out] == [
        ("<PERSON_REDACTED> knows a secret", ["PII:PERSON", "Topic:secret"], "blocked"), ("nothing", [], "allowed"), (None, [], "allowed")]
    by = sanitize_by_sentence(texts(["Hi. Ann Lee is here. A secret."]), policy, models=models).first()
    assert by.sanitized_text.startswith("Hi. <PERSON_REDACTED> is here. [BLOCKED") and by.n_blocked == 1


def test_a_failing_text_does_not_fail_its_batch(texts):
    def model(ts):
        if any("bad" in t for t in ts):
            raise ValueError("bad one")
        return [len(t) / 10 for t in ts]

    calls = []
    assert call_each(lambda ts: (calls.append(len(ts)), model(ts))[1], ["a"] * 50 + ["bad"] + ["b"] * 77)[1].count(None) == 127
    assert len(calls) < 40
    assert call_each(lambda ts: [], ["x"]) == ([None], ["ValueError: 0 results for 1 texts"])
    df = texts(["aaaaaaaa", "bad", None, "", "a"]).withColumn("r", model_result(F.col("text"), lambda: model))
    got = df.select("r.score", "r.error", model_message(F.col("r"), 0.5, "closed").alias("closed"),
                    model_message(F.col("r"), 0.5, "open").alias("open")).collect()
    assert [tuple(r) for r in got] == [
        (0.8, None, "LangKit: Toxicity detected (0.80)", "LangKit: Toxicity detected (0.80)"),
        (None, "ValueError: bad one", "LangKit: scan failed (ValueError: bad one)", None), (None, None, None, None),
        (0.0, None, None, None), (0.1, None, None, None)]
    with pytest.raises(Exception, match="ValueError: bad one"):
        df.select(model_message(F.col("r"), 0.5)).collect()
    with pytest.raises(ValueError, match="on_error"):
        model_message(F.col("r"), 0.5, "maybe")
    nan = texts(["a"]).select(model_result(F.col("text"), lambda: lambda ts: [float("nan")] * len(ts)).alias("r")).first().r
    assert nan.score is None and "finite" in nan.error


def test_plain_scores_skip_nulls(texts):
    score = similarity.model_score(F.col("text"), lambda: lambda ts: [float(len(t)) for t in ts])
    assert [r.s for r in texts(["ab", None, "", None]).select(score.alias("s")).collect()] == [2.0, None, 0.0, None]
    assert [r.s for r in texts([None]).select(score.alias("s")).collect()] == [None]


def test_a_batch_is_worked_off_in_bounded_pieces(spark, monkeypatch):
    import pyarrow as pa

    from textweir.functions import spans

    monkeypatch.setattr(spans, "_BYTES", 100)
    cut = [n for _, n in spans.pieces(pa.array(["x" * 60] * 3 + ["y" * 500] + [None, ""] * 300))]
    assert sum(cut) == 604 and cut[:4] == [1, 1, 1, 1] and max(cut) == spans._ROWS and list(spans.pieces(pa.array([], pa.string()))) == [(0, 0)]

    def load():
        def find(texts):
            return [[(0, 1, "PERSON", 0.9)] if t else [] for t in texts]
        return find

    calls = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}") for i in range(2_000)], "i int, text string").coalesce(1)
    got = {r.i: r.sanitized_text for r in redact_entities(calls, [], Recognizer(load)).collect()}
    assert got == {i: None if i % 5 == 0 else f"<PERSON_REDACTED>{i}" for i in range(2_000)}
