"""Each rule against a plain statement of it, over random Unicode strings."""

import re

import pytest
from conftest import random_texts
from pyspark.sql import functions as F

from textweir.functions import guards, redaction, rules, textual
from textweir.functions.keywords import has_keyword, sorted_unique_matches
from textweir.functions.sentences import sentence_body, sentence_pieces, sentence_separator
from textweir.operators.scan import redact

PIECES = list("0123456789") * 3 + list("aAzZé_²½٣ \t\n  \x1c-.()+,%@|$") + [
    "jo.81@mail7.example.com", "555-123-4567", "123-45-6789", "4111 1111 1111 1111", "+1 ", "x@y.Co", "1234",
    "é", "ſ", "​"]


def apply_python(patterns, text):
    hit = []
    for name, pattern in patterns.items():
        if re.search(pattern, text):
            hit.append(name)
            text = re.sub(pattern, f"<{name}_REDACTED>", text)
    return text, hit


@pytest.mark.parametrize("kind", ["strict", "loose", "custom"])
def test_redaction_equals_python(texts, kind):
    custom = {"A1": r"\ba\d?\b", "WS": r"\s{2}", "NOT": r"[^\w\s]+$", "B": r"\B\d"}
    table, made = {"strict": (rules.STRICT_PII, redaction.strict_rules()),
                   "loose": (rules.LOOSE_PII, redaction.loose_rules()),
                   "custom": (custom, redaction.custom_rules(custom))}[kind]
    rows = random_texts(4000, PIECES, seed=len(kind))
    table = {k: v.replace("$", r"\Z") for k, v in table.items()}
    if kind == "custom":
        made = redaction.custom_rules(table)
    for r in redact(texts(rows), made).collect():
        assert (r.sanitized_text, r.redacted_types) == apply_python(table, r.text), repr(r.text)


WORDS = ["crypto", "buy stock", "ask", "#tag", "c++", "été", "is"]


@pytest.mark.parametrize("words", [WORDS, WORDS[:3], ["crypto", "crypt", "kiss"]])
def test_keywords_equal_python(texts, words):
    pieces = [*words, *[w.upper() for w in words], " ", ",", "é", "_", "²", "S", "ſ", "İ", "ı", "K", "1", "crypto "]
    rows = random_texts(4000, pieces, seed=5)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    low = F.lower("text")
    got = texts(rows).select("text", has_keyword(F.col("text"), words).alias("a"),
                             has_keyword(F.col("text"), words, low).alias("b"),
                             sorted_unique_matches(F.col("text"), words).alias("m"))
    for r in got.collect():
        want = sorted(set(pattern.findall(r.text)))
        assert r.m == want, repr(r.text)
        assert r.a == r.b == bool(want), repr(r.text)


def test_sentences_equal_the_buffer_loop(texts):
    rows = random_texts(4000, ["a", "B", ".", "?", "!", " ", "\n", "\t", " ", "3.14", ". "], seed=7)
    end = re.compile(rules.SENTENCE_END, re.DOTALL)
    col = sentence_pieces(F.col("text"))
    got = texts(rows).select("text", F.transform(col, lambda p: F.struct(
        sentence_body(p).alias("b"), sentence_separator(p).alias("s"))).alias("p"))
    for r in got.collect():
        want, rest = [], r.text
        while (m := end.match(rest)) is not None:
            want.append((m.group(1), m.group(2)))
            rest = rest[m.end():]
        want += [(rest, "")] if rest else []
        assert [(p.b, p.s) for p in r.p] == want, repr(r.text)


def test_masking_equals_callback_replace(texts):
    words = ["bad", "bad word", "word"]
    rows = random_texts(2000, ["bad", " ", "word", "BAD ", "x", "-", "é"], seed=9)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    got = texts(rows).select("text", guards.profanity_guard(F.col("text"), words, "redact").alias("r"))
    for row in got.collect():
        want = pattern.sub(lambda m: "*" * len(m.group()), row.text)
        assert row.r.sanitized_text == want
        assert row.r.action == ("redacted" if want != row.text else "allowed")


def test_two_decimals_equal_python(spark):
    values = [0.125, 0.375, 0.005, 0.015, 0.999, 1.0, 0.0, 0.445, 2.675, 12345.678]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(textual.two_decimals(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]
    assert [r[0] for r in got][:2] == ["0.12", "0.38"]


def test_java_regex_forms():
    assert rules.java_regex(r"\b\d{3}\b").startswith(rules.NOT_AFTER_WORD)
    assert rules.java_regex("[]a]") == r"[\]a]"
    assert rules.java_regex("[a[&]") == r"[a\[\&]"
    with pytest.raises(ValueError):
        rules.keyword_regex([])


def test_long_runs_stay_linear(texts):
    blob = "a" * 1_000_000
    rows = [blob + " x@y.org", "@" + blob, blob + "@" + blob + ".", "a@b.co_c@d.org"]
    got = redact(texts(rows), redaction.strict_rules()).orderBy("i").collect()
    assert got[0].sanitized_text == blob + " <EMAIL_REDACTED>" and got[1].redacted_types == got[2].redacted_types == []
    # the second match starts inside the run that the first one ended in
    assert got[3].sanitized_text == "<EMAIL_REDACTED><EMAIL_REDACTED>"
