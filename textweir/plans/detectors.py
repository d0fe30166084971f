"""Detector, verdict and corpus queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, redaction, rules, similarity, textual
from ..functions.entities import entity_rules
from ..functions.keywords import sorted_unique_matches
from ..functions.verdict import package_verdict
from ..operators import audit, blocklist, chat, corpus
from ..operators.scan import (Models, legacy_gateway_validate, pii_guard, redact, scan,
                              validate_input, validate_output)
from ..operators.wordmodel import fit_word_odds, score_words
from ..policy import Policy, load_policy
from . import oracle as o
from .policies import COMPETITORS, HOUSE, KEYWORDS, PII_ONLY, SECRETS, SHADOW, TOPICS_ONLY, WORDS
from .registry import query
from .tables import events, load

_VERDICT = ["valid", "reason", "action"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations")


def _joined(col: str = "triggered"):
    return F.array_join(col, "|").alias(col)


def _guard_rows(df: DataFrame, result, *keys: str) -> DataFrame:
    return df.select(*keys, result.alias("r")).select(
        *keys, "r.valid", "r.sanitized_text", "r.reason", "r.action")


# --- redaction -----------------------------------------------------------------

_STRICT = o.strict(list(rules.STRICT_PII))


@query("pii_redact_strict", f"WITH {o.redact_ctes('documents', 'text', _STRICT)} "
       "SELECT doc_id, t AS sanitized_text FROM red4")
def pii_redact_strict(spark, sf_dir):
    return redact(_docs(spark, sf_dir), redaction.strict_rules()).select("doc_id", "sanitized_text")


@query("pii_types", f"WITH {o.redact_ctes('documents', 'text', _STRICT)} "
       f"SELECT doc_id, {o.label_list(_STRICT, 'PII:', '|')} AS pii_types FROM red4")
def pii_types(spark, sf_dir):
    out = redact(_docs(spark, sf_dir), redaction.strict_rules())
    return out.select("doc_id", F.array_join(
        F.transform("redacted_types", lambda n: F.concat(F.lit("PII:"), n)), "|").alias("pii_types"))


_PII_GUARD = """SELECT doc_id, t AS sanitized_text, types AS redacted_types, true AS valid,
  CASE WHEN types = '' THEN 'No PII found' ELSE 'PII Redacted' END AS reason,
  CASE WHEN types = '' THEN 'none' ELSE 'redacted' END AS action"""


@query("pii_redact_loose", f"WITH {o.redact_ctes('documents', 'text', o.LOOSE)} {_PII_GUARD} "
       f"FROM (SELECT *, {o.label_list(o.LOOSE, '', '|')} AS types FROM red4)")
def pii_redact_loose(spark, sf_dir):
    out = pii_guard(_docs(spark, sf_dir), redaction.loose_rules())
    return out.select("doc_id", "sanitized_text", _joined("redacted_types"), *_VERDICT)


_CUSTOM = {"HEX_ID": r"[0-9a-f]{32,64}", "LOCAL_PART": r"[a-z]+\.[0-9]{2}"}


@query("pii_redact_custom", f"WITH {o.redact_ctes('documents', 'text', _CUSTOM)} {_PII_GUARD} "
       f"FROM (SELECT *, {o.label_list(_CUSTOM, '', '|')} AS types FROM red2)")
def pii_redact_custom(spark, sf_dir):
    out = pii_guard(_docs(spark, sf_dir), redaction.custom_rules(_CUSTOM))
    return out.select("doc_id", "sanitized_text", _joined("redacted_types"), *_VERDICT)


_CARD = r"\b\d(?:[ -]?\d){12,18}\b"
_DIGITS = "list_reverse(string_split(regexp_replace(h, '[^0-9]', '', 'g'), ''))"
_LUHN = f"""list_sum(list_transform({_DIGITS}, lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT
  WHEN d::INT * 2 > 9 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"""
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"


@query("pii_redact_entities", f"""WITH e AS (SELECT doc_id,
  regexp_replace(text, {o.quote(rules.STRICT_PII['EMAIL'])}, '<EMAIL_ADDRESS_REDACTED>', 'g') AS t0, text FROM documents),
c AS (SELECT *, list_filter(regexp_extract_all(t0, {o.quote(_CARD)}), lambda h: {_LUHN}) AS cards FROM e),
d AS (SELECT *, list_reduce(cards, lambda a, h: replace(a, h, '<CREDIT_CARD_REDACTED>'), t0) AS t1 FROM c),
s AS (SELECT *, regexp_replace(t1, {o.quote(rules.STRICT_PII['SSN'])}, '<US_SSN_REDACTED>', 'g') AS t2 FROM d),
p AS (SELECT *, regexp_replace(t2, {o.quote(rules.LOOSE_PII['PHONE'])}, '<PHONE_NUMBER_REDACTED>', 'g') AS t3 FROM s),
n AS (SELECT *, {o.padded('t3')} AS pad FROM p),
l AS (SELECT *, replace(regexp_replace(regexp_replace(pad, '(^|{o.NONWORD})(?i:inoran)($|{o.NONWORD})', '\\1\ue000\\2', 'g'),
  '({o.NONWORD}){o.NONWORD}', '\\1', 'g'), '\ue000', '<LOCATION_REDACTED>') AS t4 FROM (SELECT * REPLACE (replace(pad, '\ue000', '') AS pad) FROM n))
SELECT doc_id, t4 AS sanitized_text, concat_ws('|',
  CASE WHEN len(cards) > 0 THEN 'CREDIT_CARD' END, CASE WHEN t0 <> text THEN 'EMAIL_ADDRESS' END,
  CASE WHEN t4 <> t3 THEN 'LOCATION' END, CASE WHEN t3 <> t2 THEN 'PHONE_NUMBER' END,
  CASE WHEN t2 <> t1 THEN 'US_SSN' END) AS entity_types FROM l""".replace("\ue000", "\u3042"))
def pii_redact_entities(spark, sf_dir):
    out = redact(_docs(spark, sf_dir), entity_rules(locations=["inoran"]))
    types = F.array_join(F.sort_array("redacted_types"), "|").alias("entity_types")
    return out.select("doc_id", "sanitized_text", types)


_PRO = dataclasses.replace(Policy(name="Pro"), pii_enabled=True, pii_engine="entities",
                           pii_patterns=("EMAIL", "PHONE"))


@query("pii_engine_fallback", f"WITH {o.scan_ctes('documents', _PRO)} "
       "SELECT doc_id, sanitized_text, triggered, action FROM s")
def pii_engine_fallback(spark, sf_dir):
    out = scan(_docs(spark, sf_dir), _PRO, models=Models(entities=False))
    return out.select("doc_id", "sanitized_text", _joined(), "action")


@query("secret_redact", f"WITH {o.scan_ctes('documents', Policy(), secrets=SECRETS)} "
       "SELECT doc_id, sanitized_text, triggered, reason, action FROM s")
def secret_redact(spark, sf_dir):
    out = scan(_docs(spark, sf_dir), Policy(), models=Models(secrets=SECRETS))
    return out.select("doc_id", "sanitized_text", _joined(), "reason", "action")


# --- keyword rules -------------------------------------------------------------

_INJECTION = Policy(name="Injection", injection_enabled=True, injection_keywords=KEYWORDS)


@query("injection_flag", f"""SELECT conv_id, turn,
  {o.has_keyword('text', _INJECTION.effective_keywords)} AS injection FROM conversations""")
def injection_flag(spark, sf_dir):
    out = scan(_turns(spark, sf_dir), _INJECTION)
    return out.select("conv_id", "turn", F.array_contains("triggered", rules.INJECTION_LABEL).alias("injection"))


def _guard_sql(table: str, keys: str, message: str, prefix: str, passed: str, suffix: str = "") -> str:
    return f"""SELECT {keys}, m IS NULL AS valid, text AS sanitized_text,
  CASE WHEN m IS NULL THEN {o.quote(passed)} ELSE {o.quote(prefix)} || m || {o.quote(suffix)} END AS reason,
  CASE WHEN m IS NULL THEN 'allowed' ELSE 'blocked' END AS action
  FROM (SELECT *, {message} AS m FROM {table})"""


_FIRST = ("jailbreak", "the tion", *KEYWORDS)


@query("injection_first_keyword", _guard_sql(
    "conversations", "conv_id, turn", o.first_substring("text", _FIRST),
    "Prompt Injection Detected: '", "Passed Injection Check", "'"))
def injection_first_keyword(spark, sf_dir):
    return _guard_rows(_turns(spark, sf_dir), guards.injection_guard(F.col("text"), _FIRST), "conv_id", "turn")


@query("topic_flag", f"SELECT doc_id, 'Topic:' || {o.joined_matches('text', WORDS, ',')} AS topic FROM documents")
def topic_flag(spark, sf_dir):
    out = scan(_docs(spark, sf_dir), TOPICS_ONLY)
    return out.select("doc_id", F.get("triggered", F.lit(0)).alias("topic"))


@query("topic_guardrail", _guard_sql("documents", "doc_id", o.joined_matches("text", WORDS, ", "),
                                     "Restricted topic detected: ", "Passed topic check"))
def topic_guardrail(spark, sf_dir):
    return _guard_rows(_docs(spark, sf_dir), guards.topic_guard(F.col("text"), WORDS), "doc_id")


@query("profanity_block", _guard_sql("documents", "doc_id", o.joined_matches("text", WORDS, ", "),
                                     "Profanity detected: ", "Clean content"))
def profanity_block(spark, sf_dir):
    return _guard_rows(_docs(spark, sf_dir), guards.profanity_guard(F.col("text"), WORDS), "doc_id")


def _masked_sql(text: str) -> str:
    """Masks in a doubled text with a letter that the data lacks, then undoubles it."""
    out = o.padded(text)
    for w in WORDS:
        out = (f"regexp_replace({out}, '(?i)(^|{o.NONWORD}){w}($|{o.NONWORD})', "
               f"'\\1{chr(0x3042) * len(w)}\\2', 'g')")
    return f"replace(regexp_replace({out}, '({o.NONWORD}){o.NONWORD}', '\\1', 'g'), '{chr(0x3042)}', '*')"


@query("profanity_redact", f"""SELECT doc_id, true AS valid, t AS sanitized_text,
  CASE WHEN t <> text THEN 'Profanity redacted' ELSE 'Clean content' END AS reason,
  CASE WHEN t <> text THEN 'redacted' ELSE 'allowed' END AS action
  FROM (SELECT *, {_masked_sql('text')} AS t FROM documents)""")
def profanity_redact(spark, sf_dir):
    return _guard_rows(_docs(spark, sf_dir), guards.profanity_guard(F.col("text"), WORDS, "redact"), "doc_id")


@query("sorted_unique_matches", f"SELECT doc_id, array_to_string({o.sorted_matches('text', WORDS)}, '|') AS matches, "
       f"len({o.sorted_matches('text', WORDS)})::BIGINT AS n FROM documents")
def sorted_matches(spark, sf_dir):
    m = _docs(spark, sf_dir).select("doc_id", sorted_unique_matches(F.col("text"), WORDS).alias("m"))
    return m.select("doc_id", F.array_join("m", "|").alias("matches"), F.size("m").cast("bigint").alias("n"))


@query("competitor_check", "SELECT doc_id, 'Competitor mentions detected: ' || "
       f"{o.joined_substrings('text', [c.lower() for c in COMPETITORS])} AS message FROM documents")
def competitor_check(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", guards.competitor_message(F.col("text"), COMPETITORS).alias("message"))


@query("toxic_lexicon_check", "SELECT doc_id, 'Toxic language detected: ' || "
       f"{o.joined_substrings('text', rules.TOXIC_WORDS)} AS message FROM documents")
def toxic_lexicon_check(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", guards.toxic_message(F.col("text")).alias("message"))


@query("external_guard", f"SELECT doc_id, {o.external('text', COMPETITORS, True)} AS message FROM documents")
def external_guard(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", guards.external_message(
        F.col("text"), COMPETITORS, True).alias("message"))


@query("custom_guard", """SELECT doc_id, NOT contains(text, 'jo.') AS valid,
  CASE WHEN contains(text, 'jo.') THEN text ELSE replace(text, ' the ', ' THE ') END AS sanitized_text,
  CASE WHEN contains(text, 'jo.') THEN 'Marker found' ELSE 'No marker found' END AS reason,
  CASE WHEN contains(text, 'jo.') THEN 'blocked' ELSE 'allowed' END AS action FROM documents""")
def custom_guard(spark, sf_dir):
    result = guards.substitution_guard(F.col("text"), "jo.", {" the ": " THE "})
    return _guard_rows(_docs(spark, sf_dir), result, "doc_id")


@query("custom_plugin", f"""WITH {o.scan_ctes('documents', PII_ONLY, extra=[
    "'Plugin:' || CASE WHEN contains(t, 'ountion') THEN 'Secret codeword detected' END"])}
SELECT doc_id, triggered, reason, action FROM s""")
def custom_plugin(spark, sf_dir):
    guards.register_plugin("codeword", lambda t: F.when(t.contains("ountion"), F.lit("Secret codeword detected")))
    out = scan(_docs(spark, sf_dir), PII_ONLY, models=Models(plugins=[guards.get_plugin("codeword")]))
    return out.select("doc_id", _joined(), "reason", "action")


# --- scores and similarity -----------------------------------------------------

_TOXIC_POLICY = Policy(name="Scored", toxicity_enabled=True, toxicity_threshold=0.55)


@query("toxicity_score", f"""WITH d AS (SELECT doc_id, text,
  (toxic * 5 + quality * 2 + doc_id % 3) / 9.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
{o.scan_ctes('d', _TOXIC_POLICY, extra=["'Plugin:LangKit: Toxicity detected (' || CASE WHEN score > 0.55 THEN printf('%.2f', score) END || ')'"])}
SELECT doc_id, round(score, 6) AS score, triggered, valid, action FROM s""")
def toxicity_score(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    score = ((F.col("toxic") * 5 + F.col("quality") * 2 + F.col("doc_id") % 3) / 9.0).alias("score")
    docs = _docs(spark, sf_dir).join(labels, "doc_id").select("doc_id", "text", score)
    out = scan(docs, _TOXIC_POLICY, models=Models(score=lambda text: F.col("score")))
    return out.select("doc_id", F.round("score", 6).alias("score"), _joined(), "valid", "action")


def _load_lexicon_model():
    """A stand-in model: lexicon words per 8 words, at most 1."""
    import re

    words = re.compile("|".join(rules.TOXIC_WORDS))

    def predict(texts):
        return [min(len(words.findall((t or "").lower())) * 8 / max(len((t or "").split(" ")), 1), 1.0) for t in texts]

    return predict


_LEXICON_SCORE = ("least(len(regexp_extract_all(lower(t), 'stupid|ugly|idiot|dumb')) * 8.0::DOUBLE "
                  "/ len(string_split(t, ' ')), 1.0)")


@query("model_score", f"""WITH {o.scan_ctes('documents', PII_ONLY, extra=[
    f"'Plugin:LangKit: Toxicity detected (' || CASE WHEN {_LEXICON_SCORE} > 0.013 THEN printf('%.2f', {_LEXICON_SCORE}) END || ')'"])}
SELECT doc_id, triggered, action FROM s""")
def model_score(spark, sf_dir):
    policy = dataclasses.replace(PII_ONLY, toxicity_enabled=True, toxicity_threshold=0.013)
    out = scan(_docs(spark, sf_dir), policy,
               models=Models(score=lambda text: similarity.model_score(text, _load_lexicon_model)))
    return out.select("doc_id", _joined(), "action")


_ODDS_SQL = """train AS (SELECT text AS t, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL),
f AS (SELECT sum(y) AS ones, count(*) AS n FROM train),
w AS (SELECT word, sum(y) AS ones, count(*) AS n FROM (SELECT y, unnest(list_distinct(regexp_extract_all(lower(t), '[a-z]+'))) AS word FROM train)
  GROUP BY word HAVING count(*) >= 3),
odds AS (SELECT word, ln((w.ones + 1) / (f.ones + 2.0::DOUBLE)) - ln((w.n - w.ones + 1) / (f.n - f.ones + 2.0::DOUBLE)) AS weight FROM w, f),
d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 4 THEN NULL ELSE text END AS text FROM documents),
k AS (SELECT doc_id, avg(weight) * 8.0 AS z FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM d)
  JOIN odds USING (word) GROUP BY doc_id),
p AS (SELECT d.doc_id, text, CASE WHEN text IS NOT NULL THEN 1.0 / (1.0 + exp(-(coalesce(z, 0.0) + ln((f.ones + 1.0::DOUBLE) / (f.n - f.ones + 1.0))))) END AS score
  FROM f, d LEFT JOIN k ON k.doc_id = d.doc_id)"""


@query("toxicity_model", f"""WITH {_ODDS_SQL} SELECT doc_id, round(score, 4) AS score,
  CASE WHEN score > 0.5 THEN 'Plugin:LangKit: Toxicity detected (' || printf('%.2f', score) || ')' ELSE '' END AS triggered,
  CASE WHEN score > 0.5 THEN 'blocked' ELSE 'allowed' END AS action FROM p""")
def toxicity_model(spark, sf_dir):
    """A model fitted on the labels, in closed form, as the scoring model; some texts are NULL."""
    labels = load(spark, sf_dir, "labels")
    docs = _docs(spark, sf_dir)
    odds, bias = fit_word_odds(docs.join(labels, "doc_id"), "toxic")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 17 != 4, F.col("text")))
    scored = docs.join(score_words(docs, "doc_id", odds, bias), "doc_id")
    policy = Policy(name="Fitted", toxicity_enabled=True, toxicity_threshold=0.5)
    out = scan(scored, policy, models=Models(score=lambda text: F.col("score")))
    return out.select("doc_id", F.round("score", 4).alias("score"), _joined(), "action")


_INTENT_SQL = "SELECT 'intent_' || label AS intent, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label"
_TOP1_SQL = f"""WITH i AS ({_INTENT_SQL}),
p AS (SELECT vec_id, intent, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, i),
b AS (SELECT vec_id, arg_max(intent, score) AS intent, max(score) AS score FROM p GROUP BY vec_id)
SELECT vec_id, intent, round(score, 6) AS score, CASE WHEN score > 0.45 THEN
  'Semantic:Intent violation (matched ''' || intent || ''', score ' || printf('%.2f', score) || ')' END AS label FROM b"""


def _label_intents(spark: SparkSession, sf_dir: str) -> dict[str, list[float]]:
    """One vector per label: the policy's intents (a short list, as in any policy)."""
    vecs = load(spark, sf_dir, "embeddings")
    rows = vecs.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    return {f"intent_{r['label']}": r["v"] for r in rows}


def _top1(vecs: DataFrame, best) -> DataFrame:
    return vecs.select("vec_id", best.alias("b")).select(
        "vec_id", "b.intent", F.round("b.score", 6).alias("score"),
        similarity.intent_label(F.col("b"), 0.45).alias("label"))


@query("semantic_top1", _TOP1_SQL)
def semantic_top1(spark, sf_dir):
    vecs = load(spark, sf_dir, "embeddings")
    return _top1(vecs, similarity.best_intent(F.col("embedding"), _label_intents(spark, sf_dir)))


@query("semantic_top1_native", _TOP1_SQL)
def semantic_top1_native(spark, sf_dir):
    vecs = load(spark, sf_dir, "embeddings")
    return _top1(vecs, similarity.native_best_intent(F.col("embedding"), _label_intents(spark, sf_dir)))


_SEMANTIC = dataclasses.replace(HOUSE, semantic_enabled=True, semantic_threshold=0.05, external_enabled=False,
                                forbidden_intents=("that of the", "token in the license"))


def _crc32(word: str) -> str:
    """crc32 of a string: a byte is taken in, then eight bits go out (-1)."""
    octets = f"list_transform(range(1, CAST(length(hex(encode({word}))) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({word})), i, 2) AS BIGINT))"
    return f"""xor(list_reduce(list_prepend(4294967295, flatten(list_transform({octets}, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""


def _semantic_sql() -> str:
    pii = dataclasses.replace(Policy(), pii_enabled=True, pii_patterns=HOUSE.pii_patterns)
    intents = ", ".join(f"({i}, {o.quote(t)})" for i, t in enumerate(_SEMANTIC.effective_intents))
    label = ("CASE WHEN best_score > 0.05 THEN 'Semantic:Intent violation (matched ' || chr(39) || intent || chr(39) || ', score ' "
             "|| printf('%.2f', best_score) || ')' END")
    # the embedder sees the redacted text
    return f"""WITH i(rank, intent) AS (VALUES {intents}), {o.scan_ctes('conversations', pii, name='r')},
x AS (SELECT 'i' || rank AS id, intent AS t FROM i UNION ALL SELECT conv_id || '-' || turn, sanitized_text FROM r),
word AS (SELECT id, unnest(regexp_extract_all(lower(t), '\\S+')) AS w FROM x),
place AS (SELECT w, {_crc32('w')} % 256 AS b FROM (SELECT DISTINCT w FROM word)),
v AS (SELECT id, b, count(*)::DOUBLE AS n FROM word JOIN place USING (w) GROUP BY id, b),
len AS (SELECT id, sqrt(sum(n * n)) AS l FROM v GROUP BY id),
dot AS (SELECT a.id, i.rank, i.intent, sum(a.n * c.n) AS s FROM v a JOIN v c ON a.b = c.b JOIN i ON c.id = 'i' || i.rank GROUP BY ALL),
cosine AS (SELECT dot.id, dot.rank, dot.intent, s / (p.l * q.l) AS score FROM dot JOIN len p ON p.id = dot.id JOIN len q ON q.id = 'i' || dot.rank),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, rank) AS k FROM cosine),
turns AS (SELECT conversations.*, coalesce(score, 0.0) AS best_score, intent FROM conversations LEFT JOIN best ON id = conv_id || '-' || turn AND k = 1),
{o.scan_ctes('turns', _SEMANTIC, extra=[label])}
SELECT conv_id, turn, round(best_score, 6) AS semantic_score, regexp_replace(triggered, ', score [0-9.]+', '') AS triggered, action FROM s"""


@query("semantic_scan", _semantic_sql())
def semantic_scan(spark, sf_dir):
    """Texts against intents through a text embedder."""
    out = scan(_turns(spark, sf_dir), _SEMANTIC, models=Models(embedder=similarity.HashingEmbedder))
    # the score in the label is compared as a number, not in its two rounded digits
    label = F.regexp_replace(F.array_join("triggered", "|"), ", score [0-9.]+", "").alias("triggered")
    return out.select("conv_id", "turn", F.round("semantic_score", 6).alias("semantic_score"), label, "action")


# --- scan and verdicts ---------------------------------------------------------

_SCAN_COLS = "sanitized_text, triggered, valid, reason, action"


def _scan_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "sanitized_text", _joined(), *_VERDICT)


@query("scan", f"WITH {o.scan_ctes('documents', HOUSE)} SELECT doc_id, {_SCAN_COLS} FROM s")
def scan_documents(spark, sf_dir):
    return _scan_rows(scan(_docs(spark, sf_dir), HOUSE), "doc_id")


def _default_policy() -> Policy:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return dataclasses.replace(load_policy("default"), semantic_enabled=False)


_DEFAULT = _default_policy()


@query("scan_default", f"WITH {o.scan_ctes('documents', _DEFAULT)} SELECT doc_id, {_SCAN_COLS} FROM s")
def scan_default(spark, sf_dir):
    return _scan_rows(scan(_docs(spark, sf_dir), _DEFAULT), "doc_id")


@query("package_verdict", f"WITH {o.scan_ctes('conversations', HOUSE)} "
       "SELECT conv_id, turn, valid, reason, action FROM s")
def package_verdict_query(spark, sf_dir):
    labelled = scan(_turns(spark, sf_dir), HOUSE).select("conv_id", "turn", "triggered")
    return labelled.select("conv_id", "turn", package_verdict(F.col("triggered")).alias("v")).select(
        "conv_id", "turn", "v.valid", "v.reason", "v.action")


@query("shadow_mode", f"WITH {o.scan_ctes('documents', SHADOW)} SELECT doc_id, {_SCAN_COLS} FROM s")
def shadow_mode(spark, sf_dir):
    return _scan_rows(scan(_docs(spark, sf_dir), SHADOW), "doc_id")


@query("validate_input", f"WITH {o.scan_ctes('conversations', HOUSE)} SELECT conv_id, turn, {_SCAN_COLS} FROM s")
def validate_input_query(spark, sf_dir):
    return _scan_rows(validate_input(_turns(spark, sf_dir), HOUSE), "conv_id", "turn")


@query("validate_output", f"WITH {o.scan_ctes('conversations', HOUSE, is_input='false')} "
       f"SELECT conv_id, turn, {_SCAN_COLS} FROM s")
def validate_output_query(spark, sf_dir):
    return _scan_rows(validate_output(_turns(spark, sf_dir), HOUSE), "conv_id", "turn")


_BOTH = "role = 'user'"


@query("validate_both", f"WITH {o.scan_ctes('conversations', HOUSE, is_input=_BOTH)} "
       f"SELECT conv_id, turn, {_SCAN_COLS} FROM s")
def validate_both(spark, sf_dir):
    source = F.when(F.col("role") == "user", F.lit("input")).otherwise(F.lit("output"))
    return _scan_rows(scan(_turns(spark, sf_dir), HOUSE, source=source), "conv_id", "turn")


@query("legacy_gateway_validate", f"WITH {o.redact_ctes('conversations', 'text', o.LOOSE)}, "
       f"f AS (SELECT *, {o.first_substring('text', KEYWORDS)} AS m FROM red4) SELECT conv_id, turn, "
       "m IS NULL AS valid, CASE WHEN m IS NULL THEN t ELSE text END AS sanitized_text, "
       "CASE WHEN m IS NULL THEN 'Passed' ELSE 'Prompt Injection Detected' END AS reason, "
       "CASE WHEN m IS NULL THEN 'allowed' ELSE 'blocked' END AS action FROM f")
def legacy_gateway(spark, sf_dir):
    out = legacy_gateway_validate(_turns(spark, sf_dir), keywords=KEYWORDS)
    return out.select("conv_id", "turn", "valid", "sanitized_text", "reason", "action")


# --- corpus --------------------------------------------------------------------

@query("sanitize_corpus_drop", f"WITH {o.scan_ctes('documents', HOUSE)} "
       "SELECT doc_id, sanitized_text AS text FROM s WHERE valid")
def sanitize_corpus_drop(spark, sf_dir):
    return corpus.sanitize_corpus(_docs(spark, sf_dir), HOUSE)


@query("sanitize_corpus_redact", f"WITH {o.scan_ctes('documents', HOUSE)} SELECT doc_id, CASE WHEN valid "
       "THEN sanitized_text ELSE '[CONTENT REDACTED: ' || reason || ']' END AS text FROM s")
def sanitize_corpus_redact(spark, sf_dir):
    return corpus.sanitize_corpus(_docs(spark, sf_dir), HOUSE, redact_only=True)


@query("fail_on_block", f"WITH {o.scan_ctes('documents', PII_ONLY)} SELECT doc_id, sanitized_text, action FROM s")
def fail_on_block(spark, sf_dir):
    """The policy only redacts, so no row fails here; tests cover the failure."""
    return chat.fail_on_block(scan(_docs(spark, sf_dir), PII_ONLY)).select("doc_id", "sanitized_text", "action")


_MULTI = (HOUSE, SHADOW, PII_ONLY, TOPICS_ONLY, _DEFAULT)


@query("multi_policy_scan", " UNION ALL ".join(
    f"SELECT * FROM (WITH {o.scan_ctes('documents', p)} SELECT doc_id, {o.quote(p.name)} AS policy, "
    "sanitized_text, triggered, action FROM s)" for p in _MULTI))
def multi_policy_scan(spark, sf_dir):
    out = corpus.multi_policy_scan(_docs(spark, sf_dir), _MULTI)
    return out.select("doc_id", "policy", "sanitized_text", _joined(), "action")


_TERM_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark"


@query("large_blocklist_match", rf"""WITH terms AS (SELECT term FROM ({_TERM_SQL})),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS span FROM documents),
h AS (SELECT doc_id, span FROM w JOIN terms ON lower(span) = term)
SELECT doc_id, 'Topic:' || array_to_string(list_sort(list_distinct(list(span))), ',') AS label,
  count(*)::BIGINT AS n_hits FROM h GROUP BY doc_id""")
def large_blocklist_match(spark, sf_dir):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    terms = load(spark, sf_dir, "benchmark").select(words.alias("term")).distinct()
    return blocklist.blocklist_hits(_docs(spark, sf_dir), "doc_id", terms).withColumn(
        "n_hits", F.col("n_hits").cast("bigint"))


_LISTED = "SELECT DISTINCT source AS policy, lower(split_part(text, ' ', 1)) AS keyword FROM documents"


def _values(words) -> str:
    return ", ".join(f"({o.quote(w)})" for w in words)


def _effective(spark, sf_dir, defaults, name):
    docs = load(spark, sf_dir, "documents")
    listed = docs.select(F.col("source").alias("policy"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias(name))
    return audit.effective_rules(listed, list(defaults), "policy", name)


@query("effective_keywords", f"WITH l AS ({_LISTED}) SELECT policy, keyword FROM l UNION "
       f"SELECT policy, v.w FROM (SELECT DISTINCT policy FROM l), (VALUES {_values(rules.INJECTION_KEYWORDS)}) v(w)")
def effective_keywords(spark, sf_dir):
    return _effective(spark, sf_dir, rules.INJECTION_KEYWORDS, "keyword")


@query("effective_intents", f"WITH l AS ({_LISTED}) SELECT policy, keyword AS intent FROM l UNION "
       f"SELECT policy, v.w FROM (SELECT DISTINCT policy FROM l), (VALUES {_values(rules.BASE_INTENTS)}) v(w)")
def effective_intents(spark, sf_dir):
    return _effective(spark, sf_dir, rules.BASE_INTENTS, "intent")


# --- sentences -----------------------------------------------------------------

@query("sentence_split", f"WITH {o.sentence_rows('conversations', 'text', 'conv_id, turn')} "
       "SELECT conv_id, turn, pos::BIGINT AS pos, sentence, separator FROM sent_s")
def sentence_split(spark, sf_dir):
    out = corpus.split_sentences(_turns(spark, sf_dir).drop("role"))
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("sentence_split_documents", f"WITH {o.sentence_rows('documents', 'text', 'doc_id')} "
       "SELECT doc_id, count(*)::BIGINT AS n_sentences, sum(length(sentence))::BIGINT AS body_len, "
       "sum(length(separator))::BIGINT AS separator_len FROM sent_s GROUP BY doc_id")
def sentence_split_documents(spark, sf_dir):
    from ..functions.sentences import sentence_body, sentence_pieces

    # counted within the row: the sentences of a text never leave it
    docs = _docs(spark, sf_dir).withColumn("p", sentence_pieces(F.col("text")))
    docs = docs.select("doc_id", "text", F.size("p").cast("bigint").alias("n_sentences"), F.aggregate(
        F.transform("p", lambda p: F.length(sentence_body(p)).cast("bigint")), F.lit(0).cast("bigint"),
        lambda acc, n: acc + n).alias("body_len"))
    return docs.filter("n_sentences > 0").select(
        "doc_id", "n_sentences", "body_len", (F.length("text") - F.col("body_len")).alias("separator_len"))


_SENT_SCAN = (f"{o.sentence_rows('conversations', 'text', 'conv_id, turn')},\n"
              f"{o.scan_ctes('sent_s', HOUSE, 'sentence', 'false')},\n"
              "em AS (SELECT *, CASE WHEN valid THEN sanitized_text ELSE '[BLOCKED: ' || reason || ']' END "
              "|| separator AS emitted FROM s)")


@query("sanitize_sentences", f"WITH {_SENT_SCAN} SELECT conv_id, turn, pos::BIGINT AS pos, action, emitted FROM em")
def sanitize_sentences(spark, sf_dir):
    out = corpus.sanitize_sentence_rows(_turns(spark, sf_dir).drop("role"), HOUSE)
    return out.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "action", "emitted")


@query("sanitize_by_sentence", f"WITH {_SENT_SCAN} SELECT conv_id, turn, string_agg(emitted, '' ORDER BY pos) "
       "AS sanitized_text, count(*) FILTER (NOT valid)::BIGINT AS n_blocked FROM em GROUP BY conv_id, turn")
def sanitize_by_sentence(spark, sf_dir):
    out = corpus.sanitize_by_sentence(_turns(spark, sf_dir), HOUSE)
    return out.select("conv_id", "turn", "sanitized_text", F.col("n_blocked").cast("bigint").alias("n_blocked"))


# --- scalars -------------------------------------------------------------------

_MODEL_SQL = """CASE event_type WHEN 'click' THEN 'GPT-4o' WHEN 'view' THEN 'claude-3' WHEN 'signup' THEN 'gemini-1.5'
  WHEN 'purchase' THEN 'grok-2' ELSE 'llama3' END"""


def with_model(ev: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return ev.withColumn("model", F.when(kind == "click", "GPT-4o").when(kind == "view", "claude-3")
                         .when(kind == "signup", "gemini-1.5").when(kind == "purchase", "grok-2")
                         .otherwise("llama3"))


@query("route_provider", f"""SELECT event_id, model, CASE WHEN starts_with(lower(model), 'gpt-') THEN 'openai'
  WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' WHEN starts_with(lower(model), 'gemini-') THEN 'gemini'
  WHEN starts_with(lower(model), 'grok-') THEN 'xai' ELSE 'local' END AS provider,
  CASE WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' WHEN starts_with(lower(model), 'gemini-')
  THEN 'gemini' ELSE 'openai' END AS adapter FROM (SELECT *, {_MODEL_SQL} AS model FROM events)""")
def route_provider(spark, sf_dir):
    return corpus.route_traffic(with_model(events(spark, sf_dir)).select("event_id", "model"))


@query("coerce_text", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN
  '{"role":"' || role || '"}' ELSE text END AS text FROM conversations""")
def coerce_text(spark, sf_dir):
    role = F.col("role")
    raw = (F.when(role == "user", F.to_json(F.struct(F.col("text").alias("content"))))
           .when(role == "system", F.to_json(F.struct("role")))
           .when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.lit("").alias("content"), F.col("text").alias("text"))))
           .otherwise(F.col("text")))
    return _turns(spark, sf_dir).select("conv_id", "turn", textual.coerce_text(raw).alias("text"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END "
       "AS preview, substr(text, 1, 200) AS head FROM documents")
def preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", textual.preview(F.col("text")).alias("preview"),
                                       F.substring("text", 1, 200).alias("head"))
