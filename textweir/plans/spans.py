"""Queries of entity spans, of models that fail, and of long term lists."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.models import model_result
from ..functions.spans import SCORES, Recognizer, span_rules
from ..operators import blocklist
from ..operators.intents import top_intents
from ..operators.scan import Models, redact_entities, scan
from ..policy import Policy
from . import oracle as o
from .detectors import _CARD, _IBAN, _LEXICON_SCORE, _LUHN, _load_lexicon_model
from .registry import query
from .tables import load

PERSONS, LOCATIONS = ("Anna Meier",), ("inoran",)
#: What the stub recognizer takes for persons and accounts: they overlap with each other and with the rules.
STUB = {"PERSON": (r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", 0.6), "ACCOUNT": (r"[A-Z]{0,4}[0-9]{4,}(?: [0-9]{2,4})?", 0.9)}
#: Texts with an account, a valid or an invalid IBAN, and a person, besides what the documents hold.
_SPAN_TEXT = """CASE doc_id % 4 WHEN 0 THEN text || ' Pay Anna Meier Lopez, DE89 3704 0044 0532 0130 00 today'
  WHEN 1 THEN 'Dear anna meier Ltd: GB82WEST12345698765432, not GB82WEST12345698765433. ' || text
  WHEN 2 THEN text || ' call 212-555-0100 or 078-05-1120 4111 1111 1111 1111' ELSE text END"""


def load_stub():
    """A stand-in for an entity model."""
    found = [(kind, re.compile(pattern), score) for kind, (pattern, score) in STUB.items()]
    return lambda texts: [[(m.start(), m.end(), kind, score) for kind, p, score in found for m in p.finditer(t)] for t in texts]


_IBAN_OK = """list_reduce(list_prepend(0, list_transform(string_split(regexp_replace(h, '[^A-Z0-9]', '', 'g')[5:]
  || regexp_replace(h, '[^A-Z0-9]', '', 'g')[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 + 1000 ELSE ascii(c) - 48 END)),
  lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1"""
# (kind, pattern, score, condition): the entity rules, then the recognizer
_SPAN_RULES = [
    ("EMAIL_ADDRESS", rules.STRICT_PII["EMAIL"], None, "true"), ("CREDIT_CARD", _CARD, None, _LUHN),
    ("IBAN_CODE", _IBAN, None, _IBAN_OK), ("US_SSN", rules.STRICT_PII["SSN"], None, "true"),
    ("PHONE_NUMBER", rules.LOOSE_PII["PHONE"], None, "true"), ("PERSON", r"\b(?i:anna meier)\b", None, "true"),
    ("LOCATION", r"\b(?i:inoran)\b", None, "true"), *((k, p, s, "true") for k, (p, s) in STUB.items())]


def _span_sql() -> str:
    cut = ", ".join(f"string_split_regex(t, {o.quote(p)}) AS g{i}, regexp_extract_all(t, {o.quote(p)}) AS m{i}"
                    for i, (_, p, _, _) in enumerate(_SPAN_RULES))
    spans = " UNION ALL ".join(f"""SELECT doc_id, {i} AS r, '{kind}' AS kind, {score or SCORES[kind]} AS score, s, s + length(h) AS e
      FROM (SELECT doc_id, m{i}[j] AS h, list_sum(list_transform(g{i}[1:j], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, g{i}, m{i}, unnest(range(1, len(m{i}) + 1)) AS j FROM cut)) WHERE {ok}"""
                              for i, (kind, _, score, ok) in enumerate(_SPAN_RULES))
    return f"""WITH d AS (SELECT doc_id, {_SPAN_TEXT} AS t FROM documents), cut AS (SELECT doc_id, {cut} FROM d),
span AS ({spans}),
pts AS (SELECT DISTINCT doc_id, unnest([s, e]) AS p FROM span UNION SELECT doc_id, 0 FROM d UNION SELECT doc_id, length(t) FROM d),
iv AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM pts),
best AS (SELECT iv.doc_id, iv.a, kind, r * 10000000 + s AS id, row_number() OVER (PARTITION BY iv.doc_id, iv.a
  ORDER BY score DESC, e - s DESC, s, r) AS n FROM iv JOIN span ON span.doc_id = iv.doc_id AND s <= iv.a AND e >= b),
seq AS (SELECT iv.doc_id, iv.a, b, kind, id, lag(id) OVER (PARTITION BY iv.doc_id ORDER BY iv.a) AS before
  FROM iv LEFT JOIN best ON best.doc_id = iv.doc_id AND best.a = iv.a AND n = 1 WHERE b IS NOT NULL),
made AS (SELECT seq.doc_id, string_agg(CASE WHEN id IS NULL THEN substr(t, CAST(seq.a + 1 AS BIGINT), CAST(b - seq.a AS BIGINT))
  WHEN id IS NOT DISTINCT FROM before THEN '' ELSE '<' || kind || '_REDACTED>' END, '' ORDER BY seq.a) AS t
  FROM seq JOIN d ON d.doc_id = seq.doc_id GROUP BY seq.doc_id),
kinds AS (SELECT doc_id, string_agg(kind, '|' ORDER BY kind) AS k FROM (SELECT DISTINCT doc_id, kind FROM span) GROUP BY doc_id)
SELECT d.doc_id, coalesce(made.t, '') AS sanitized_text, coalesce(k, '') AS entity_types
FROM d LEFT JOIN made ON made.doc_id = d.doc_id LEFT JOIN kinds ON kinds.doc_id = d.doc_id"""


@query("pii_entity_spans", _span_sql())
def pii_entity_spans(spark, sf_dir):
    """Patterns, checksums, lists and a recognizer whose spans overlap, resolved together."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr(_SPAN_TEXT).alias("text"))
    out = redact_entities(docs, span_rules(PERSONS, LOCATIONS), Recognizer(load_stub, tuple(STUB)))
    types = F.array_join(F.sort_array("redacted_types"), "|").alias("entity_types")
    return out.select("doc_id", "sanitized_text", types)


# --- failing models ------------------------------------------------------------

_FAILS = "contains(t, 'ci') AND length(t) < 2000"


def load_moody_model():
    """A scoring model that fails on some texts."""
    score = _load_lexicon_model()

    def predict(texts):
        if any("ci" in t and len(t) < 2000 for t in texts):
            raise RuntimeError("cannot read this")
        return score(texts)

    return predict


_MOODY_TEXT = "CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 = 5 THEN text || ' stupid idiot dumb ugly' ELSE text END"
_MODE = f"CASE WHEN doc_id % 3 = 0 THEN 'open' WHEN doc_id % 3 = 1 OR {_FAILS} THEN 'closed' ELSE 'raise' END"
_MOODY_POLICY = Policy(name="Moody", toxicity_enabled=True, toxicity_threshold=0.02)


@query("model_on_error", f"""WITH d AS (SELECT doc_id, {_MOODY_TEXT} AS t FROM documents),
m AS (SELECT *, {_FAILS} AS fails, {_MODE} AS on_error, {_LEXICON_SCORE} AS score FROM d),
l AS (SELECT *, CASE WHEN fails THEN CASE on_error WHEN 'closed' THEN
  'Plugin:LangKit: scan failed (RuntimeError: cannot read this)' END
  WHEN t IS NOT NULL AND score > 0.02 THEN 'Plugin:LangKit: Toxicity detected (' || printf('%.2f', score) || ')' END AS label FROM m)
SELECT doc_id, on_error, CASE WHEN fails THEN 'RuntimeError: cannot read this' END AS error, coalesce(label, '') AS triggered,
  CASE WHEN label IS NULL THEN 'allowed' ELSE 'blocked' END AS action FROM l""")
def model_on_error(spark, sf_dir):
    """One policy over texts of which some are NULL and some make the model fail, each with its own rule of what that means."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr(_MOODY_TEXT).alias("t"))
    docs = docs.withColumn("on_error", F.expr(_MODE))
    models = Models(score_result=lambda text: model_result(text, load_moody_model), on_error=F.col("on_error"))
    out = scan(docs, _MOODY_POLICY, "t", models=models)
    # the same model once more, for its error field
    error = model_result(F.col("t"), load_moody_model)["error"]
    return out.withColumn("error", error).select("doc_id", "on_error", "error", F.array_join("triggered", "|").alias("triggered"), "action")


# --- long term lists -----------------------------------------------------------

_PARTS = """SELECT lower(substr(text, CAST(1 + 11 * j AS BIGINT), CAST(1 + (doc_id + j) % 8 AS BIGINT))) AS term, min(doc_id * 10 + j) AS rank
FROM (SELECT doc_id, text, unnest(range(0, 10)) AS j FROM documents) WHERE length(text) > 11 * j GROUP BY 1"""


def _parts(spark, sf_dir):
    """Pieces of one to eight characters of all documents: some 6,000 terms at sf0.01."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    j = F.col("j")
    term = F.lower(F.substr("text", 1 + 11 * j, (1 + (F.col("doc_id") + j) % 8).cast("int")))
    return rows.filter(F.length("text") > 11 * j).groupBy(term.alias("term")).agg(F.min(F.col("doc_id") * 10 + j).alias("rank"))


@query("substring_blocklist", f"""WITH terms AS ({_PARTS}),
h AS (SELECT conv_id, turn, term, rank FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations) JOIN terms ON contains(low, term) AND term <> '')
SELECT conv_id, turn, count(*)::BIGINT AS n_found, string_agg(term, '|' ORDER BY rank, term) AS found FROM h GROUP BY conv_id, turn""")
def substring_blocklist(spark, sf_dir):
    """All turns against thousands of substrings."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = blocklist.substring_hits(turns, ["conv_id", "turn"], _parts(spark, sf_dir))
    return out.withColumn("found", F.array_join("found", "|"))


#: The SQL's pattern, looked for at the start of a word only: a long word is read once and not from each of its characters.
_PHRASE = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]++ [\p{L}\p{N}_]++"
_PHRASES = r"""SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\pL\pN_]+ [\pL\pN_]+'))) AS term FROM documents"""


@query("large_blocklist_phrases", rf"""WITH RECURSIVE terms AS ({_PHRASES}),
r AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]+') AS runs FROM conversations),
p AS (SELECT id, runs, unnest(range(1, len(runs) - 1)) AS pos FROM r WHERE len(runs) >= 3),
h AS (SELECT id, pos, runs[pos] || runs[pos + 1] || runs[pos + 2] AS span FROM p JOIN terms ON lower(runs[pos] || runs[pos + 1] || runs[pos + 2]) = term
  WHERE regexp_matches(runs[pos], '^[\pL\pN_]')),
n AS (SELECT id, pos, span, (SELECT min(x.pos) FROM h x WHERE x.id = h.id AND x.pos >= h.pos + 3) AS nxt FROM h),
k AS (SELECT n.id, n.pos, n.span, n.nxt FROM n JOIN (SELECT id, min(pos) AS pos FROM h GROUP BY id) f ON f.id = n.id AND f.pos = n.pos
  UNION ALL SELECT n.id, n.pos, n.span, n.nxt FROM k JOIN n ON n.id = k.id AND n.pos = k.nxt)
SELECT id, 'Topic:' || array_to_string(list_sort(list_distinct(list(span))), ',') AS label, count(*)::BIGINT AS n_hits FROM k GROUP BY id""")
def large_blocklist_phrases(spark, sf_dir):
    """All turns against the two-word phrases of all documents, a list over the query's broadcast limit."""
    phrases = F.explode(F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(0)))
    terms = load(spark, sf_dir, "documents").select(phrases.alias("term"))  # lower-cased and made distinct with the hits
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return blocklist.blocklist_hits(turns, "id", terms, broadcast_rows=1_000).withColumn("n_hits", F.col("n_hits").cast("bigint"))


# --- intents as a table --------------------------------------------------------

@query("semantic_top1_table", """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS intent, list_dot_product(a.v, list_reverse(b.v)) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS score
  FROM u a, u b),
t AS (SELECT vec_id, intent, score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, intent) AS n FROM p)
SELECT vec_id, intent, round(score, 6) AS score FROM t WHERE n = 1""")
def semantic_top1_table(spark, sf_dir):
    """All embeddings against an intent for each of them (its reversed vector)."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    table = vectors.select(F.col("vec_id").alias("intent"), F.reverse("embedding").alias("embedding"))
    return top_intents(vectors, table, "vec_id").withColumn("score", F.round("score", 6))
