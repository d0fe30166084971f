"""Registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, quality, secrets, sketch, toxicity, urlrules, warc, whitening
from .decontaminate import overlaps
from .neardup import near_duplicates
from .packing import pack
from .pii import pseudonymize
from .prefixtrie import prefix_trie
from .shared import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


PACK_TOKENIZER = "word_bpe_49k.json"


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@_query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op2_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, least(len(w), 13) AS m, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
        FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS t FROM cut),
places AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p
           FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT doc_id, p, m, item_id
        FROM (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS t FROM places) JOIN win USING (m, t)),
hit_words AS (SELECT doc_id, count(DISTINCT x) AS n_hit
              FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _secret_sql() -> str:
    rules = secrets.BASE + secrets.MORE
    texts = [r.pattern.replace("'", "''") for r in rules]
    pieces = ", ".join(
        f"string_split_regex(t, '{p}') AS g{i}, regexp_extract_all(t, '{p}') AS m{i}, "
        f"regexp_extract_all(t, '{p}', {r.value}) AS v{i}" for i, (r, p) in enumerate(zip(rules, texts)))
    spans = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS k, '{r.kind}' AS kind, s, s + length(m{i}[j]) AS e FROM (
            SELECT doc_id, m{i}, v{i}, j, list_sum(list_transform(g{i}[1:j], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: length(x))), 0) AS s
            FROM (SELECT doc_id, g{i}, m{i}, v{i}, unnest(range(1, len(m{i}) + 1)) AS j FROM cut))
            WHERE length(v{i}[j]) >= {r.least}""" for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""
WITH cut AS (SELECT doc_id, {pieces} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
span AS ({spans}),
listed AS (SELECT doc_id, {counts},
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k)
        FILTER (k < {len(secrets.BASE)}) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans
    FROM span GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)"""


ORACLES["op6_secrets"] = _secret_sql()

#: Of the registered query only; a user passes a secret one.
PII_KEY = "textweir"


@_query
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return made.select("doc_id", "text", F.array_join("kinds", ",").alias("kinds"))


@_query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketch.fingerprint_pairs(_table(spark, sf_dir, "documents"))

    def text(name: str) -> Column:
        return F.array_join(F.transform(F.col(name), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")

    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text("sketch").alias("fingerprint"),
                       text("edited_sketch").alias("edited_fingerprint"),
                       sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


#: (host, path, verdict) of the registered query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


@_query
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages"), rules)


ORACLES["op7_url_rules"] = """
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS p FROM pages),
v AS (SELECT page_id, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path FROM u),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                            ('org', '/fr/', 'allow')),
f AS (SELECT page_id, h || p AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, h || p) AS n
      FROM v JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p))
SELECT v.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM v LEFT JOIN f ON v.page_id = f.page_id AND n = 1"""


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    got = warc.read(spark, path)
    revisit = F.col("type") == "revisit"
    # a revisit repeats size and digest of the payload it stands for
    return got.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d"""


@_query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.classify(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return made.select("doc_id", *(F.round(c, 6).alias(c) for c in ("kind_1", "kind_2", "toxic")), "rejected")


PIECE_MODEL = "piece_bpe_32k.model"


@_query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    made = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), path), path)
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(_table(spark, sf_dir, "embeddings"), 8)
    return made.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation",
                       "identity_error").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix_trie(_table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# crc32: a byte is taken in, then eight bits go out (-1)
ORACLES["op11_prefix_trie"] = """
WITH t AS (SELECT conv_id, bytes, g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p
    FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
        sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
        FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, flatten(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END),
        4294967295) % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n b ON b.conv_id = n.base),
built AS (SELECT c.conv_id, p AS depth, bytes, g FROM c JOIN t ON t.conv_id = c.base AND p <= h
    UNION ALL SELECT c.conv_id, k + p - h, bytes, g FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
path AS (SELECT conv_id, depth, bytes, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS f FROM built
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT depth, f, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM path GROUP BY depth, f),
up AS (SELECT DISTINCT x.depth, x.f, y.f AS above FROM path x JOIN path y ON x.conv_id = y.conv_id AND y.depth = x.depth - 1),
kids AS (SELECT depth - 1 AS depth, above AS f, count(*) AS n_children FROM up GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, f)),
below AS (SELECT path.depth, path.f, sum((n_convs - 1) * x.bytes) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM full_node x JOIN path ON path.conv_id = x.conv_id AND path.depth <= x.depth GROUP BY 1, 2),
longest AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
ends AS (SELECT depth, f, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM path JOIN longest USING (conv_id, depth) GROUP BY 1, 2)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM full_node x JOIN below USING (depth, f) LEFT JOIN ends USING (depth, f) LEFT JOIN up USING (depth, f)
LEFT JOIN node y ON y.depth = x.depth - 1 AND y.f = above"""
