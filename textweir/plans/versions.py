"""Queries of policies that change in time, audit tables as streams, and latency percentiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import audit
from ..operators.scan import scan
from ..operators.versions import RULES, policy_rows, versioned_scan
from ..policy import Policy
from ..sources import sinks
from ..streaming import live
from . import oracle as o
from .operations import _EVENTS_SQL, _docs, _gateway, _VERDICT_SQL
from .policies import HOUSE, KEYWORDS, WORDS
from .registry import query
from .tables import finish, load, work_path

#: The versions of one policy, and when each came into force.
_VERSIONS = [
    (1, "2024-01-01 05:00:00", Policy(name="Desk", topics=WORDS[:2], pii_enabled=True, pii_patterns=("CREDIT_CARD",))),
    (2, "2024-01-02 12:30:00", Policy(name="Desk", topics=WORDS, injection_enabled=True, injection_keywords=KEYWORDS)),
    (3, "2024-01-03 20:30:00", Policy(name="Desk", shadow_mode=True, topics=WORDS[2:], injection_enabled=True, injection_keywords=KEYWORDS[:1],
                                      pii_enabled=True, pii_patterns=("EMAIL", "PHONE", "SSN", "CREDIT_CARD"))),
]
_ASKED = "SELECT conv_id, turn, text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id % 100 * 60 + turn AS BIGINT)) AS time FROM conversations"


def _version_sql() -> str:
    parts = []
    for i, (version, since, policy) in enumerate(_VERSIONS):
        until = f"AND time < TIMESTAMP '{_VERSIONS[i + 1][1]}'" if i + 1 < len(_VERSIONS) else ""
        parts.append(f"""SELECT * FROM (WITH q AS (SELECT * FROM ({_ASKED}) WHERE time >= TIMESTAMP '{since}' {until}), {o.scan_ctes('q', policy)}
  SELECT conv_id, turn, {version} AS version, sanitized_text, triggered, valid, reason, action FROM s)""")
    first = f"SELECT conv_id, turn, NULL::INT, text, '', true, '', 'allowed' FROM ({_ASKED}) WHERE time < TIMESTAMP '{_VERSIONS[0][1]}'"
    return "\nUNION ALL ".join([*parts, first])


def _tables(spark):
    rules = [row for version, _, policy in _VERSIONS for row in policy_rows(policy, "Desk", version)]
    held = [("Desk", version, dt.datetime.fromisoformat(since), policy.shadow_mode) for version, since, policy in _VERSIONS]
    return (spark.createDataFrame(held, "policy string, version int, valid_from timestamp, shadow_mode boolean"),
            spark.createDataFrame(rules, RULES))


@query("policy_versions", _version_sql())
def policy_versions(spark, sf_dir):
    """Turns as a stream of two micro-batches, the later ones first: each is judged by the policy's version of
    its own time, also where that had been replaced when the turn arrived."""
    feed, out, state = (work_path(spark, n) for n in ("versions-feed", "versions-out", "versions-state"))
    minutes = F.col("conv_id") % 100 * 60 + F.col("turn")
    asked = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.lit("Desk").alias("policy"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("id"),
        F.timestamp_add("MINUTE", minutes.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("time"))
    versions, rules = _tables(spark)

    def judge(batch, batch_id: int) -> None:
        live.batch_parquet_sink(out)(versioned_scan(batch, versions, rules, "id"), batch_id)

    late = F.col("conv_id") % 100 < 50
    for part in (~late, late):
        asked.filter(part).write.mode("append").parquet(feed)
        finish(spark.readStream.schema(asked.schema).parquet(feed).writeStream.foreachBatch(judge), spark, "versions", checkpoint=state)
    return spark.read.parquet(out).select("conv_id", "turn", "version", "sanitized_text", F.array_join("triggered", "|").alias("triggered"),
                                          "valid", "reason", "action")


@query("audit_follow", f"""WITH {_EVENTS_SQL} SELECT doc_id::VARCHAR AS client_ip, {_VERDICT_SQL} AS verdict,
  action <> 'blocked' AS notice, (doc_id % 3 + 1)::BIGINT AS batch_id, 1::BIGINT AS times FROM s""")
def audit_follow(spark, sf_dir):
    """An audit table followed as a stream by two runs over one checkpoint, while it grows by three batches."""
    path, out, state = (work_path(spark, n) for n in ("follow-table", "follow-out", "follow-state"))
    rows, sink = _gateway(spark, sf_dir), sinks.table_sink(path)
    third = F.col("client_ip").cast("bigint") % 3
    for batches in ((0, 1), (2,)):
        for b in batches:
            sink(rows.filter(third == b), b + 1)
        fresh = live.follow_audit(spark, path, spark.read.parquet(path).schema).withColumn("batch_id", F.col("batch_id").cast("bigint"))
        finish(fresh.writeStream.format("parquet").option("path", out), spark, "follow", checkpoint=state)
    got = spark.read.parquet(out)
    # the texts are kept as hashes, so every one differs from the sanitized text
    return got.groupBy("client_ip", "verdict", "notice", "batch_id").agg(F.count("*").alias("times"))


_CELLS = "profile, source, action"


@query("audit_percentiles", f"""WITH {_EVENTS_SQL}, c AS (SELECT 'House_v1' AS profile, 'input' AS source, action FROM s)
SELECT profile, source, action, grouping(profile, source, action)::BIGINT AS level, count(*)::BIGINT AS n,
  true AS ok_50, true AS ok_95, true AS ok_99 FROM c GROUP BY CUBE (profile, source, action)""")
def audit_percentiles(spark, sf_dir):
    """Percentiles from the merged sketches of eight batches; the exact rank of each is within the stated error."""
    docs = _docs(spark, sf_dir).withColumn("latency_ms", F.length("text") / 8.0)
    events = audit.audit_events(scan(docs, HOUSE), HOUSE, keys=("doc_id",)).withColumn("batch_id", F.col("doc_id") % 8)
    stored = audit.latency_sketches(events)
    path = work_path(spark, "sketches")
    stored.write.parquet(path)
    shares = (0.5, 0.95, 0.99)
    found = audit.latency_percentiles(spark.read.parquet(path), shares)
    # every event stands in eight cells of the cube
    cells = events.select("latency_ms", *(F.explode(F.array(F.col(c), F.lit(None))).alias(c) if i == 0 else F.col(c)
                                          for i, c in enumerate(_CELLS.split(", "))))
    for c in ("source", "action"):
        cells = cells.withColumn(c, F.explode(F.array(F.col(c), F.lit(None))))
    at = [cells[c].eqNullSafe(found[c]) for c in _CELLS.split(", ")]
    both = cells.join(F.broadcast(found), at).select(*(found[c] for c in (*_CELLS.split(", "), "level", "n")), cells["latency_ms"].alias("x"),
                                                     found["latency_ms"].alias("e"))
    ok = []
    for i, share in enumerate(shares):
        e = F.get("e", F.lit(i))
        below, upto = (F.avg(t.cast("int")) for t in (F.col("x") < e, F.col("x") <= e))
        ok.append(((below - audit.RANK_ERROR <= share) & (share <= upto + audit.RANK_ERROR)).alias(f"ok_{round(share * 100)}"))
    return both.groupBy(*_CELLS.split(", "), "level", "n").agg(*ok)
