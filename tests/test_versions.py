"""Versions of policies, latency sketches and audit streams against plain statements."""

import datetime as dt
import random

import pytest

from textweir.operators import audit
from textweir.operators.versions import RULES, as_of, policy_rows, versioned_scan
from textweir.policy import Policy

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def test_as_of_takes_the_version_of_the_time(spark):
    rng = random.Random(1)
    held = {(p, v): rng.choice([*range(0, 300, 7), 48, 72]) for p in "ab" for v in range(1, 9)} | {("a", 99): None}
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, -5, *range(0, 400, 3), 48, 72])) for i in range(400)]
    versions = spark.createDataFrame([(p, v, hours(h), f"{p}{v}") for (p, v), h in held.items()],
                                     "policy string, version int, valid_from timestamp, extra string")
    table = spark.createDataFrame([(i, p, hours(h)) for i, p, h in rows], "id int, policy string, time timestamp")
    got = {r.id: r for r in as_of(table, versions, "time").collect()}
    assert len(got) == 400
    for i, p, h in rows:
        known = [(w, v) for (q, v), w in held.items() if q == p and h is not None and w is not None and w <= h]
        want = max(known)[1] if known else None
        assert (got[i].version, got[i].extra) == (want, f"{p}{want}" if want else None), (p, h)
    assert as_of(table.limit(0), versions, "time").count() == 0
    assert {r.version for r in as_of(table, versions.limit(0), "time").collect()} == {None}


def test_versioned_scan_and_hot_policies(spark):
    first = Policy(name="P", topics=("gold",), pii_enabled=True, pii_patterns=("EMAIL",))
    second = Policy(name="P", topics=("silver bar",), injection_enabled=True, shadow_mode=True)
    versions = spark.createDataFrame([("P", 1, hours(1), False), ("P", 2, hours(5), True)],
                                     "policy string, version int, valid_from timestamp, shadow_mode boolean")
    rules = spark.createDataFrame(policy_rows(first, "P", 1) + policy_rows(second, "P", 2), RULES)
    text = "Gold and a Silver bar, a@b.co; please jailbreak"
    asked = [(0, "P", hours(0), text), (1, "P", hours(1), text), (2, "P", hours(5), text), (3, "Q", hours(5), text), (4, "P", None, text), (5, "P", hours(2), None)]
    df = spark.createDataFrame(asked, "id int, policy string, time timestamp, text string")
    got = {r.id: (r.version, r.sanitized_text, r.triggered, r.action) for r in versioned_scan(df, versions, rules, "id").collect()}
    none = (None, text, [], "allowed")
    assert got == {
        0: none, 3: none, 4: none, 5: (1, None, [], "allowed"),
        1: (1, text.replace("a@b.co", "<EMAIL_REDACTED>"), ["PII:EMAIL", "Topic:Gold"], "blocked"),
        2: (2, text, [got[2][2][0], "Topic:Silver bar"], "shadow_block")}
    assert "njection" in got[2][2][0]


def test_percentiles_from_merged_sketches(spark):
    rng = random.Random(3)
    rows = [(b, "p", rng.choice("xy"), rng.choice(["allowed", "blocked"]), rng.choice([None, rng.random() * 100, rng.random()])) for b in range(6) for _ in range(3_000)]
    rows += [(0, "p", "z", "allowed", None)]
    events = spark.createDataFrame(rows, "batch_id int, profile string, source string, action string, latency_ms double")
    sketches = audit.latency_sketches(events)
    got = {(r.profile, r.source, r.action): r for r in audit.latency_percentiles(sketches, (0.1, 0.5, 0.99)).collect()}
    for (p, s, a), r in got.items():
        cell = [x for _, q, t, c, x in rows if p in (None, q) and s in (None, t) and a in (None, c)]
        assert r.n == len(cell)
        known = sorted(x for x in cell if x is not None)
        if not known:
            assert r.latency_ms is None
            continue
        for share, e in zip((0.1, 0.5, 0.99), r.latency_ms):
            below, upto = (sum(f(x) for x in known) / len(known) for f in (lambda x: x < e, lambda x: x <= e))
            assert below - audit.RANK_ERROR <= share <= upto + audit.RANK_ERROR
    assert audit.latency_percentiles(sketches.limit(0)).count() <= 1


@pytest.mark.parametrize("kept", [0, 2])
def test_audit_rows_have_a_mark_or_a_stream(spark, kept):
    rows = spark.createDataFrame([(1, i, "a", "b" if i % 2 else "a", "PASSED") for i in range(4)],
                                 "batch_id int, id bigint, original_prompt string, sanitized_prompt string, verdict string")
    mark = None if kept == 0 else (1, kept - 1)
    out = audit.new_audit_rows(rows, mark).orderBy("id").collect()
    assert [(r.id, r.notice) for r in out] == [(i, i % 2 == 1) for i in range(kept, 4)]


def test_few_versions_go_to_the_rows(spark):
    """Rows of a few days of one policy have a few keys: they would all be shuffled to a few tasks."""
    versions = spark.createDataFrame([("P", 1, hours(1))], "policy string, version int, valid_from timestamp")
    rows = spark.range(100).selectExpr("id", "'P' AS policy", "timestamp_seconds(1704067200 + id * 60) AS time")
    out = as_of(rows, versions, "time")
    assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()
    assert [r.version for r in out.orderBy("id").collect()] == [None] * 60 + [1] * 40
