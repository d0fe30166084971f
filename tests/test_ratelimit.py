import random

import pytest
from pyspark.sql import functions as F

from conftest import iter_admit
from textweir.operators import ratelimit


def log(spark, rows, schema="id int, client string, sec double"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec"))


def by_rule(rows, n, w):
    out = {}
    for client in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == client), key=lambda r: (r[2], r[0]))
        times = [round(r[2] * 1e6) for r in mine]
        for r, ok in zip(mine, iter_admit(iter(times), n, int(w * 1e6))):
            out[r[0]] = ok
    return out


@pytest.mark.parametrize("times, want", [
    ([0, 10, 20, 60], [True, True, False, True]),
    ([0, 50, 55, 59, 60], [True, True, False, False, True]),
])
def test_golden(spark, times, want):
    df = log(spark, [(i, "c", float(t)) for i, t in enumerate(times)])
    got = ratelimit.rate_limit(df, "client", "ts", "id", 2, 60).orderBy("id").collect()
    assert [r.admitted for r in got] == want


def requests(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for client, gap, count in (("hot", 0.4, 1500), ("warm", 9, 200), ("calm", 40, 60), ("once", 1, 1), ("burst", 0, 90)):
        t = rng.uniform(0, 100)
        for _ in range(count):
            t += rng.choice([0, rng.expovariate(1 / gap) if gap else rng.choice([0, 0, 0.25, 61])])
            rows.append((i, client, round(t * 4) / 4))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, slots, group", [(10, 8, 10**9), (3, 1, 10**9), (60, 7, 10**9), (10, 8, 100), (3, 4, 37), (0, 2, 50)])
def test_equals_the_rule(spark, n, slots, group):
    rows = requests(n + slots)
    got = ratelimit.rate_limit(log(spark, rows), "client", "ts", "id", n, 60, group_rows=group,
                               slots_per_window=slots).collect()
    assert len(got) == len(rows)
    assert {r.id: r.admitted for r in got} == by_rule(rows, n, 60)


def test_only_api_paths_count(spark):
    rows = [(i, "c", float(i)) for i in range(6)]
    df = log(spark, rows).withColumn("path", F.when(F.col("id") % 2 == 0, "/v1/chat").when(F.col("id") == 1, "/static"))
    got = ratelimit.rate_limit(df, "client", "ts", "id", 2, 60, path="path").collect()
    assert {r.id: r.admitted for r in got} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True}


def test_missing_client_is_one_client(spark):
    df = log(spark, [(i, None if i % 2 else "c", float(i)) for i in range(8)])
    got = ratelimit.rate_limit(df, "client", "ts", "id", 2, 60).collect()
    assert {r.id for r in got if r.admitted} == {0, 1, 2, 3} and len(got) == 8
    assert {r.id: r.rate for r in ratelimit.request_rate(df, "client", "ts", 60).collect()}[7] == 4


def test_request_rate(spark):
    rows = requests(3)
    got = {r.id: r.rate for r in ratelimit.request_rate(log(spark, rows), "client", "ts", 60).collect()}
    for i, client, t in rows:
        assert got[i] == sum(1 for _, c, u in rows if c == client and t - 60 < u <= t)


def test_no_task_holds_a_whole_client(spark):
    """The windows over requests are keyed by client *and* slot."""
    plan = ratelimit.request_rate(log(spark, requests(1)), "client", "ts", 60)._jdf.queryExecution().optimizedPlan().toString()
    over_requests = [line for line in plan.splitlines() if "Window" in line and "__d" in line]
    assert over_requests and all("__slot" in line.split("], [")[1] for line in over_requests)


def test_requests_without_a_time_pass(spark):
    rows = [(i, "c", float(t)) for i, t in enumerate([0, 10, 20, 30])]
    df = log(spark, rows).withColumn("ts", F.when(F.col("id") != 1, F.col("ts")))
    got = ratelimit.rate_limit(df, "client", "ts", "id", 2, 60).orderBy("id").collect()
    assert [r.admitted for r in got] == [True, True, True, False]
    rates = ratelimit.request_rate(df, "client", "ts", 60).orderBy("id").collect()
    assert [r.rate for r in rates] == [1, None, 2, 3]
