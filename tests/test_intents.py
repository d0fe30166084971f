"""Intents as a table against a plain product."""

import numpy as np
import pytest

from textweir.operators import intents as it


@pytest.mark.parametrize("block, lanes", [(7, 3), (1_024, 2)])
def test_best_of_all_intents(spark, monkeypatch, block, lanes):
    monkeypatch.setattr(it, "BLOCK", block)
    rng = np.random.default_rng(block)
    v, w = rng.standard_normal((60, 5)), rng.standard_normal((33, 5))
    v[3], v[50], w[20], w[9] = 0, w[11] * 2, 0, w[4]
    vectors = spark.createDataFrame([(f"k{i}", x.tolist(), 1) for i, x in enumerate(v)] + [("none", None, 1)], "id string, embedding array<double>, rank int")
    table = spark.createDataFrame([(f"i{i}", x.tolist(), 100 - i) for i, x in enumerate(w)] + [("null", None, 0)],
                                  "intent string, embedding array<double>, rank int")
    got = {r.id: r for r in it.top_intents(vectors.repartition(4), table.repartition(3), "id", lanes=lanes).collect()}
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    scores = unit(v) @ unit(w).T
    assert len(got) == 61 and got["none"].intent is None and got["none"].score is None
    for i in range(60):
        assert abs(got[f"k{i}"].score - scores[i].max()) < 1e-12
        if i != 3:
            best = scores[i].argmax()
            assert got[f"k{i}"].intent == f"i{9 if best in (4, 9) else best}"  # of equal vectors the smaller rank
    assert (got["k3"].score, got["k3"].intent) == (0.0, "i32")  # like nothing: the first listed
    assert {r.intent for r in it.top_intents(vectors, table.limit(0), "id").collect()} == {None}
    assert it.top_intents(vectors.limit(0), table, "id").count() == 0
    with pytest.raises(Exception, match="one length"):
        it.top_intents(vectors, spark.createDataFrame([("a", [1.0, 2.0])], "intent string, embedding array<double>"), "id").collect()


def test_intents_go_to_no_broadcast_and_ties_to_the_first_listed(spark, monkeypatch):
    monkeypatch.setattr(it, "BLOCK", 2)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 0.0]) for i in range(9)], "id int, embedding array<double>")
    # of one score with all vectors, and not of one vector
    table = spark.createDataFrame([(i, [0.0, float(10 - i)] if i % 2 else [0.0, -float(i + 1)]) for i in range(8)], "intent int, embedding array<double>")
    out = it.top_intents(vectors, table.repartition(5), "id", lanes=2)
    assert {(r.intent, r.score) for r in out.collect()} == {(0, 0.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "lane" not in joins[0]  # the lanes of all intents are never one side of a join, which may be broadcast
    assert "RepartitionByExpression" in plan
