"""Training samples, the label model and the classifier chain against plain statements."""

import random

import numpy as np
from pyspark.sql import functions as F

from test_text_operators import table
from textweir.llm import quality, toxicity
from textweir.llm.hashed import fit_logistic, sigmoid
from textweir.llm.shared import training_sample


def test_samples_are_bounded_in_rows_and_characters(spark):
    rows = [(1, "a" * 10)] * 300 + [(1, "b" * 9)] * 200 + [(i, "x" * 50) for i in range(2, 60)] + [(None, "n")] * 40 + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra", F.lit(1)).repartition(5)
    whole = training_sample(docs, 1_000, 10**9).collect()
    assert sorted(r.doc_id for r in whole) == list(range(1, 62))
    assert len({r.text for r in whole if r.doc_id == 1}) == 1
    assert len(training_sample(docs, 2, 10**9).collect()) == 2
    short = training_sample(docs, 1_000, 500).collect()
    assert 8 <= len(short) < 61 and sum(len(r.text or "") for r in short) <= 500
    assert {r.doc_id for r in short} <= {r.doc_id for r in whole}
    assert training_sample(docs.limit(0), 5, 100).collect() == []


def test_repeated_labels_and_rows_do_not_grow_the_training_set(spark):
    docs = spark.createDataFrame([(1, "you foul thing")] * 500 + [(2, "fine words")] * 5 + [(3, "good")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in toxicity.training_rows(docs, labels).collect())
    assert got == [(1, True), (2, False)]


def test_categories_come_from_the_labelled_rows(spark):
    """Toxic rows of two vocabularies that no list of the code knows."""
    rng = random.Random(2)
    plain = ["river", "stone", "cloud", "walk", "table", "paper", "green", "house", "seven", "music"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=30)
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = "zorkface" if i % 3 else "blithering"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, known.filter("doc_id < 400")).collect()}
    for i, text in rows[400:]:
        assert got[i].rejected == (i % 5 == 0), text
        assert (got[i].kind_1 > 0.5) == ("zorkface" in text) and (got[i].kind_2 > 0.5) == ("blithering" in text)
    none = toxicity.toxic_documents(docs.limit(5), known.limit(0)).collect()
    assert len(none) == 5 and not any(r.rejected for r in none)


def test_chain_equals_the_same_steps_by_hand(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(6)]
    has = rng.random((200, 6)) < 0.3
    first = has[:, 0] | (rng.random(200) < 0.05)
    second = has[:, 1] & first | has[:, 2]
    rows = [(i, " ".join(w for w, h in zip(words, has[i]) if h), bool(first[i]), bool(second[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, a boolean, b boolean")
    chain = toxicity.fit(df, ("a", "b"))
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    # features of each text, by the operator's own screen; the chain by hand
    present = np.array([np.isin(chain.buckets, list(buckets_of(t))) for _, t, *_ in rows]).astype(np.float32)
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(200)])
    whole = fit_logistic(present, first.astype(float))
    apart = np.zeros(200)
    for f in range(toxicity.FOLDS):
        w = fit_logistic(present[fold != f], first[fold != f].astype(float))
        apart[fold == f] = sigmoid(present[fold == f] @ w[:-1] + w[-1])
    after = fit_logistic(np.concatenate((present, apart[:, None].astype(np.float32)), axis=1), second.astype(float))
    for i in range(200):
        a = sigmoid(present[i] @ whole[:-1] + whole[-1])
        b = sigmoid(present[i] @ after[:-2] + a * after[-2] + after[-1])
        assert abs(got[i].a - a) < 2e-3 and abs(got[i].b - b) < 2e-3


def buckets_of(text):
    import pyarrow as pa

    from textweir.llm.hashed import marks, word_features
    ids, _ = marks(*word_features(pa.array([text]), toxicity.BUCKETS), toxicity.BUCKETS)
    return set(ids.tolist())


def test_expectation_maximisation_in_plain_python():
    rng = random.Random(7)
    patterns = [tuple(rng.choice([1, 0, -1]) for _ in range(3)) for _ in range(40)]
    patterns = sorted(set(patterns))
    counts = [rng.randint(1, 50) for _ in patterns]
    good = [sum(v == 1 for v in p) for p in patterns]
    bad = [sum(v == 0 for v in p) for p in patterns]
    post = [0.5 if g + b == 0 else (g + 0.5) / (g + b + 1) for g, b in zip(good, bad)]
    for _ in range(200):
        prior = (sum(c * q for c, q in zip(counts, post)) + 1) / (sum(counts) + 2)
        chance = {}
        for j in range(3):
            for y in (0, 1):
                w = {v: 1.0 + sum(c * (q if y else 1 - q) for p, c, q in zip(patterns, counts, post) if p[j] == v) for v in (0, 1, -1)}
                for v in w:
                    chance[j, y, v] = w[v] / sum(w.values())
        new = []
        for p in patterns:
            like = {y: (prior if y else 1 - prior) for y in (0, 1)}
            for j, v in enumerate(p):
                for y in (0, 1):
                    like[y] *= chance[j, y, v]
            new.append(like[1] / (like[0] + like[1]))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        if done:
            break
        post = new
    model = quality.fit_votes(np.array(patterns, np.int64), np.array(counts, float))
    assert np.abs(model.posterior(np.array(patterns, np.int64)) - new).max() < 1e-9


def test_quality_of_rows_without_ids_and_repeated_rows(spark):
    docs = table(spark, ["word " * 60, "$$ ## " * 40, None, ""])
    odd = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("bigint")))
    got = quality.classify(odd).collect()
    assert len(got) == 12 and sum(r.doc_id is None for r in got) == 4
    assert len({(r.posterior, r.score) for r in got if r.doc_id == 0}) == 1
    assert len(quality.classify(odd, training_rows=1, training_chars=10).collect()) == 12
