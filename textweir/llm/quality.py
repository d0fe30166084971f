"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Every labeller votes good, bad or nothing on a text. A latent-class model estimates each
labeller's accuracy for good and for bad texts from how the votes agree; it needs only how
often each pattern of votes occurs (at most 3 to the power of the labellers), counted over
all documents. The posterior of a pattern is the label of its texts. A linear model on hashed
byte runs and the measured shares learns these labels, and scores all texts, also those on
which no labeller votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import byte_features, sigmoid
from .shared import saved, training_sample
from .wordscan import slices

BUCKETS = 1 << 16
#: Documents that the scorer is fitted on, at most: those with the smallest hash of their id.
TRAINING_ROWS = 6_000
#: Characters of all these together, at most: their features go to the driver.
TRAINING_CHARS = 64_000_000
#: Probability of "good" from which a document is kept.
KEEP = 0.5


class Labeller(NamedTuple):
    """Votes bad below ``bad`` and good above ``good`` (or the other way round, if ``bad`` is larger)."""

    name: str
    share: str  # a column that ``measured`` makes
    bad: float
    good: float


LABELLERS = (
    Labeller("variety", "distinct_words", 0.45, 0.60),
    Labeller("lines", "distinct_lines", 0.75, 0.95),
    Labeller("symbols", "symbol_share", 0.02, 0.005),
    Labeller("capitals", "capital_share", 0.15, 0.06),
    Labeller("sentences", "stops_per_word", 0.02, 0.05),
    Labeller("letters", "word_length", 7.2, 6.8),
    Labeller("stutter", "repeated_words", 0.10, 0.04),
)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one column for each measure."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.char_length("text")
    cut = docs.withColumn("text", text).select(
        "doc_id", "text",
        F.transform(F.array(F.filter(F.split("text", r"\s+"), lambda w: w != "")), lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.get(w, i) == F.get(w, i - 1)),
                            lambda same: same)).alias("repeated"),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)).alias("letters")))[0].alias("w"),
        F.transform(F.array(F.filter(F.split("text", "\n"), lambda x: x != "")), lambda x: F.struct(
            F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))[0].alias("l"))

    def without(chars: str) -> Column:
        return size - F.char_length(F.translate("text", chars, ""))

    return cut.select(
        "doc_id", "text",
        F.try_divide("w.distinct", "w.n").alias("distinct_words"), F.try_divide("l.distinct", "l.n").alias("distinct_lines"),
        F.try_divide(without("#$%&*|!<>{}[]~^=\\"), size).alias("symbol_share"),
        F.try_divide(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size).alias("capital_share"),
        F.try_divide(without(".?"), F.col("w.n")).alias("stops_per_word"),
        F.try_divide("w.letters", "w.n").alias("word_length"),
        F.try_divide("w.repeated", "w.n").alias("repeated_words"))


def vote(labeller: Labeller) -> Column:
    """1 for good, 0 for bad, -1 for no vote (also without a measure)."""
    x, up = F.col(labeller.share), labeller.good > labeller.bad
    good, bad = (x >= labeller.good, x <= labeller.bad) if up else (x <= labeller.good, x >= labeller.bad)
    return F.when(good, 1).when(bad, 0).otherwise(-1).alias(labeller.name)


class Model(NamedTuple):
    """``prior`` of good; ``table[j, y, v]``: how often labeller j votes v (bad, good, nothing) on class y."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        logs = np.log(self.table)
        odds = np.log(self.prior) - np.log1p(-self.prior) + sum(
            logs[j, 1, votes[:, j]] - logs[j, 0, votes[:, j]] for j in range(votes.shape[1]))
        return sigmoid(odds)

    def accuracy(self) -> np.ndarray:
        """Share of right votes of each labeller, where it votes."""
        right = self.prior * self.table[:, 1, 1] + (1 - self.prior) * self.table[:, 0, 0]
        cast = self.prior * self.table[:, 1, :2].sum(1) + (1 - self.prior) * self.table[:, 0, :2].sum(1)
        return right / cast


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Model:
    """Expectation-maximisation from the majority vote, with add-one smoothing.

    ``votes`` has a row for each pattern (1 good, 0 bad, -1 nothing), ``counts`` its documents.
    """
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    p = np.where(good + bad == 0, 0.5, (good + 0.5) / (good + bad + 1.0))
    model = Model(0.5, np.full((votes.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack((counts * (1 - p), counts * p))
        table = np.stack([np.stack([np.array([weight[y][votes[:, j] == v].sum() for v in (0, 1, -1)]) + 1.0
                                    for y in (0, 1)]) for j in range(votes.shape[1])])
        table = table / table.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        model = Model(prior, table)
        after = model.posterior(votes)
        if np.abs(after - p).max(initial=0.0) < 1e-6:
            break
        p = after
    return model


def _inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of byte runs, the bounds of each text, and the tenths of its measures."""
    ids, bounds = byte_features(batch.column("text").fill_null(""), BUCKETS)
    shares = np.stack([batch.column(x.share).to_numpy(zero_copy_only=False).astype(float) for x in LABELLERS], axis=1)
    low, high = (np.array([f(x.bad, x.good) for x in LABELLERS]) for f in (min, max))
    with np.errstate(invalid="ignore"):
        step = np.floor(4 * (shares - low) / (high - low)) + 1
    step = np.where(np.isnan(step), 7, np.clip(np.nan_to_num(step, nan=7), 0, 6)).astype(np.int64)
    return ids, bounds, step + 8 * np.arange(len(LABELLERS))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: posterior, distinct buckets with counts, steps."""
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, bounds, steps = _inputs(batch)
            of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            both, counts = np.unique(of * BUCKETS + ids, return_counts=True)
            cut = pa.array(np.searchsorted(both, np.arange(batch.num_rows + 1) * BUCKETS), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("posterior"), pa.ListArray.from_arrays(cut, pa.array(both % BUCKETS, pa.int32())),
                pa.ListArray.from_arrays(cut, pa.array(counts, pa.int32())),
                pa.array(list(steps.astype(np.int32)), pa.list_(pa.int32()))], names=["posterior", "ids", "counts", "steps"])


class Scorer(NamedTuple):
    runs: np.ndarray  # weight of each bucket, applied to its share of the text's runs
    steps: np.ndarray
    bias: float


def fit_scorer(rows: pa.Table, rounds: int = 150, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by Adam, all rows in each round."""
    if not len(rows):
        return Scorer(np.zeros(BUCKETS), np.zeros(8 * len(LABELLERS)), 0.0)
    lists = rows.column("ids").combine_chunks()
    ids, counts = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    of, y = np.repeat(np.arange(len(rows)), sizes), rows.column("posterior").to_numpy()
    total = np.bincount(of, counts, len(rows))
    x = counts / np.maximum(total, 1)[of]
    # shares are small numbers; each bucket is scaled by its root mean square
    scale = 1 / np.sqrt(np.bincount(ids, x * x, BUCKETS) / len(rows) + 1e-7)
    x = x * scale[ids]
    steps = np.stack(rows.column("steps").to_numpy()).astype(np.int64)
    n = BUCKETS + 8 * len(LABELLERS) + 1
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, rounds + 1):
        z = np.bincount(of, x * w[ids], len(rows)) + w[BUCKETS + steps].sum(1) + w[-1]
        r = (sigmoid(z) - y) / len(rows)
        g = ridge * w
        g[:BUCKETS] += np.bincount(ids, x * r[of], BUCKETS)
        g[BUCKETS:-1] += np.bincount(steps.ravel(), np.repeat(r, steps.shape[1]), n - BUCKETS - 1)
        g[-1] = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return Scorer(w[:BUCKETS] * scale, w[BUCKETS:-1], float(w[-1]))


def _scoring(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds, steps = _inputs(batch)
                reached = np.concatenate(([0.0], np.cumsum(scorer.runs[ids])))
                z = (reached[bounds[1:]] - reached[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
                p = sigmoid(z + scorer.steps[steps].sum(1) + scorer.bias)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("posterior"), pa.array(p)], names=["doc_id", "posterior", "score"])
    return run


def classify(docs: DataFrame, training_rows: int = TRAINING_ROWS, keep: float = KEEP,
             training_chars: int = TRAINING_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, posterior, score, kept.

    Texts are measured once and stored with their votes. The scorer is fitted on at most ``training_rows``
    documents of at most ``training_chars`` characters in all, everything else covers all documents.

    ``posterior`` is the label model's probability of good from the votes, ``score`` the linear
    scorer's. Null and empty texts get no votes, so their posterior is the prior's; texts
    without words have no measures. Repeated rows and rows without a doc_id are scored each,
    an empty table gives no rows, other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.name for x in LABELLERS]
    shares = [x.share for x in LABELLERS]
    voted = saved(measured(docs).select("doc_id", "text", *shares, *(vote(x) for x in LABELLERS)), "votes")
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ** len(LABELLERS) rows
    votes = np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(len(patterns), len(names))
    model = fit_votes(votes, np.array([r["count"] for r in patterns], float))
    logs = np.log(model.table)
    odds = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for j, name in enumerate(names):
        gain = [float(logs[j, 1, k] - logs[j, 0, k]) for k in (0, 1, 2)]
        odds = odds + F.when(F.col(name) == 0, gain[0]).when(F.col(name) == 1, gain[1]).otherwise(gain[2])
    labelled = voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).select("doc_id", "text", "posterior", *shares)
    rows = training_sample(labelled, training_rows, training_chars).select("text", "posterior", *shares).mapInArrow(
        _rows, "posterior double, ids array<int>, counts array<int>, steps array<int>").toArrow()
    scorer = fit_scorer(rows)
    return (labelled.mapInArrow(_scoring(scorer), "doc_id bigint, posterior double, score double")
            .withColumn("kept", F.col("score") >= keep))
