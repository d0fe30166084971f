"""Toxicity by a classifier chain over screened word features.

Features are hashed words and runs of four and five bytes inside words, taken from the whole
text as present or not, so that a long text does not hide a passage, and once more as frequent
or not. A chi-square screen keeps those that tell a category; it is computed over the training
rows by aggregation. Categories are
predicted in order: the model of each has the earlier categories' probabilities as features,
in training as out-of-fold predictions, so that it learns from errors like those it will meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import fit_logistic, frequent_bucket, marks, sigmoid, word_features
from .shared import drop_saved, saved, training_sample
from .wordscan import slices

BUCKETS = 1 << 22
#: Labelled rows that the models are fitted on, at most: those with the smallest hash of their id.
TRAINING_ROWS = 8_000
#: Characters of all these together, at most.
TRAINING_CHARS = 128_000_000
#: Features kept: chi-square with a category of at least ``SCREEN``, and at least 3 rows that have them.
FEATURES, SCREEN, LEAST_ROWS = 1_024, 30.0, 3
FOLDS = 3


class Chain(NamedTuple):
    categories: tuple[str, ...]
    buckets: np.ndarray  # of the kept features, ascending
    weights: list[np.ndarray]  # by category: features, earlier categories, bias

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """One column for each category; ``present`` has a row per text and a column per feature."""
        out = np.zeros((len(present), len(self.categories)))
        for c, w in enumerate(self.weights):
            out[:, c] = sigmoid(present @ w[:present.shape[1]] + out[:, :c] @ w[present.shape[1]:-1] + w[-1])
        return out


def _features(categories: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, of = marks(*word_features(batch.column("text"), BUCKETS), BUCKETS)
                bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("fold"), *(batch.column(c) for c in categories), lists],
                                                 names=["fold", *categories, "features"])
    return run


def _tallies(categories: Sequence[str]):
    """Rows that have a feature, in all and by category, summed within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((BUCKETS, 1 + len(categories)), np.int32)
        for batch in batches:
            lists = batch.column("features")
            ids, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            kinds = [np.ones(len(ids), bool)] + [
                np.repeat(batch.column(name).to_numpy(zero_copy_only=False).astype(bool), sizes) for name in categories]
            for c, marked in enumerate(kinds):
                bucket, n = np.unique(ids[marked], return_counts=True)
                table[bucket, c] += n.astype(np.int32)
        seen = np.flatnonzero(table[:, 0])
        for low in range(0, len(seen), 50_000):
            part = seen[low:low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), *(pa.array(table[part, c], pa.int64()) for c in range(table.shape[1]))],
                names=["bucket", "n", *categories])
    return run


def _present(ids: np.ndarray, of: np.ndarray, rows: int, kept: np.ndarray) -> np.ndarray:
    """Which of the ``kept`` buckets occur in each text."""
    out = np.zeros((rows, len(kept)), np.float32)
    if len(kept):
        at = np.minimum(np.searchsorted(kept, ids), len(kept) - 1)
        hit = kept[at] == ids
        out[of[hit], at[hit]] = 1.0
    return out


def _screened(made: DataFrame, categories: Sequence[str]) -> tuple[DataFrame, int]:
    """``(bucket, chi)`` of the features that at least ``LEAST_ROWS`` rows have, and the number of rows; ``chi`` is the largest chi-square
    with a category that has the feature more often than the other rows."""
    facts = made.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("int")).alias(c) for c in categories)).first()
    total = facts["n"]
    tallies = (made.mapInArrow(_tallies(categories), "bucket int, n bigint, " + ", ".join(f"{c} bigint" for c in categories))
               .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *categories))).filter(F.col("n") >= LEAST_ROWS))
    squares = []
    for c in categories if total else ():
        k = facts[c]
        gap = F.col(c) * float(total) - F.col("n") * float(k)
        spread = F.col("n") * (float(total) - F.col("n")) * float(k) * float(total - k)
        squares.append(F.when((spread > 0) & (gap > 0), gap * gap * float(total) / spread).otherwise(0.0))
    return tallies.select("bucket", F.greatest(*squares, F.lit(0.0), F.lit(0.0)).alias("chi")), total


def _strongest(made: DataFrame, categories: Sequence[str], most: int) -> list[int]:
    """The buckets of the ``most`` strongest features past the screen."""
    tallies, total = _screened(made, categories)
    if not total:
        return []
    return [r["bucket"] for r in tallies.filter(F.col("chi") >= SCREEN).orderBy(F.desc("chi"), "bucket").limit(most).collect()]


def fit(rows: DataFrame, categories: Sequence[str], key: str = "doc_id", narrower: int = 0) -> Chain:
    """A chain from ``rows`` (``key``, text and a 0/1 column for each category), in the given order.

    Rows with a null category are not used. Without any row every probability is 1/2 or less.

    With ``narrower``, so many categories go before: ``kind_1`` are the rows of the last category that have the
    feature that tells it best, ``kind_2`` those of the rest that have the feature that tells the rest best, and so
    on. They are learned like any other, and their probabilities are features of what follows.
    """
    categories = tuple(categories)
    sample = (rows.select(F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                          *(F.col(c).cast("boolean").alias(c) for c in categories)).dropna(subset=list(categories))
              .withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")))
    flags = ", ".join(f"{c} boolean" for c in categories)
    made = stored = saved(sample.mapInArrow(_features(categories), f"fold int, {flags}, features array<int>"), "features")
    left, last = made, categories[-1]
    kinds: dict[str, Column] = {}
    rest = F.col(last)
    for i in range(1, narrower + 1):
        best = _strongest(left, [last], 1)
        tells = F.array_contains("features", F.lit(best[0])) if best else F.lit(False)
        kinds[f"kind_{i}"] = rest & tells
        rest = rest & ~tells
        left = left.filter(~(F.col(last) & tells))
    made = made.withColumns(kinds) if kinds else made
    categories = (*kinds, *categories)
    total = made.count()
    if not total:
        drop_saved(stored)
        return Chain(categories, np.zeros(0, np.int64), [np.full(c + 1, -1.0) for c in range(len(categories))])
    kept = np.array(sorted(_strongest(made, categories, FEATURES)), np.int64)
    # the training rows as their kept features: a bounded number of short lists
    short = made.select("fold", *categories, F.array_intersect("features", F.lit(kept.tolist()).cast("array<int>")).alias("f"))
    got = short.toArrow()
    lists = got.column("f").combine_chunks()
    of = np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    x = _present(lists.flatten().to_numpy().astype(np.int64), of, len(got), kept)
    fold = got.column("fold").to_numpy()
    weights: list[np.ndarray] = []
    earlier = np.zeros((len(x), 0), np.float32)
    for c in categories:
        y = got.column(c).to_numpy().astype(np.float64)
        inputs = np.concatenate((x, earlier), axis=1)
        apart = np.zeros(len(x))
        for f in range(FOLDS):
            w = fit_logistic(inputs[fold != f], y[fold != f]) if (fold != f).any() else np.zeros(inputs.shape[1] + 1)
            apart[fold == f] = sigmoid(inputs[fold == f] @ w[:-1] + w[-1])
        weights.append(fit_logistic(inputs, y))
        earlier = np.concatenate((earlier, apart[:, None].astype(np.float32)), axis=1)
    drop_saved(stored)
    return Chain(categories, kept, weights)


def _scorer(chain: Chain, keep: Sequence[str] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = np.zeros(BUCKETS, bool)
        flag[chain.buckets] = True
        flag |= flag[frequent_bucket(np.arange(BUCKETS), BUCKETS)]
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, of, n_words = word_features(batch.column("text"), BUCKETS)
                hit = flag[ids]
                ids, of = marks(ids[hit], of[hit], n_words, BUCKETS)
                present = _present(ids, of, batch.num_rows, chain.buckets)
                p = chain.probabilities(present)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(present.sum(1).astype(np.int32)), *(pa.array(p[:, c]) for c in range(p.shape[1]))],
                    names=[*keep, "evidence", *chain.categories])
    return run


def score(docs: DataFrame, chain: Chain, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, evidence (features found) and the probability of each category.

    Null and empty texts have no features and get the probabilities of such a text. Repeated rows are scored
    each, rows without a doc_id too; an empty table gives no rows. Other columns are ignored.

    With ``keep``, the rows have these columns of ``docs`` (text among them) in place of doc_id, as they
    are; none may be called like a category or evidence.
    """
    docs = docs.select(*keep) if keep else docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = list(keep) or ["doc_id"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(_scorer(chain, names), f"{kinds}, evidence int, " + ", ".join(f"{c} double" for c in chain.categories))


#: Categories narrower than ``toxic``, derived from the labelled rows.
NARROWER = 2
#: Probability of the last category from which a document is rejected.
REJECT = 0.5


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, chars: int = TRAINING_CHARS) -> DataFrame:
    """Rows for ``fit`` from ``labels`` (doc_id, toxic): one row for each of at most ``rows`` documents of at most ``chars``
    characters in all, chosen by the hash of their id; a document with several labels is toxic if one says so."""
    marked = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg((F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(saved(marked, "labels")), "doc_id")  # bounded by ``rows``
    return training_sample(texts, rows, chars)


def toxic_documents(docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``score`` of ``docs`` (with ``keep``, if given) by a chain fitted on ``labels`` (texts from ``texts``, or ``docs``), and ``rejected``.

    A document without any feature of the chain shows no sign of toxicity and is never rejected,
    however frequent toxic rows were in training.
    """
    chain = fit(training_rows(docs if texts is None else texts, labels), ("toxic",), narrower=NARROWER)
    return score(docs, chain, keep).withColumn("rejected", (F.col("evidence") > 0) & (F.col("toxic") >= REJECT))
