"""Vectors against a table of intents: a blocked product, and a running best.

The vectors are dealt to lanes of a bounded size, and every intent goes once to each lane. A lane holds
its vectors, and its intents stream past them in the order of their ranks: it multiplies block by block and
keeps each vector's best. Neither side is collected, broadcast or put into a closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

#: Vectors, and intents, of one block.
BLOCK = 1_024
#: Vectors of one lane, about.
LANE = 16 * BLOCK


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten()
    if flat.null_count or len(set(vectors.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors are of one length and hold no NULL")
    rows = flat.to_numpy().reshape(len(vectors), -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


class _Block:
    """Some vectors of a lane, each with the best of the intents so far."""

    def __init__(self, keys: pa.Array, unit: np.ndarray):
        self.keys, self.unit, n = keys, unit, len(keys)
        self.score, self.rank, self.intent = np.full(n, -np.inf), np.zeros(n, np.int64), np.empty(n, object)

    def meet(self, names: np.ndarray, ranks: np.ndarray, unit: np.ndarray) -> None:
        if self.unit.shape[1] != unit.shape[1]:
            raise ValueError("vectors and intents are of one length")
        scores = self.unit @ unit.T
        at = scores.argmax(axis=1)
        top = scores[np.arange(len(at)), at]
        # intents come in order: of equal scores the first listed stays
        better = (top > self.score) | (np.isnan(top) & ~np.isnan(self.score))
        self.score[better], self.rank[better], self.intent[better] = top[better], ranks[at[better]], names[at[better]]


def _multiply(name_type: pa.DataType):
    """Rows of lanes, a lane's vectors before its intents, to the best intent of each vector."""
    def best(held: list[_Block]) -> Iterator[pa.RecordBatch]:
        for b in held:
            yield pa.RecordBatch.from_arrays([b.keys, pa.array(b.score), pa.array(b.rank), pa.array(b.intent.tolist(), name_type)],
                                             names=["key", "score", "rank", "intent"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, met = None, [], False
        for whole in batches:
            places = whole.column("lane").to_numpy() * 2 + np.asarray(whole.column("named"))
            edges = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), whole.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                here, named = divmod(int(places[low]), 2)
                if here != lane:
                    if met:
                        yield from best(held)
                    lane, held, met = here, [], False
                for start in range(low, high, BLOCK):
                    piece = whole.slice(start, min(BLOCK, high - start))
                    unit = _unit(piece.column("vector"))
                    if not named:
                        held.append(_Block(pa.concat_arrays([piece.column("key")]), unit))  # a copy, not the whole batch
                        continue
                    met = True
                    names = np.empty(piece.num_rows, object)
                    names[:] = piece.column("intent").to_pylist()
                    for b in held:
                        b.meet(names, piece.column("rank").to_numpy(), unit)
        if met:
            yield from best(held)
    return multiply


def top_intents(vectors: DataFrame, intents: DataFrame, key: str, vector: str = "embedding", intent: str = "intent",
                lanes: int | None = None) -> DataFrame:
    """``(key, intent, score)``: the intent of the largest cosine for each row of ``vectors``.

    ``intents`` has ``intent``, ``embedding`` and maybe ``rank``; of equal vectors the one with the smallest
    rank (then intent) counts, of equal scores likewise. A zero vector is like nothing: its score is 0.
    A NULL vector, and every vector without intents, has a NULL intent and score. Rows that repeat
    a key are one: that with the best score. Intents with a NULL vector are ignored.

    There are as many ``lanes`` as cores, or more if there are more than ``LANE`` vectors for each. The products are
    as many as vectors times intents; a task holds one lane's vectors and sorts the intents in bounded memory.
    """
    spark = vectors.sparkSession
    kind, name_kind = (df.schema[c].dataType.simpleString() for df, c in ((vectors, key), (intents, intent)))
    rank = F.col("rank").cast("bigint") if "rank" in intents.columns else F.lit(0).cast("bigint")
    once = (intents.select(rank.alias("rank"), F.col(intent).alias("intent"), F.col("embedding").cast("array<double>").alias("vector"))
            .filter("vector is not null").groupBy("vector").agg(F.min(F.struct("rank", "intent")).alias("i")))
    listed = materialize(once.select("i.rank", "i.intent", "vector"), "intents")
    given = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    stored = materialize(given.filter("vector is not null"), "vectors")
    lanes = lanes or max(spark.sparkContext.defaultParallelism, -(-stored.count() // LANE))
    left = stored.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int").alias("lane"), F.lit(False).alias("named"),
                         "key", F.lit(None).cast(name_kind).alias("intent"), F.lit(None).cast("bigint").alias("rank"), "vector")
    right = listed.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(True).alias("named"),
                          F.lit(None).cast(kind).alias("key"), "intent", "rank", "vector")
    dealt = left.unionByName(right).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "named", "rank", "intent")
    best = dealt.mapInArrow(_multiply(to_arrow_type(intents.schema[intent].dataType)),
                            f"key {kind}, score double, rank bigint, intent {name_kind}")
    # the largest score; of equal ones the smallest rank, then intent
    order = F.struct((-F.col("score")).alias("s"), "rank", "intent")
    top = best.groupBy("key").agg(F.min(order).alias("b")).select("key", "b.intent", (-F.col("b.s")).alias("score"))
    return given.select("key").distinct().join(top, "key", "left").select(F.col("key").alias(key), F.col("intent").alias("intent"), "score")
