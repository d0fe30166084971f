"""MinHash near-duplicates: universal hash minima, banding, signature and exact confirmation, star contraction.

How no group lands in one task and none is left out:

* Documents of equal shingle sets are one class (a partial aggregation), so copies are never paired.
* Classes that share a band are linked to the smallest one of the bucket first. That joins most
  groups by as many pairs as they have members.
* Buckets that still hold classes of different components are then compared member
  against member, in blocks of at most ``BLOCK`` classes a task; a bucket of more is split
  into pairs of blocks. Each task returns a spanning forest of its links, not its pairs.
* A pair is dropped if its signatures agree in fewer minima than a linked pair's would (but for one in a
  million), and is compared in the first band that it shares only. What is left is confirmed on whole sets.
* Components come from alternating large-star and small-star over checkpointed edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .shared import drop_saved, saved, small
from .wordscan import NON_SPACE, Words, combine, slices

SHINGLE = 5
PERCENT = 85
#: 36 bands of 7 minima: a pair at 0.85 shares none with probability 9e-7, one at 0.80 with 2e-4, and pairs above with less.
BANDS, ROWS = 36, 7
#: Probability with which signatures may drop a pair that just links.
LOSS = 1e-6
#: Classes compared in one task of an unresolved bucket; larger buckets are split into block pairs.
BLOCK = 256


def _sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at, bounds = words.places(SHINGLE)
    grams = words.window_hash(at, SHINGLE)
    for i in range(len(words.first) - 1):
        first, last = words.first[i], words.first[i + 1]
        got = grams[bounds[i]:bounds[i + 1]]
        if last > first and len(got) == 0:
            got = words.window_hash(np.array([first]), int(last - first))
        got = np.sort(got)
        yield got[np.concatenate(([True], got[1:] != got[:-1]))] if len(got) else got


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of ``count`` universal (multiply-add) hash functions on 32 bits."""
    rng = np.random.default_rng(20_240_229)
    return (rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32))


def _minima(sets: list[np.ndarray], factor: np.ndarray, term: np.ndarray) -> np.ndarray:
    """One row of minima for each (non-empty) set; sets are taken together in runs that fit the cache."""
    out = np.empty((len(sets), len(factor)), np.uint32)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 32_768):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        x = (x >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j]])[:-1]))
        buf = np.empty_like(x)
        for k in range(len(factor)):
            np.multiply(x, factor[k], out=buf)
            np.add(buf, term[k], out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, starts)
        i = j
    return out


def _band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, different for equal minima of other bands."""
    grouped = minima.astype(np.uint64).reshape(len(minima) * bands, ROWS)
    band = np.tile(np.arange(bands, dtype=np.uint64), len(minima))
    flat = np.concatenate((band[:, None], grouped), axis=1).reshape(-1)
    at = np.arange(len(minima) * bands) * (ROWS + 1)
    return combine(flat, at, ROWS + 1).reshape(len(minima), bands)


def _list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _describe(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    factor, term = _hash_family(bands * ROWS)
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = list(_sets(Words(batch.column("text"), NON_SPACE)))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = _band_keys(_minima([sets[i] for i in full], factor, term), bands) if full else np.zeros((0, bands), np.uint64)
            counts = np.zeros(len(sets), np.int64)
            counts[full] = bands
            digest = [_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                _list_array(keys.reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(counts))), pa.int64()),
            ], names=["doc_id", "n_shingles", "digest", "bands"])


def _digest(grams: bytes) -> bytes | None:
    return hashlib.blake2b(grams, digest_size=16).digest() if grams else None


def least_agreement(percent: int, minima: int, loss: float = LOSS) -> int:
    """The largest number of equal minima that a pair at ``percent`` falls short of with at most ``loss``."""
    p, total, k = percent / 100, 0.0, 0
    while k < minima:
        total += math.comb(minima, k) * p ** k * (1 - p) ** (minima - k)
        if total > loss:
            break
        k += 1
    return k


def _whole_sets(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose digest is the chosen one, and their signatures."""
    factor, term = _hash_family(bands * ROWS)
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = list(_sets(Words(batch.column("text"), NON_SPACE)))
            same = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist())) if len(s) and _digest(s.tobytes()) == d]
            if same:
                kept = [sets[i] for i in same]
                minima = _minima(kept, factor, term)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(same)), pa.array([s.tobytes() for s in kept], pa.binary()),
                     pa.array([m.tobytes() for m in minima], pa.binary())], names=["node", "set", "sig"])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1) if len(sigs) else np.zeros((0, 0), np.uint32)


def _confirmed(a: pd.Series, b: pd.Series, sig_a: pd.Series, sig_b: pd.Series, percent: int) -> pd.Series:
    left, right = _signatures(sig_a), _signatures(sig_b)
    out = (left == right).sum(axis=1) >= least_agreement(percent, left.shape[1])
    for i in np.flatnonzero(out).tolist():
        out[i] = _alike(np.frombuffer(a.iloc[i], np.uint64), np.frombuffer(b.iloc[i], np.uint64), percent)
    return pd.Series(out, dtype=bool)


def _candidates(part: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that this block (pair) is to compare: those of its two sides, whose first common
    band is this bucket's, and whose signatures agree often enough."""
    sig = _signatures(part["sig"])
    comps, side, slot = part["comp"].to_numpy(), part["mine"].to_numpy(), int(part["slot"].iloc[0])
    across = int(part["i"].iloc[0]) != int(part["j"].iloc[0])
    least = least_agreement(percent, sig.shape[1])
    left, right = [], []
    for k in range(len(sig) - 1):
        mine = np.flatnonzero((comps[k + 1:] != comps[k]) & ((side[k + 1:] != side[k]) if across else True)) + k + 1
        equal = sig[mine] == sig[k]
        mine, equal = mine[often := equal.sum(axis=1) >= least], equal[often]
        first = equal.reshape(len(mine), sig.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) if len(mine) else mine
        mine = mine[first == slot]
        left.append(np.full(len(mine), k))
        right.append(mine)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _forest(part: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between different components among the members of one block (pair), as a spanning forest."""
    left, right = _candidates(part, percent)
    if not len(left):
        return []
    members = np.unique(np.concatenate((left, right)))
    left, right = np.searchsorted(members, left), np.searchsorted(members, right)
    part = part.iloc[members]
    nodes, comps = part["node"].to_numpy(), part["comp"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in part["set"]]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(grams))[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0]
    both = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, (2 << 20) // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (low, low + width))
        cells = np.zeros((n, width), np.float32)
        cells[row[i:j], column[i:j] - low] = 1
        both += cells @ cells.T
    common = both[left, right]
    linked = 100 * common >= percent * (sizes[left] + sizes[right] - common)
    root = {c: c for c in comps.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(left[linked].tolist(), right[linked].tolist()):
        a, b = find(int(comps[i])), find(int(comps[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compare(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    return pd.DataFrame(_forest(part, percent), columns=["a", "b"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the undirected ``edges`` (a, b) reaches.

    Alternates large-star and small-star until the edges no longer change. Every round is
    written to the shared folder, and the tables before it are removed. The minima are written
    as well: a join of two plain tables is one that Spark can split at the node of many edges.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .filter("u != v").distinct(), "large")
        drop_saved(least)
        drop_saved(edges)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = saved(pairs.select("e.*").filter("u != v").distinct(), "edges")
        drop_saved(least)
        drop_saved(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are what ASCII white space separates, A-Z folded; a set holds the distinct
    five-word shingles, or the whole sequence of a shorter text. Documents link at
    100 * intersection >= ``percent`` * union if they share one of ``bands`` bands of minima and their signatures agree
    (of the pairs that just link, one in a million does not);
    ``component_id`` is the smallest reachable doc_id.

    Null or empty texts, and texts of white space, have no shingles and form components of
    their own. Rows that repeat a doc_id are one document, linked by the set with the smallest
    digest if their texts differ, and share the verdict. A row without a doc_id has a null
    component and is kept. Other columns of ``docs`` are ignored.
    """
    # closures only: the module imports without a session
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _describe(batches, bands)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return _compare(part, percent)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _whole_sets(batches, bands)

    @F.pandas_udf(BooleanType())
    def confirmed(a: pd.Series, b: pd.Series, sig_a: pd.Series, sig_b: pd.Series) -> pd.Series:
        return _confirmed(a, b, sig_a, sig_b, percent)

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = saved(docs.mapInArrow(describe, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"),
                 "sets")
    known = seen.filter("digest is not null and doc_id is not null")
    # one class for each distinct set, called by its smallest document
    chosen = known.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = saved(chosen.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    members = chosen.join(classes, "digest").select("doc_id", "node")
    banded = (known.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"], "left_semi")
              .select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("slot", "band")))
    buckets = saved(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last"),
                                               F.count("*").alias("n")).filter("hub != last").drop("last"), "buckets")
    shared = saved(banded.join(buckets, "band"), "shared")
    involved = shared.select("node").distinct().join(classes, "node").withColumnRenamed("node", "doc_id")
    sets = saved(docs.join(small(involved), "doc_id").mapInArrow(whole_sets, "node bigint, set binary, sig binary")
                 .dropDuplicates(["node"]), "whole")
    # links to the smallest class of each bucket
    hubs = shared.filter("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = saved(hubs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left"), F.col("sig").alias("sig_a")), "a")
                  .join(sets.select(F.col("node").alias("b"), F.col("set").alias("right"), F.col("sig").alias("sig_b")), "b")
                  .filter(confirmed("left", "right", "sig_a", "sig_b")).select("a", "b"), "links")
    comps = components(links)
    # buckets of several components, compared member against member
    placed = saved(shared.join(comps, "node", "left")
                   .select("band", "slot", "n", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    open_ = saved(placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                  .filter("low != high").select("band"), "open")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks.cast("bigint")).cast("int")
    paired = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
            F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j"))))
    dealt = (placed.join(open_, "band", "left_semi").join(sets, "node")
             .withColumn("blocks", blocks).withColumn("mine", mine)
             .withColumn("pair", F.explode(paired)).select("band", "slot", "pair.i", "pair.j", "mine", "node", "comp", "set", "sig"))
    more = dealt.groupBy("band", "i", "j").applyInPandas(compare, "a bigint, b bigint")
    comps = components(links.union(more))
    for table in (links, open_, placed, sets, shared, buckets):
        drop_saved(table)
    found = members.join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("component_id"))
    return (seen.select("doc_id", "n_shingles").join(found, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))))
