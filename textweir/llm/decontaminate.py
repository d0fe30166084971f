"""Benchmark decontamination by winnowing.

A span of 13 words holds seven 7-word grams. Both sides keep, of every such run of grams, the
last one with the smallest hash. Equal spans choose the same gram, so each shared span of 13
words or more is met in the join of the fingerprints. The join compares the words of the
extended span as well, so it returns exact occurrences and no product of common grams.

Items of fewer than 13 words are one window; its fingerprint is the gram of all its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_saved, saved
from .wordscan import ALNUM, Words, slices

SPAN = 13
GRAM = 7
#: Bits of the filter of benchmark fingerprints: 2 to 16 MB whatever the size of the benchmark.
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 27


def _winnowed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start of every full span, and the hash of the gram that its winnowing keeps."""
    at, _ = words.places(GRAM)
    grams = np.zeros(len(words.hash), np.uint64)
    grams[at] = words.window_hash(at, GRAM)
    start, _ = words.places(SPAN)
    best = grams[start + (SPAN - GRAM)]
    for back in range(SPAN - GRAM - 1, -1, -1):
        np.minimum(best, grams[start + back], out=best)
    return start, best


def _span_texts(words: Words, at: np.ndarray, size: int) -> list[str]:
    """The words of each window, with one blank between them."""
    raw = words.raw.tobytes()
    return [b" ".join(raw[words.start[i]:words.end[i]] for i in range(p, p + size)).decode("utf-8", "replace")
            for p in at.tolist()]


_HIT = pa.struct([("print", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("span", pa.string())])


def _hits(words: Words, sizes: list[int], keep: Callable[[np.ndarray], np.ndarray]) -> pa.ListArray:
    """For each text the windows whose fingerprint passes ``keep``."""
    found: list[tuple[np.ndarray, np.ndarray, int, list[str]]] = []
    for size in sizes:
        if size == SPAN:
            at, prints = _winnowed(words)
        else:
            at, _ = words.places(size)
            prints = words.window_hash(at, size)
        chosen = keep(prints)
        at, prints = at[chosen], prints[chosen]
        found.append((at, prints, size, _span_texts(words, at, size)))
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    text = np.searchsorted(words.first, at, side="right") - 1
    spans = [s for f in found for s in f[3]]
    hits = pa.StructArray.from_arrays([
        pa.array(np.concatenate([f[1] for f in found])[order].view(np.int64) if found else [], pa.int64()),
        pa.array(at - words.first[text], pa.int32()),
        pa.array(np.concatenate([np.full(len(f[0]), f[2]) for f in found])[order] if found else [], pa.int32()),
        pa.array([spans[i] for i in order.tolist()], pa.string()),
    ], fields=list(_HIT))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), hits)


def _scan(sizes: list[int], bits: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word count and hits of each text; ``bits`` is the filter of fingerprints (none: keep all)."""
    def keep(prints: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.ones(len(prints), bool)
        place = prints & np.uint64(len(bits) * 64 - 1)
        return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(batch.column("text"), ALNUM)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), _hits(words, sizes, keep)],
                    names=["doc_id", "n_words", "hits"])
    return scan


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item: spans of 13 words, or the whole of a shorter item."""
    every = lambda prints: np.ones(len(prints), bool)
    for whole in batches:
        for batch in slices(whole, "text"):
            counts = np.diff(Words(batch.column("text"), ALNUM).first)
            for size in np.unique(np.minimum(counts, SPAN)).tolist():
                if size:
                    part = batch.filter(pa.array(np.minimum(counts, SPAN) == size))
                    words = Words(part.column("text"), ALNUM)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(np.diff(words.first), pa.int64()), _hits(words, [size], every)],
                        names=["id", "n_words", "hits"])


_SCHEMA = "{} bigint, n_words bigint, hits array<struct<print bigint, at int, size int, span string>>"


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """One bit for each fingerprint, as words of 64; at most ``MOST_BITS`` bits reach the driver."""
    n = prints.count()
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 256 * n:
        bits *= 2
    place = F.col("print").bitwiseAND(F.lit(bits - 1))
    rows = (prints.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items (sorted
    strings), contaminated.

    Words are runs of digits, letters and non-ASCII characters, A-Z folded. A word inside any
    occurrence of a window of ``benchmark`` (item_id, text) is hit; a document is contaminated
    with a hit share of 5 % or more. Null texts have no words, an empty benchmark hits nothing,
    items without id or words are ignored, equal items count by their ids. Rows that repeat a
    doc_id, or have none, are judged each on its own. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = (benchmark.filter("item_id is not null")
             .select(F.col("item_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")))
    of_item = saved(items.mapInArrow(_items, _SCHEMA.format("id")).select("id", F.explode("hits").alias("h"))
                    .select(F.col("id").alias("item_id"), "h.print", "h.size", "h.span").distinct(), "items")
    windows = saved(of_item.select("print", "size", "span").distinct()
                    .withColumn("win", F.monotonically_increasing_id()), "windows")
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # 13 values at most
    bits = _filter_bits(windows.select("print").distinct())
    scanned = saved(docs.mapInArrow(_scan(sizes, bits), _SCHEMA.format("doc_id"))
                    .withColumn("id", F.monotonically_increasing_id()), "scan")
    hits = scanned.select("id", F.explode("hits").alias("h")).select("id", "h.*")
    found = saved(hits.join(windows, ["print", "size", "span"]).select("id", "at", "size", "win"), "found")
    # words in the union of the spans: each span adds what no earlier one has reached
    before = Window.partitionBy("id").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("at") + F.col("size")).over(before), F.lit(0))
    covered = (found.withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", reached)))
               .groupBy("id").agg(F.sum("new").alias("n_hit")))
    names = of_item.join(windows, ["print", "size", "span"]).select("win", "item_id")
    listed = (found.select("id", "win").distinct().join(saved(names, "names"), "win").select("id", "item_id").distinct()
              .groupBy("id").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    drop_saved(of_item)
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return (scanned.select("id", "doc_id", "n_words").join(covered, "id", "left").join(listed, "id", "left")
            .select("doc_id", "n_words", hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated")))
