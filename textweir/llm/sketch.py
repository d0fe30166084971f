"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct hashes of a text's five-word
shingles (words by white space, A-Z folded; a shorter text is one shingle, a text without
words has an empty sketch). Sketches of parts merge to that of their union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold_case, saved

SHINGLE = 5
SIZE = 128
_RANGE = float(1 << 64)


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(v)`` with ``value`` computed once."""
    return F.transform(F.array(value), make)[0]


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word."""
    words = F.filter(F.split(fold_case(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash for each run of five words, with repeats."""
    def runs(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                           lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        whole = F.array(F.aggregate(h, F.lit(SHINGLE).cast("bigint"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= SHINGLE, each).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(word_hashes(text), runs)


def sketch(text: Column, size: int = SIZE) -> Column:
    """The bottom-k sketch of a text; null text counts as empty."""
    hashes = shingle_hashes(F.coalesce(text, F.lit("")))
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_all(sketches: Column, size: int = SIZE) -> Column:
    """The sketch of all sketches of an array."""
    return F.aggregate(sketches, F.array().cast("array<bigint>"), lambda a, b: merge(a, b, size))


def distinct_estimate(a: Column, size: int = SIZE) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the share of the range up to the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(_RANGE / 2)) / F.lit(_RANGE)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of the union's sketch that both have (Jaccard); two empty sketches are alike."""
    return _let(merge(a, b, size), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of ``a``'s shingles that ``b`` has, from the resemblance and the counts of ``a`` and the union."""
    both = resemblance(a, b, size) * distinct_estimate(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_estimate(a, size)))


def neighbours(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order; the first follows the last.

    Ids are range partitioned and stored; the successor comes from the own partition, or is
    the first id of the next one that has any (one row per partition).
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(ids.select("doc_id").distinct().repartitionByRange(parts, "doc_id")
                   .withColumn("part", F.spark_partition_id()), "ids")
    firsts = placed.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = F.lead("first").over(Window.orderBy("part"))
    firsts = firsts.withColumn("after", F.coalesce(after, F.min("first").over(Window.partitionBy())))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return (placed.withColumn("inside", inside).join(F.broadcast(firsts.select("part", "after")), "part")
            .select("doc_id", F.coalesce("inside", "after").alias("next_id")))


def fingerprint_pairs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited, sketch, edited_sketch, next_sketch.

    ``edited`` is the text with its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's. Null counts as empty. Of rows that repeat a
    doc_id each is fingerprinted, and the smallest text counts as the "next" one; a row
    without a doc_id is followed by nothing. Other columns are ignored.
    """
    ids = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    docs = docs.select(ids, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    sizes = saved(known.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n")), "sizes")
    follows = saved(neighbours(sizes).join(sizes, "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("of"), F.floor(F.col("n") / 2).cast("int").alias("need")), "follows")
    # both joins read the texts dealt by doc_id, so Spark shuffles them once
    given = (known.hint("shuffle_merge").join(follows, "doc_id")
             .select("of", F.struct(F.substr("text", F.lit(1), "need").alias("head"), sketch(F.col("text"), size).alias("sketch")).alias("next")))
    given = given.groupBy("of").agg(F.min("next").alias("next")).withColumnRenamed("of", "doc_id")
    pairs = known.hint("shuffle_merge").join(given, "doc_id", "left")
    pairs = pairs.unionByName(nameless, allowMissingColumns=True)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.char_length("text") - half),
                      F.coalesce(F.substr(F.col("next.head"), F.lit(1), half), F.lit("")))
    return (pairs.select("doc_id", "text", edited.alias("edited"),
                         F.coalesce("next.sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
            .select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "edited",
                    sketch(F.col("text"), size).alias("sketch"), sketch(F.col("edited"), size).alias("edited_sketch"), "next_sketch"))
