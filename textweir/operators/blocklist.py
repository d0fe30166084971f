"""Keyword blocking with term lists too long for one alternation.

Whole words are joined as word n-grams; beyond the broadcast limit a Bloom filter of the terms, built by an aggregation,
stands before the shuffle. Substrings of up to q characters stand as they are in a trie that the texts are walked through,
longer ones with one rare q-gram of each: a text that holds the term holds its q-gram, so only such pairs are looked at.
A text's hits are made in one place, in their order, and are not shuffled.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize

# Maximal runs of word characters and the runs between them, in turn.
_WORDS = r"[\p{L}\p{N}_]+"
_RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Characters of the q-grams that substrings are looked up by; shorter terms stand for themselves, so they need no second look.
_Q = 8
#: Terms of one lane, which a task holds in memory; a longer one counts once more for every _Q characters.
_LANE = 4_000_000
#: Texts of one result batch, and bytes of them unless one text is longer; characters that are walked at a time.
_TEXTS, _CHARS = 256, 1 << 14
#: What stands after a text: no code point.
_END = 0x1FFFFF
#: Bits of a Bloom filter, of which 64 are one broadcast row: 8 KB to 16 MB whatever the list.
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 27
#: Terms beyond which the largest filter lets two in five of all other n-grams through and costs more than it saves.
_FILTERED = _MOST_BITS // 2


def bloom_filter(df: DataFrame, key: str) -> DataFrame:
    """``(word, bits)`` of a Bloom filter with one hash over the values of ``key``; at most 2 million rows."""
    n, size = df.count(), _LEAST_BITS
    while size < 16 * n and size < _MOST_BITS:
        size *= 2
    bit = F.pmod(F.xxhash64(key), F.lit(size))
    return (df.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) AS INT))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("size", F.lit(size)))


def may_hold(df: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of the filter's; all of those that are."""
    sizes = [r["size"] for r in bloom.select("size").limit(1).collect()]
    if not sizes:
        return df.limit(0)
    word = F.shiftright(F.pmod(F.xxhash64(key), F.lit(sizes[0])), 6)
    set_ = F.expr(f"(shiftright(bits, cast(pmod(xxhash64(`{key}`), 64) AS INT)) & 1) = 1")
    return df.withColumn("word", word).join(F.broadcast(bloom.drop("size")), "word").filter(set_).drop("word", "bits")


def _ngrams(runs: Column, n_words: int) -> Column:
    """``(pos, span)`` of every ``n_words`` words with the text between them.

    ``pos`` is the index among the runs; words stand at every second run.
    """
    width = 2 * n_words - 1
    first = F.when(F.get(runs, 0).rlike(r"^[\p{L}\p{N}_]"), 1).otherwise(2)
    last = F.size(runs) - (width - 1)
    starts = F.coalesce(F.when(last >= first, F.sequence(first, last, F.lit(2))), F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(runs, i, width), "").alias("span")))


def blocklist_hits(df: DataFrame, key_col: str, terms: DataFrame, text_col: str = "text",
                   term_col: str = "term", broadcast_rows: int = BROADCAST_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Texts that hold a listed term as whole words: ``(key, label, n_hits)``.

    With ``by``, a term holds only for the texts that have the same values in these columns.

    Terms must begin and end with a word character. The texts' word n-grams are
    joined with the terms, case-insensitively; where hits overlap the leftmost
    wins and, at one start, the term listed first (``terms.rank`` if present).
    ``key_col`` identifies a text. The distinct terms are stored once. Only hits are shuffled; if the terms
    are more than ``broadcast_rows``, also each term, once, and the n-grams that pass a Bloom filter of the
    terms by chance (all n-grams beyond ``_FILTERED`` terms). The terms are unique in that
    join, so a task merges its n-grams with one term at a time, and Spark splits the partition of a frequent n-gram.
    """
    rank = F.col("rank") if "rank" in terms.columns else F.lit(0)
    n_words = F.regexp_count("__term", F.lit(_WORDS))
    listed = materialize(terms.select(*by, F.lower(term_col).alias("__term"), rank.alias("__rank"))
                         .filter("__term is not null").groupBy(*by, "__term").agg(F.min("__rank").alias("__rank"))
                         .withColumn("__n_words", n_words), "terms")
    # by word count: a handful of numbers
    counts = {r[0]: r[1] for r in listed.groupBy("__n_words").count().collect()}
    listed, n_listed = listed.drop("__n_words"), sum(counts.values())
    lengths = sorted(n for n in counts if n) or [1]

    if lengths == [1]:
        words = F.regexp_extract_all(F.col(text_col), F.lit(_WORDS), F.lit(0))
        grams = df.select(F.col(key_col).alias("__key"), *by, F.posexplode(words).alias("pos", "span"))
    else:
        runs = df.select(F.col(key_col).alias("__key"), *by,
                         F.regexp_extract_all(F.col(text_col), F.lit(_RUNS), F.lit(0)).alias("__runs"))
        grams = runs.select("__key", *by, F.inline(F.flatten(F.array(*[_ngrams(F.col("__runs"), n) for n in lengths]))))
    grams = grams.withColumn("__term", F.lower("span"))
    if n_listed <= broadcast_rows:
        hits = grams.join(F.broadcast(listed), [*by, "__term"])
    else:
        if n_listed <= _FILTERED:
            grams = may_hold(grams, "__term", materialize(bloom_filter(listed, "__term"), "bloom"))
        hits = grams.join(listed, [*by, "__term"])

    n_span = F.size(F.regexp_extract_all(F.col("span"), F.lit(_WORDS), F.lit(0)))
    hits = hits.select("__key", F.struct(
        "pos", "__rank", (F.col("pos") + n_span * 2 - 1).alias("end"), "span").alias("hit"))
    per_text = hits.groupBy("__key").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    if lengths != [1]:  # single words cannot overlap
        empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("spans"))
        kept = F.aggregate("hits", empty, lambda acc, h: F.when(h["pos"] < acc["end"], acc).otherwise(
            F.struct(h["end"].alias("end"), F.array_append(acc["spans"], h["span"]).alias("spans"))),
            lambda acc: acc["spans"])
    else:
        kept = F.transform("hits", lambda h: h["span"])
    return per_text.withColumn("__kept", kept).select(
        F.col("__key").alias(key_col),
        F.concat(F.lit("Topic:"), F.array_join(F.sort_array(F.array_distinct("__kept")), ",")).alias("label"),
        F.size("__kept").alias("n_hits"))


# --- substrings ----------------------------------------------------------------

def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct runs of ``sizes`` characters of a text."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*runs))


def _anchors(listed: DataFrame) -> DataFrame:
    """``(gram, term, rank)``: each term of more than q characters under that of its q-grams that the fewest of them have."""
    every = listed.select("term", "rank", F.explode(_grams(F.col("term"), [_Q])).alias("gram"))
    shared = every.groupBy("gram").agg(F.count("*").alias("n"))
    return (every.join(shared, "gram").groupBy("term", "rank").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
            .select("gram", "term", "rank"))


def _lanes(counts: dict[int, int]) -> list[tuple[list[int], int, int]]:
    """``(lengths, part, parts)`` of each lane: whole lengths as long as they fit, or one part of the terms of one length."""
    out: list[tuple[list[int], int, int]] = []
    room = 0
    for size, n in sorted(counts.items(), key=lambda c: c[1]):
        parts = -(-n // _LANE)
        if parts > 1:
            out += [([size], part, parts) for part in range(parts)]
            room = 0
        elif n <= room:
            out[-1][0].append(size)
            room -= n
        else:
            out.append(([size], 0, 1))
            room = _LANE - n
    return out


#: What ``_pack`` makes besides a lane.
_LISTS = {"grams": "array<string>", "terms": "array<string>", "ranks": "array<bigint>"}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of lane and gram to ``(lane, grams, terms, ranks)``: many of one lane in one row, no ``terms`` if all are NULL."""
    for whole in batches:
        lanes = whole.column("lane").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(lanes)) + 1).tolist(), whole.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low < high:
                piece = whole.slice(low, high - low)
                gram, term, rank = (piece.column(c) for c in ("gram", "term", "rank"))
                term = term.slice(0, 0) if term.null_count == len(term) else term
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (gram, term, rank)]
                yield pa.RecordBatch.from_arrays([piece.column("lane").slice(0, 1), *lists], names=["lane", *_LISTS])


def _trim() -> None:
    """Hands free memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def _points(texts: pa.Array) -> np.ndarray:
    """The code points of all texts, one text after the other."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    return np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.int32)


class _Level:
    """The nodes of one level of a trie by their keys, in hash buckets."""

    def __init__(self, keys: np.ndarray):
        """``keys`` are distinct, and of 4 or 8 bytes."""
        self.kind = np.uint32 if keys.itemsize == 4 else np.uint64
        bits = max(1, len(keys).bit_length() - 1)
        self._factor, self._shift = (self.kind(x) for x in (0x9E3779B97F4A7C15 >> (64 - 8 * keys.itemsize) | 1, 8 * keys.itemsize - bits))
        buckets = self._bucket(keys)
        self._first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(buckets, minlength=1 << bits), out=self._first[1:])
        self.order = np.argsort(buckets, kind="stable").astype(np.int32)  # the key of each node
        self.keys = keys[self.order]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(self.kind)
        return (((keys ^ (keys >> self.kind(15))) * self._factor) >> self._shift).astype(np.int32 if self.kind is np.uint32 else np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The node of each key, -1 if there is none."""
        buckets = self._bucket(keys)
        at, end = self._first[buckets], self._first[buckets + 1]
        found = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while left.size:
            here = at[left]
            same = self.keys[here] == keys[left]
            found[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found


def _firsts(found: Sequence[tuple[np.ndarray, np.ndarray]], placed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and if ``placed`` what stands beside the first of each."""
    keys = np.concatenate([k for k, _ in found])
    if not placed:
        keys.sort()
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        return keys[new], keys[:0]
    keys, at = np.unique(keys, return_index=True)
    return keys, np.concatenate([a for _, a in found])[at]


class _Lane:
    """The terms of a lane, their order by rank and term, and a trie of their grams, level by level."""

    def __init__(self) -> None:
        self._parts, self._numbers, self._n = [], [], 0  # terms and ranks
        # of each level, its nodes in the order of the grams: the node above and a code point; how many, and the last; nodes and rows of grams that end there
        self._keys, self._counts, self._lasts, self._ends = [], [], [], []
        self._letters = np.zeros(_END + 1, np.int32)

    def add(self, gram: pa.Array, term: pa.Array, rank: pa.Array) -> None:
        """More terms, in the order of their grams; NULL stands for a term that is its gram."""
        sizes, node, whole = pc.utf8_length(gram).to_numpy(), np.zeros(len(gram), np.int64), term.is_null().to_numpy(zero_copy_only=False)
        self._parts.append(pc.coalesce(term, gram).cast(pa.string()).take(pa.array(np.arange(len(gram)))))  # a copy, not the whole batch
        self._numbers.append(rank.to_numpy().copy())
        for n in range(int(sizes.max(initial=0))):
            if n == len(self._keys):
                for held, first in ((self._keys, []), (self._counts, 0), (self._lasts, -1), (self._ends, [])):
                    held.append(first)
            rows = np.flatnonzero(sizes > n)
            points = _points(pc.utf8_slice_codeunits(gram, n, n + 1))
            self._letters[points] = 1
            keys = node[rows] << 21 | points
            new = np.diff(keys, prepend=self._lasts[n]) != 0  # grams of one beginning stand together
            node[rows] = self._counts[n] - 1 + np.cumsum(new)
            self._keys[n].append(keys[new])
            self._counts[n], self._lasts[n] = int(node[rows[-1]]) + 1, keys[-1]
            rows = rows[sizes[rows] == n + 1]
            self._ends[n].append(np.stack([node[rows], np.where(whole[rows], self._n + rows, -1 - self._n - rows)]).astype(np.int32))
        self._n += len(gram)

    def close(self, ranked: bool = False) -> _Lane:
        """No more terms come. Only if ``ranked`` the lane keeps the ranks."""
        ranks, terms = np.concatenate([np.empty(0, np.int64), *self._numbers]), pa.chunked_array(self._parts, pa.string())
        del self._numbers, self._parts
        _trim()
        if any((ended[1] < 0).any() for level in self._ends for ended in level):
            self._order = pc.sort_indices(pa.table({"r": ranks, "t": terms}), [("r", "ascending"), ("t", "ascending")]).to_numpy().astype(np.int32)
        else:  # terms are in order, as their grams are
            self._order = np.argsort(ranks, kind="stable").astype(np.int32)
        self._ranks, place = ranks if ranked else None, np.empty(self._n, np.int32)
        place[self._order] = np.arange(self._n, dtype=np.int32)
        del ranks
        known = np.flatnonzero(self._letters)
        self._letters[known] = np.arange(1, len(known) + 1)  # 0 is no letter of a term
        self._n_letters = len(known) + 1
        # of each level, its nodes; the term that ends at each, by its place in order, or -1
        self._levels: list[tuple[_Level, np.ndarray]] = []
        # of levels where grams of longer terms end, whether one ends at each node; the nodes, and the places of the terms
        self._over: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        above = np.zeros(1, np.int32)
        for n, (fresh, ended) in enumerate(zip(self._keys, self._ends)):
            keys = np.concatenate(fresh)
            fresh.clear()
            kind = np.int32 if len(above) * self._n_letters < 1 << 31 else np.int64
            level = _Level(above[keys >> 21].astype(kind) * kind(self._n_letters) + self._letters[keys & _END].astype(kind))
            above, ends = np.empty(len(keys), np.int32), np.full(len(keys), -1, np.int32)
            del keys
            above[level.order] = np.arange(len(above), dtype=np.int32)  # the node of each key
            del level.order
            over = []
            for nodes, rows in ended:
                whole = rows >= 0
                ends[above[nodes[whole]]] = place[rows[whole]]
                over.append(np.stack([above[nodes[~whole]], place[-1 - rows[~whole]]]))
            ended.clear()
            nodes, places = np.concatenate(over, axis=1)
            if nodes.size:
                by_node, some = np.argsort(nodes, kind="stable"), np.zeros(len(ends), bool)
                some[nodes] = True
                self._over[n] = some, nodes[by_node], places[by_node]
            self._levels.append((level, ends))
            del over, nodes, places
            _trim()
        del place, above
        self.terms = terms.combine_chunks()
        del terms
        _trim()
        return self

    def _walk(self, letters: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(level, places, nodes)`` of the beginnings of grams that begin in a part of the texts."""
        at, node = np.arange(low, high), np.zeros(high - low, np.int32)
        for n, (level, _) in enumerate(self._levels):
            kind = level.keys.dtype.type
            node = level.find(node.astype(kind) * kind(self._n_letters) + letters[at + n].astype(kind))
            alive = np.flatnonzero(node >= 0)
            at, node = at[alive], node[alive]
            yield n, at, node

    def find(self, low: pa.Array, placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """``(text, term, at)``: the terms that each text holds, in their order, and if ``placed`` where each begins first."""
        sizes, n = pc.utf8_length(low).to_numpy().astype(np.int64), len(low)
        text = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
        begin = np.cumsum(sizes + 1) - sizes - 1
        letters, inside = np.zeros(len(text), np.int32), np.ones(len(text), bool)
        inside[begin + sizes] = False  # no letter stands after each text
        letters[inside] = self._letters[_points(low)]
        keys, first = np.empty(0, np.int64), np.empty(0, np.int64)
        closer = {k: keys for k in self._over}
        for start in range(0, len(letters), _CHARS):
            found = [(keys, first)]
            for k, at, node in self._walk(letters, start, min(len(letters), start + _CHARS)):
                of = text[at].astype(np.int64)
                if k in closer:
                    held = self._over[k][0][node]
                    closer[k] = np.unique(np.concatenate([closer[k], of[held] << 32 | node[held]]))
                term = self._levels[k][1][node]
                some = np.flatnonzero(term >= 0)
                found.append((of[some] << 32 | term[some], at[some] - begin[of[some]] if placed else first))
            keys, first = _firsts(found, placed)
        if closer:
            keys, first = _firsts([(keys, first), *(self._look_closer(low, k, pairs.tolist()) for k, pairs in closer.items())], placed)
        return keys >> 32, keys & 0xFFFFFFFF, first if placed else None

    def _look_closer(self, low: pa.Array, k: int, pairs: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """The longer terms that stand in a text, of those under the grams that it holds."""
        _, nodes, places = self._over[k]
        found, named, last, held = [], {}, -1, ""
        for pair in pairs:
            text, node = pair >> 32, pair & 0xFFFFFFFF
            if node not in named:
                under = places[np.searchsorted(nodes, node):np.searchsorted(nodes, node, "right")]
                named[node] = list(zip(under.tolist(), self.terms.take(pa.array(self._order[under])).to_pylist()))
            if text != last:
                last, held = text, low[text].as_py()
            found += [(text << 32 | place, at) for place, term in named[node] if (at := held.find(term)) >= 0]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def rows(self, whole: pa.RecordBatch, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """The keys of the texts that hold some of the terms, and these."""
        for piece in _slices(whole):
            text, term, _ = self.find(piece.column("__low"), False)
            n_hits = np.bincount(text, minlength=piece.num_rows)
            at = np.flatnonzero(n_hits)
            ends = pa.array(np.concatenate(([0], np.cumsum(n_hits[at]))), pa.int32())
            if at.size:
                yield pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(at)) for k in keys),
                                                  pa.ListArray.from_arrays(ends, self.terms.take(pa.array(self._order[term])))], names=[*keys, "found"])
        _trim()

    def parts(self, whole: pa.RecordBatch, keys: Sequence[str], low: bool) -> Iterator[pa.RecordBatch]:
        """The same for one lane of several: ranks, places and sizes in one value, and if ``low`` the text, for all of them."""
        for piece in _slices(whole):
            text, term, first = self.find(piece.column("__low"), True)
            rows = self._order[term]
            ranks, sizes = self._ranks[rows], pc.utf8_length(self.terms.take(pa.array(rows))).to_numpy()
            ends = np.searchsorted(text, np.arange(piece.num_rows + 1)).tolist()
            at = [i for i in range(piece.num_rows) if low or ends[i] < ends[i + 1]]
            hits = [_planes(np.diff(ranks[a:b], prepend=0), first[a:b].astype(np.int32), sizes[a:b]) for a, b in ((ends[i], ends[i + 1]) for i in at)]
            kept = [*(piece.column(k).take(pa.array(at, pa.int64())) for k in keys)]
            texts = piece.column("__low").take(pa.array(at, pa.int64())) if low else pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([*kept, texts, pa.array(hits, pa.binary())], names=[*keys, "__low", "hits"])
        _trim()


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A few texts at a time, by number and by size."""
    ends = np.cumsum(pc.binary_length(whole.column("__low")).to_numpy().astype(np.int64))
    at = 0
    while at < whole.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHARS, "right"))
        stop = min(at + _TEXTS, max(at + 1, most))
        yield whole.slice(at, stop - at)
        at = stop


def _planes(ranks: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones: most of them are zeros, which Spark's codec leaves out."""
    return b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in (ranks, at, sizes))


def _numbers(planes: bytes) -> tuple[np.ndarray, ...]:
    """What ``_planes`` made of differences of ranks, places and sizes."""
    n, out = len(planes) // 16, []
    for low, kind in ((0, np.int64), (8, np.int32), (12, np.int32)):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(planes, np.uint8, n * size, n * low).reshape(size, n).T.copy().view(kind).reshape(n))
    return np.cumsum(out[0]), out[1], out[2]


def _merge(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with their hits of all lanes to their terms in order."""
    def merged(low: str, parts: Sequence[bytes]) -> list[str]:
        ranks, at, sizes = (np.concatenate(x) for x in zip(*map(_numbers, parts)))
        order = np.argsort(ranks, kind="stable")
        terms = [low[a:a + n] for a, n in zip(at[order].tolist(), sizes[order].tolist())]
        ranks = ranks[order]
        if (ranks[1:] == ranks[:-1]).any():
            terms = [t for _, t in sorted(zip(ranks.tolist(), terms))]
        return terms

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in _slices(whole):
                found = [merged(low, parts) for low, parts in zip(piece.column("__low").to_pylist(), piece.column("hits").to_pylist())]
                at = [i for i, terms in enumerate(found) if terms]
                yield pa.RecordBatch.from_arrays([*(piece.column(k).take(pa.array(at, pa.int64())) for k in keys),
                                                  pa.array([found[i] for i in at], pa.list_(pa.string()))], names=[*keys, "found"])
    return merge


def _look_up_here(keys: Sequence[str], terms: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts against terms that are broadcast."""
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = None
        for whole in batches:
            if lane is None:
                lane = _Lane()
                for b in terms.value.to_batches():
                    lane.add(*b.columns)
                lane.close()
            yield from lane.rows(whole, keys)
    return look_up


def _look_up(keys: Sequence[str], spread: int, one: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of places, a place's terms in order before its texts, to the terms of each text, or if there is not ``one`` lane to a part of them."""
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lane, read = None, None, False
        for whole in batches:
            rows = whole.column("__place").to_numpy() * 2 + np.asarray(whole.column("__is_text"))
            edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), whole.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                here, is_text = divmod(int(rows[low]), 2)
                if here != place:
                    place, lane, read = here, _Lane(), False
                piece = whole.slice(low, high - low)
                if not is_text:
                    lane.add(*(piece.column(c) for c in ("__gram", "__term", "__rank")))
                    continue
                if not read:
                    lane.close(not one)
                    read = True
                yield from lane.rows(piece, keys) if one else lane.parts(piece, keys, here < spread)
    return look_up


def _found_in_lanes(low: DataFrame, keys: Sequence[str], packed: DataFrame, lanes: int) -> DataFrame:
    """``(*keys, found)``: each text against the terms of one lane after the other, a lane's terms at as many places as there are cores."""
    spread = low.sparkSession.sparkContext.defaultParallelism
    if lanes > 1:  # what tells the parts of one text from those of another
        low, keys = low.withColumn("__row", F.monotonically_increasing_id()), [*keys, "__row"]
    kinds = [low.schema[k].dataType.simpleString() for k in keys]
    here = F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int")
    texts = low.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda n: n * spread + here)).alias("__place"), F.lit(True).alias("__is_text"),
                       *keys, "__low", *(F.lit(None).cast(t).alias(c) for c, t in _LISTS.items()))
    listed = packed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda n: F.col("lane") * spread + n)).alias("__place"), F.lit(False).alias("__is_text"),
                           *(F.lit(None).cast(t).alias(k) for k, t in zip(keys, kinds)), F.lit(None).cast("string").alias("__low"), *_LISTS)
    dealt = texts.unionByName(listed).repartitionById(lanes * spread, F.col("__place")).sortWithinPartitions("__place", "__is_text", "grams")
    # a row for each term again, only now: a task sorts them as lists, and its worker gets few at a time
    dealt = dealt.select("__place", "__is_text", *keys, "__low", F.inline_outer(F.arrays_zip(*_LISTS)).alias("__gram", "__term", "__rank"))
    named, found = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds)), "found array<string>"
    if lanes == 1:
        return dealt.mapInArrow(_look_up(keys, spread, True), f"{named}, {found}")
    parts = dealt.mapInArrow(_look_up(keys, spread, False), f"{named}, __low string, hits binary")
    # by text before they are gathered: parts of one text have nothing to be added up on the way
    return (parts.repartition(*keys).groupBy(*keys).agg(F.max("__low").alias("__low"), F.collect_list("hits").alias("hits"))
            .mapInArrow(_merge(keys), f"{named}, {found}"))


def substring_hits(df: DataFrame, keys: Sequence[str], terms: DataFrame, text_col: str = "text", term_col: str = "term",
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Texts whose lower-cased form contains listed terms: ``(*keys, n_found, found)``.

    ``found`` has the lower-cased terms in the order of ``terms.rank`` (if present; then by the term),
    ``keys`` identify a text. Empty and NULL terms are ignored, NULL texts hold nothing.

    Every text is walked through a trie of the terms of up to q characters, and of one q-gram of each longer term, that
    decides on the former; a second look decides on the latter. A task holds the trie and a few texts. Up to
    ``broadcast_rows`` terms are broadcast to where the texts are. More are dealt with the texts to as many places as there
    are cores, up to ``_LANE`` terms whole. Beyond, they are dealt to lanes by the length of their grams, and by hash where
    one length has more; every text goes once to each lane. Only then are hits shuffled, as numbers, to be put in order.
    """
    rank = F.col("rank").cast("bigint") if "rank" in terms.columns else F.lit(0).cast("bigint")
    listed = materialize(terms.select(F.lower(term_col).alias("term"), rank.alias("rank")).filter("length(term) > 0")
                         .groupBy("term").agg(F.min("rank").alias("rank")), "terms")
    length = F.length("term")
    weight = F.when(length <= _Q, 1).otherwise(2 + (length / _Q).cast("bigint"))
    counts = {r["size"]: r["n"] for r in listed.groupBy(F.least(length, F.lit(_Q)).alias("size")).agg(F.sum(weight).alias("n")).collect()}  # 1 to _Q
    anchors = listed.filter(length <= _Q).select(F.col("term").alias("gram"), F.lit(None).cast("string").alias("term"), "rank")
    longer = listed.filter(length > _Q)
    if not longer.isEmpty():
        anchors = materialize(anchors.unionByName(_anchors(longer)), "anchors")
    lanes = [([*counts], 0, 1)] if (few := sum(counts.values()) <= broadcast_rows) else _lanes(counts)
    lane = F.coalesce(*(F.when(F.length("gram").isin(sizes) & (F.pmod(F.xxhash64("gram"), F.lit(parts)) == part), F.lit(i))
                        for i, (sizes, part, parts) in enumerate(lanes)), F.lit(0))
    ordered = anchors.withColumn("lane", lane).orderBy("lane", "gram")
    named = [f"__key{i}" for i in range(len(keys))]
    low = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.lower(text_col).alias("__low")).filter("__low is not null")
    if few:
        terms_here = low.sparkSession.sparkContext.broadcast(ordered.select("gram", "term", "rank").toArrow())
        kinds = ", ".join(f"{n} {low.schema[n].dataType.simpleString()}" for n in named)
        found = low.mapInArrow(_look_up_here(named, terms_here), f"{kinds}, found array<string>")
    else:
        packed = ordered.mapInArrow(_pack, ", ".join(["lane int", *(f"{c} {t}" for c, t in _LISTS.items())]))
        found = _found_in_lanes(low, named, packed, len(lanes))
    return found.select(*(F.col(n).alias(k) for n, k in zip(named, keys)), F.size("found").cast("bigint").alias("n_found"), "found")
