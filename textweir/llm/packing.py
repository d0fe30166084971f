"""Best-fit packing of tokenized documents, with the dominance reduction of Martello and Toth.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most
``capacity`` counts, whatever the number of documents. The reduction and the best fit run on
counts. Pieces find their place by their rank among the pieces of their length: their
partition's share of the ranks plus their place in the partition, without a global sort.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small
from .wordscan import slices, text_bytes

CAPACITY = 2048
#: Pieces whose ids a worker remembers; beyond, those met least are forgotten and tokenized again where they occur.
REMEMBERED = 400_000


#: Whether a byte is white space, a letter, a digit, another ASCII character, or one that keeps its word as it is
#: (an apostrophe, a part of a character beyond ASCII, or what begins a special token). U+00C0 to U+024F count as letters.
_BLANK, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, *range(0x80, 0x100)]] = _WHOLE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class WordTokens:
    """Ids of texts, tokenized piece by piece.

    A piece is a word between ASCII white space; a word of ASCII and Latin letters without an apostrophe is
    folded (A-Z) and cut further into runs of letters, single digits and runs of other characters, if the tokenizer does so.
    Exact for tokenizers whose normalizer and pre-tokenizer treat such pieces independently, and drop
    the white space. Distinct pieces of a slice are tokenized once; those met again are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        pre, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.cuts = pre is not None and [t for t, _ in pre.pre_tokenize_str("ab12(.c-d")] == ["ab", "1", "2", "(.", "c", "-", "d"]
        self.folds = norm is not None and norm.normalize_str("AZ") == "az"
        self.kind = _KIND.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.kind[token.content.encode()[0]] = _WHOLE
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            names = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.known = pa.array([], pa.large_binary())  # a Python string each would take ten times the memory
        self.flat = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int32)

    def _kinds(self, raw: np.ndarray) -> np.ndarray:
        kind = self.kind[raw]
        lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
        if len(lead):
            # but for the signs of times and division, and the dotted capital I, of which folding makes two characters
            lead = lead[((raw[lead] != 0xC3) | (raw[lead + 1] & 0xDF != 0x97)) & ((raw[lead] != 0xC4) | (raw[lead + 1] != 0xB0))]
            kind[lead] = kind[lead + 1] = _LETTER
        return kind

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of ``words``, none of them empty, and the number of each word's."""
        raw, offsets = text_bytes(words)
        kind = self._kinds(raw)
        first = offsets[:-1]
        low, high = np.minimum.reduceat(kind, first), np.maximum.reduceat(kind, first)
        single = self.cuts & (low == high) & ((low == _LETTER) | (low == _OTHER) | (low == _DIGIT) & (np.diff(offsets) == 1))
        single &= self.ends is not None
        sizes, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        order = [np.flatnonzero(single), np.flatnonzero(~single & (high != _BLANK))]
        names = words.cast(pa.large_string())
        for low in range(0, len(order[0]), 200_000):  # as many to a text: each ends in a token that says so
            at = order[0][low:low + 200_000]
            some = names.take(pa.array(at)).to_pylist()
            ids = self._flat([" ".join(some[i:i + 500]) for i in range(0, len(some), 500)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(at):
                raise ValueError("the tokenizer does not end each piece in a token of its own")
            sizes[at] = np.diff(ends, prepend=0)
            parts.append(ids)
        for low in range(0, len(order[1]), 8_192):  # encodings are large objects
            at = order[1][low:low + 8_192]
            ids, sizes[at] = self._flat(names.take(pa.array(at)).to_pylist())
            parts.append(ids)
        flat = np.concatenate(parts)
        taken = np.concatenate(order)  # the words in the order of ``flat``
        begin = np.zeros(len(words), np.int64)
        begin[taken] = np.cumsum(sizes[taken]) - sizes[taken]
        ends = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(begin - (ends - sizes), sizes)], sizes

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), [len(i) for i in ids]

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and start and size in them for each of the distinct ``words``."""
        code = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(code < 0)
        self.hits[code[code >= 0]] += 1
        start = np.zeros(len(code), np.int64)
        size = np.zeros(len(code), np.int64)
        old = code >= 0
        start[old], size[old] = self.bounds[code[old]], np.diff(self.bounds)[code[old]]
        if not len(missing):
            return self.flat, start, size
        new = words.take(pa.array(missing))
        ids, sizes = self._encode(new)
        ends = np.cumsum(sizes)
        start[missing], size[missing] = len(self.flat) + ends - sizes, sizes
        flat = np.concatenate((self.flat, ids))
        self.known = pa.concat_arrays([self.known, new])
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + ends))
        self.hits = np.concatenate((self.hits, np.zeros(len(new), np.int32)))
        self.flat = flat
        if len(self.known) > REMEMBERED:
            self._forget()
        return flat, start, size

    def _forget(self) -> None:
        """Keep the half that was met most often, its counts halved."""
        kept = np.sort(np.argsort(-self.hits, kind="stable")[:REMEMBERED // 2])
        sizes = np.diff(self.bounds)[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.bounds[kept] - (ends - sizes), sizes)]
        self.known = self.known.take(pa.array(kept))
        self.bounds = np.concatenate(([0], ends))
        self.hits = self.hits[kept] // 2

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, plain words folded, and where pieces begin; runs of white space are pieces too."""
        kind = self._kinds(raw)
        begins = np.zeros(len(raw) + 1, bool)
        blank = kind == _BLANK
        begins[1:-1] = blank[1:] != blank[:-1]
        begins[offsets] = True
        words = np.flatnonzero(begins[:-1])
        kept = np.unique(np.searchsorted(words, np.flatnonzero(kind == _WHOLE), side="right") - 1)
        marks = np.zeros(len(raw) + 1, np.int8)
        marks[words[kept]] = 1
        marks[np.append(words, len(raw))[kept + 1]] -= 1
        plain = np.cumsum(marks, dtype=np.int8) == 0
        if self.folds:
            raw = np.where(plain[:-1], _LOWER[raw], raw)
        if self.cuts:
            begins[1:-1] |= ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & plain[1:-1]
        return raw, np.flatnonzero(begins[:-1])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, a 0 after each text, and the bounds of the texts in them."""
        raw, offsets = text_bytes(texts)
        raw, starts = self._cut(raw, offsets)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        flat, start, size = self._table(words.dictionary)
        code = words.indices.to_numpy()
        sizes = size[code]
        reached = np.concatenate(([0], np.cumsum(sizes)))
        tokens = reached[np.searchsorted(starts, offsets)]
        place = np.arange(reached[-1]) + np.repeat(start[code] - reached[:-1], sizes)
        ends = tokens + np.arange(len(tokens))
        out = np.zeros(ends[-1], np.uint32)
        filled = np.ones(len(out), bool)
        filled[ends[1:] - 1] = False
        out[filled] = flat[place]
        return out, ends


_TOKENS: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, bounds = _TOKENS[path](batch.column("text"))
                total = np.diff(bounds)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                order = np.argsort(length, kind="stable")
                by = length[order]
                first = np.searchsorted(by, by)
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - first + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                cuts = np.concatenate((bounds[row] + start, bounds[-1:])) * 4
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()), data.cast(pa.binary()), pa.array(np.full(len(row), part), pa.int32()),
                    pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "rank"])
    return cut


def dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Bins that some best solution has, as (number of bins, pieces in each), and the counts left.

    A piece j with its largest partner k is fixed if no set that may stand beside j needs a
    better place: the two fill the bin; or no two pieces fit beside j; or no three fit, and
    any two that fit are together no larger than k, so that they can take k's place.
    """
    left = {size: n for size, n in counts.items() if n}
    fixed: list[tuple[int, dict[int, int]]] = []

    def take(n: int, pieces: dict[int, int]) -> None:
        fixed.append((n, pieces))
        for size, k in pieces.items():
            left[size] -= n * k
            if not left[size]:
                del left[size]

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                own = left[j]
                others = sorted(size for size in left if size <= room and (size != j or own > 1))
                if not others:
                    take(own, {j: 1})
                    changed = True
                    break
                k = others[-1]
                least: list[int] = []
                for size in others:
                    least += [size] * min(left[size] - (size == j), 3 - len(least))
                    if len(least) >= 3:
                        break
                sure = (k == room or sum(least[:2]) > room or len(least) < 2
                        or (sum(least) > room or len(least) < 3) and _best_pair(others, left, j, room) <= k)
                if not sure:
                    break
                take(own // 2 if k == j else min(own, left[k]), {j: 2} if k == j else {j: 1, k: 1})
                changed = True
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum of two pieces that fits into ``room``; 0 without one."""
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[low], sizes[high]
        if low == high and left[a] - (a == j) < 2:
            break
        if a + b <= room:
            best = max(best, a + b)
            low += 1
        else:
            high -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, longest pieces first, on counts: equal bins are filled together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                bins, pieces, room = -(-n // (capacity // size)), {}, capacity
            else:
                bins, pieces = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // size
            full = min(bins, n // each)
            rest = min(n - full * each, each) if full < bins else 0
            for number, k in ((full, each), (1 if rest else 0, rest)):
                if number:
                    open_.setdefault(room - k * size, []).append((number, {**pieces, size: k}))
            kept = bins - full - (1 if rest else 0)
            if kept and pieces:
                open_.setdefault(room, []).append((kept, pieces))
            n -= full * each + rest
    return [b for bins in open_.values() for b in bins]


def _places(bins: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each length the runs of ranks, with the first sequence, pieces per sequence and offset of a run."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for number, pieces in bins:
        offset = 0
        for size in sorted(pieces, reverse=True):
            rows.append((size, used.get(size, 0), sequence, pieces[size], offset))
            used[size] = used.get(size, 0) + number * pieces[size]
            offset += size * pieces[size]
        sequence += number
    out = pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"], dtype="int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def _placing(places: pd.DataFrame):
    size, first, sequence, each, offset = (places[c].to_numpy() for c in places.columns)
    low = np.searchsorted(size, np.arange(int(size[-1]) + 2 if len(size) else 1))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            mine = length == n
            at[mine] = low[n] + np.searchsorted(first[low[n]:low[n + 1]], rank[mine], side="right") - 1
        local = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + local // each[at],
                             "offset": offset[at] + local % each[at] * length})
    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its ids by the tokenizer file, then id 0; ``ids`` holds a piece's as
    little-endian unsigned 32-bit numbers. Only documents longer than ``capacity`` are cut.
    Null and empty texts are one id 0. Every row is packed, also rows that repeat a doc_id or
    have none; an empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(docs.mapInArrow(
        _pieces(tokenizer, capacity),
        "doc_id bigint, piece int, start bigint, length int, ids binary, part int, rank bigint"), "pieces")
    shares = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = saved(shares.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    fixed, left = dominated(counts, capacity)  # at most ``capacity`` lengths
    place = _placing(_places(fixed + best_fit(left, capacity)))
    return (pieces.join(small(shares.drop("n")), ["part", "length"])
            .withColumn("at", place("length", F.col("base") + F.col("rank")))
            .select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids",
                    "at.sequence_id", "at.offset"))
