"""SentencePiece BPE (with byte fallback) by vectorised merge rounds, and its decoding.

A text is cut between any two neighbouring characters that no piece of the vocabulary holds
side by side: no merge can cross such a cut, so the segments between cuts are encoded on their
own, each distinct segment of a slice once. The symbols of all segments lie in one flat array.
A round finds the best pair of every segment by a segmented minimum and merges its places from
the left, as far as a merge brings forth no pair that would come before the next place; then
the array is compacted and finished segments leave it.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordscan import offsets_of, slices, text_bytes

SPACE = "▁"
#: Symbols that go through the rounds together, and bytes whose cuts are looked for together.
ROUND_SYMBOLS, CUT_BYTES = 1 << 18, 1 << 20
#: A segment of more symbols is merged one pair after another from a heap, in the same order: the
#: rounds of a run of blanks (pieces of equal score) would take time with the square of its length.
LONG_SEGMENT = 512
_NONE = np.int32(2**31 - 1)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("textweir-each-byte", _each_byte)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for ``size[0]`` places, then the same of the next range."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class _Runs:
    """Lists of numbers by id, flat."""

    def __init__(self, rows: list, kind: type):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.array([x for r in rows for x in r], kind)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.start[ids], self.size[ids])]


class PieceModel:
    """A model file of the BPE kind with byte fallback, identity normalization and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        if (sp.normalize(" a  ﬁ Ａ\n") != f"{SPACE * 2}a{SPACE * 2}ﬁ{SPACE}Ａ\n" or any(map(sp.is_unused, range(n)))
                or sum(map(sp.is_byte, range(n))) != 256):
            raise ValueError(f"{path}: not a model of plain pieces with byte fallback, a dummy prefix and no normalization")
        self.eos = sp.eos_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        for i in filter(sp.is_byte, range(n)):
            self.byte_id[int(names[i][3:5], 16)] = i
        known = {names[i].replace(SPACE, " "): i for i in range(n) if not special[i]}
        # symbols: the pieces, then characters that occur in pieces and are none
        symbols = dict(known)
        for c in sorted({c for piece in known for c in piece}):
            symbols.setdefault(c, len(names) + len(symbols) - len(known))
        extra = sorted((s, c) for c, s in symbols.items() if s >= n)
        self.expand = _Runs([[i] for i in range(n)] + [self.byte_id[list(c.encode())].tolist() for _, c in extra], np.int32)
        # decoding: the bytes of each id
        self.skip = np.array([sp.is_control(i) for i in range(n)])
        unknown = sp.decode([sp.unk_id()])
        self.surface = _Runs([b"" if sp.is_control(i) else unknown.encode() if sp.is_unknown(i)
                              else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i)
                              else names[i].replace(SPACE, " ").encode() for i in range(n)], np.uint8)
        self.blank = np.array([not special[i] and names[i].startswith(SPACE) for i in range(n)])
        # merges
        scores = {piece: sp.get_score(i) for piece, i in known.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(n, _NONE, np.int32)
        for piece, i in known.items():
            self.rank[i] = order[scores[piece]]
        self.width = n + len(extra)
        pairs = {}
        hasty = np.zeros(n, bool)  # a merge into it may bring forth a pair of its rank or a better one
        for piece, i in known.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] * self.width + symbols[right]] = i
                    for part in (left, right):
                        if part in known and len(part) > 1 and self.rank[i] <= self.rank[known[part]]:
                            hasty[known[part]] = True
        self.hasty = hasty
        self.bits = max(4, (len(pairs) * 4).bit_length())
        self._fill(pairs)
        # characters that stand beside another in some piece, and which
        joined = sorted({c for piece in known if len(piece) > 1 for c in piece})
        number = {c: k + 1 for k, c in enumerate(joined)}
        self.beside = np.zeros((len(joined) + 1, len(joined) + 1), bool)
        for piece in known:
            for a, b in zip(piece, piece[1:]):
                self.beside[number[a], number[b]] = True
        self.number = np.zeros(0x110000, np.int16)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, k in number.items():
            self.number[ord(c)] = k
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, pairs: dict[int, int]) -> None:
        """An open hash table of the pairs; ``probes`` is the longest way to one."""
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.made = np.full(len(self.keys), -1, np.int32)
        self.probes = 1
        for key, at in zip(pairs, self._slot(np.array(list(pairs), np.int64)).tolist()):
            far = 1
            while self.keys[at] >= 0:
                at, far = at + 1, far + 1
            self.keys[at], self.made[at], self.probes = key, pairs[key], max(self.probes, far)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes (-1: none) and its rank."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        piece = np.full(len(keys), -1, np.int32)
        live = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[at[live]]
            hit = there == keys[live]
            piece[live[hit]] = self.made[at[live[hit]]]
            live = live[(there >= 0) & ~hit]
            if not len(live):
                break
            at[live] += 1
        return piece, np.where(piece >= 0, self.rank[piece], _NONE)

    def _pair(self, sym: np.ndarray, last: np.ndarray, at: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> None:
        """Look up the pairs that begin at ``at``."""
        piece[at], rank[at] = -1, _NONE
        at = at[~last[at]]
        piece[at], rank[at] = self._merged(sym[at], sym[at + 1])

    def _rounds(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each segment (of ``size`` symbols, one at least), and their numbers."""
        owner = np.arange(len(size))
        out_sym, out_owner, counts = [], [], np.zeros(len(size), np.int64)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        piece, rank = np.empty(len(sym), np.int32), np.empty(len(sym), np.int32)
        self._pair(sym, last, np.arange(len(sym)), piece, rank)
        while len(sym):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            done = best == _NONE
            if done.any():
                ended = np.repeat(done, size)
                out_sym.append(sym[ended])
                out_owner.append(np.repeat(owner[done], size[done]))
                counts[owner[done]] = size[done]
                live = ~ended
                sym, last, piece, rank = sym[live], last[live], piece[live], rank[live]
                owner, size, best = owner[~done], size[~done], best[~done]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            # places of the best pair, every other one where they overlap
            at = np.flatnonzero(rank == np.repeat(best, size))
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | last[at[:-1]]
            run = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            segment = np.searchsorted(first, at, side="right") - 1
            odd = np.flatnonzero(self.hasty[piece[at]])
            if len(odd):
                at, segment = self._calm(sym, last, piece, at, segment, odd, first)
            sym[at] = piece[at]
            last[at] = last[at + 1]
            gone = np.ones(len(sym), bool)
            gone[at + 1] = False
            size = size - np.bincount(segment, minlength=len(size))
            at = at - np.arange(len(at))
            sym, last, piece, rank = sym[gone], last[gone], piece[gone], rank[gone]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            self._pair(sym, last, np.flatnonzero(changed), piece, rank)
        owners = np.concatenate(out_owner) if out_owner else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        return (np.concatenate(out_sym)[order] if out_sym else np.zeros(0, np.int32)), counts

    def _calm(self, sym, last, piece, at, segment, odd, first) -> tuple[np.ndarray, np.ndarray]:
        """The places up to the first of each segment whose merge brings forth a pair of no worse rank."""
        spot, made = at[odd], piece[at[odd]]
        haste = np.zeros(len(at), bool)
        inner = spot > first[segment[odd]]
        neighbour = sym[spot - 1].copy()
        joined = (odd > 0) & (at[odd - 1] == spot - 2) & (segment[odd - 1] == segment[odd])
        neighbour[joined] = piece[spot[joined] - 2]
        haste[odd[inner]] = self._merged(neighbour[inner], made[inner])[1] <= self.rank[made[inner]]
        more = ~last[spot + 1]
        haste[odd[more]] |= self._merged(made[more], sym[spot[more] + 2])[1] <= self.rank[made[more]]
        earlier = np.cumsum(haste) - haste
        start = np.searchsorted(segment, segment)
        calm = earlier == earlier[start]
        return at[calm], segment[calm]

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """The symbols left of one segment: always the best pair, the first of equals."""
        pairs = {}  # distinct pairs are few

        def push(i: int, j: int) -> None:
            key = (sym[i], sym[j])
            if key not in pairs:
                made, rank = self._merged(np.array(key[:1]), np.array(key[1:]))
                pairs[key] = int(made[0]), int(rank[0])
            made, rank = pairs[key]
            if made >= 0:
                heapq.heappush(heap, (rank, i, j, *key, made))

        after = [*range(1, len(sym)), -1]
        before = [*range(-1, len(sym) - 1)]
        heap: list[tuple] = []
        for i in range(len(sym) - 1):
            push(i, i + 1)
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = made, -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in sym if s != -2]

    def _segments(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the distinct segments, and their bounds."""
        raw, offsets = text_bytes(values)
        flat, sizes, low = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while low < len(values):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + ROUND_SYMBOLS, side="right")) - 1)
            data = raw[offsets[low]:offsets[high]]
            code, start = _characters(data)
            sym = self.symbol[code]
            bounds = np.searchsorted(start, offsets[low:high + 1] - offsets[low])
            size = np.diff(bounds)
            alien = sym[bounds[:-1]] < 0  # a character of no piece is a segment
            long = size > LONG_SEGMENT
            plain = ~alien & ~long
            left, counts = self._rounds(sym[_ranges(bounds[:-1][plain], size[plain])], size[plain])
            count = np.zeros(len(size), np.int64)
            count[plain] = counts
            count[alien] = np.diff(offsets[low:high + 1])[alien]
            rest = {i: np.array(self._one_by_one(sym[bounds[i]:bounds[i + 1]].tolist()), np.int32)
                    for i in np.flatnonzero(long).tolist()}
            for i, s in rest.items():
                count[i] = len(s)
            begin = np.cumsum(count) - count
            out = np.empty(int(count.sum()), np.int32)
            out[_ranges(begin[plain], count[plain])] = left
            for i, s in rest.items():
                out[begin[i]:begin[i] + len(s)] = s
            places = _ranges(begin[alien], count[alien])
            out[places] = self.byte_id[data[_ranges((offsets[low:high] - offsets[low])[alien], count[alien])]]
            grown = self.expand.size[out]
            ends = np.concatenate(([0], np.cumsum(grown)))
            flat.append(self.expand.of(out))
            sizes.append(ends[begin + count] - ends[begin])
            low = high
        return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The byte places where segments begin."""
        begins = np.zeros(len(raw) + 1, bool)
        low = behind = 0
        while low < len(raw):
            high = min(low + CUT_BYTES, len(raw))
            while high < len(raw) and raw[high] & 0xC0 == 0x80:
                high += 1
            code, start = _characters(raw[low:high])
            kind = self.number[code]
            begins[start[~self.beside[np.concatenate(([behind], kind[:-1])), kind]] + low] = True
            behind, low = int(kind[-1]), high
        begins[offsets] = True
        return np.flatnonzero(begins[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the bounds of the texts in them."""
        texts = texts.cast(pa.large_string()).fill_null("")
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.replace_substring(pc.binary_join_element_wise(blank, texts, none), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, none), texts, spaced)
        raw, offsets = text_bytes(texts)
        cuts = self._cuts(raw, offsets)
        whole = np.append(cuts, len(raw))
        segments = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts), [None, pa.py_buffer(whole), pa.py_buffer(raw)]).dictionary_encode()
        flat, bounds = self._segments(segments.dictionary)
        code = segments.indices.to_numpy()
        size = np.diff(bounds)[code]
        reached = np.concatenate(([0], np.cumsum(size)))
        tokens = reached[np.searchsorted(cuts, offsets)]
        ends = tokens + np.arange(len(tokens))
        out = np.full(ends[-1], self.eos, np.int32)
        filled = np.ones(len(out), bool)
        filled[ends[1:] - 1] = False
        out[filled] = flat[_ranges(bounds[code], size)]
        return out, ends

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each list of ids, as the library's ``decode`` gives it."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.skip)):
            raise ValueError("ids beyond the vocabulary")
        size = self.surface.size[ids]
        drop = np.zeros(len(ids), np.int64)
        said = np.flatnonzero(~self.skip[ids])  # control ids say nothing
        lead = np.searchsorted(said, bounds[:-1])
        some = lead < np.searchsorted(said, bounds[1:])
        lead = said[lead[some]]
        drop[lead] = self.blank[ids[lead]]  # the dummy prefix
        raw = self.surface.flat[_ranges(self.surface.start[ids] + drop, size - drop)]
        reached = np.concatenate(([0], np.cumsum(size - drop)))
        ends = reached[bounds]
        apart = np.unique(np.concatenate((ends, reached[:-1][self.skip[ids]])))  # no character goes over these
        try:
            raw.tobytes().decode()
            good = not np.any(raw[apart[apart < len(raw)]] & 0xC0 == 0x80)
        except UnicodeDecodeError:
            good = False
        if not good:
            data = raw.tobytes()
            parts = [data[a:b].decode(errors="textweir-each-byte") for a, b in zip(apart[:-1].tolist(), apart[1:].tolist())]
            place = np.searchsorted(apart, ends).tolist()
            return pa.array(["".join(parts[a:b]) for a, b in zip(place[:-1], place[1:])], pa.large_string())
        return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte at which each begins."""
    start = np.flatnonzero(raw & 0xC0 != 0x80)
    lead = raw[start]
    code = lead.astype(np.int32)
    for least, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero((lead >= least) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        if len(wide):
            value = (lead[wide] & keep).astype(np.int32)
            for k in range(1, more + 1):
                value = value << 6 | raw[start[wide] + k] & 0x3F
            code[wide] = value
    return code, start


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text by the model file, with an end id.

    Null and empty texts have the end id alone. Every row counts, also rows that repeat a doc_id or
    have none; an empty table gives no rows. Other columns are ignored.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, bounds = _model(model).encode(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encoded, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ``ids``. Null ids have a null text, no ids an empty one;
    null entries of ids are skipped, ids beyond the vocabulary fail. Other columns are ignored."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            offsets, low = offsets_of(whole.column("ids")), 0
            while low < whole.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 20), side="right")) - 1)
                batch = whole.slice(low, high - low)
                lists = batch.column("ids")
                bounds = offsets_of(lists)
                ids = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                text = _model(model).decode(ids.to_numpy(), bounds - bounds[0])
                text = pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, text.cast(pa.string())],
                                                 names=["doc_id", "ids", "text"])
                low = high

    encoded = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                             F.array_compact(F.col("ids").cast("array<int>")).alias("ids"))
    return encoded.mapInArrow(decoded, "doc_id bigint, ids array<int>, text string")
