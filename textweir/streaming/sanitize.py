"""Sentence-buffered sanitizing of chunk streams.

Only the buffering is stateful Python; it hands out whole sentences, which the
detectors then check as ordinary columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import SENTENCE_END
from ..operators.corpus import emit_text
from ..operators.scan import Models, scan
from ..policy import Policy

OUT_SCHEMA = "stream_id string, ord bigint, seq bigint, kind string, sentence string, separator string"
_ROW = Row(*(column.split()[0] for column in OUT_SCHEMA.split(", ")))

# the end of a sentence: what follows the lazy part of the sentence pattern
_CHUNK_END = re.compile(SENTENCE_END.replace("(.*?[.?!])", "[.?!]"))
# as above, but the white space must be complete: a following character is seen
_TEXT_END = re.compile(r"[.?!](\s+)(?=\S)")
#: Chunks of one call that wait in memory for those before them, until they go into the state.
_LOCAL = 10_000


class Cutter:
    """Text without a sentence end yet: ``head``, and a ``mark`` that ends it with the ``blanks`` after it.

    ``chunk`` also cuts at a final ``.?!`` of what has come; ``text`` waits for what follows
    it, so its sentences do not depend on where the chunks were cut. Only what is new is searched.
    """

    def __init__(self, held: str = ""):
        self.head: list[str] = []
        self.mark, self.blanks = "", []
        self._settle(held)

    def _settle(self, rest: str) -> None:
        """Keep ``rest``, in which no sentence ends; a mark at its end may yet end one."""
        bare = rest.rstrip()
        at = len(bare) - 1 if bare and bare[-1] in ".?!" else len(rest)
        if at:
            self.head.append(rest[:at])
        self.mark = rest[at:at + 1]
        self.blanks = [rest[at + 1:]] if rest[at + 1:] else []

    def feed(self, chunk: str, mode: str) -> list[tuple[str, str]]:
        """Complete sentences ``(body, separator)`` once ``chunk`` has come."""
        found: list[tuple[str, str]] = []
        if mode == "chunk":
            ends, text = _CHUNK_END, self.mark + "".join(self.blanks) + chunk
        else:
            ends, text = _TEXT_END, chunk.lstrip() if self.mark else chunk
            if self.mark and not text:
                self.blanks += [chunk] if chunk else []
                return found
            if self.mark:
                self.head.append(self.mark)
                between = "".join(self.blanks) + chunk[:len(chunk) - len(text)]
                if between:
                    found.append(("".join(self.head), between))
                    self.head = []
        at = 0
        while (m := ends.search(text, at)) is not None:
            found.append(("".join(self.head) + text[at:m.start() + 1], m.group(1)))
            self.head, at = [], m.end()
        self._settle(text[at:])
        return found

    def rest(self) -> str:
        return "".join(self.head) + self.mark + "".join(self.blanks)


class _Sentences(StatefulProcessor):
    """One stream's text, its place, and the chunks beyond a gap, each under its number."""

    def __init__(self, mode: str, idle_ms: int, parked_most: int | None):
        self.mode, self.idle_ms, self.parked_most = mode, idle_ms, parked_most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("stream", "buffer string, next_seq bigint, ord bigint, parked bigint, gone bigint, latest bigint")
        self.parked = handle.getMapState("parked", "seq bigint", "chunk string, eos boolean")
        self.gone = handle.getMapState("gone", "seq bigint", "eos boolean")  # handed out as dead letters

    # --- the state of one stream while one call runs ---

    def _load(self) -> None:
        held = self.value.get() if self.value.exists() else ("", 0, 0, 0, 0, 0)
        self.text = Cutter(held[0])
        self.next_seq, self.ord, self.n_parked, self.n_gone, self.latest = held[1:]
        self.before = self.latest if held[5] else None
        self.local: dict[int, tuple[str | None, bool]] = {}
        self.rows: list[tuple] = []
        self.done = False

    def _emit(self, seq: int, kind: str, sentence: str | None, separator: str = "") -> None:
        self.rows.append((self.ord, seq, kind, sentence, separator))
        self.ord += 1

    def _feed(self, seq: int, chunk: str | None, eos: bool) -> None:
        if chunk:
            for body, separator in self.text.feed(chunk, self.mode):
                self._emit(seq, "sentence", body, separator)
        elif not eos:
            self._emit(seq, "pass", chunk)
        if eos:
            self._flush(seq)

    def _flush(self, seq: int) -> None:
        # what text mode held back is now final
        if self.mode == "text":
            for body, separator in self.text.feed("", "chunk"):
                self._emit(seq, "sentence", body, separator)
        if rest := self.text.rest():
            self._emit(seq, "tail", rest)
        self.text, self.done = Cutter(), True

    def _park(self) -> None:
        """What waits in memory goes into the state."""
        for seq, held in self.local.items():
            known = self.n_parked and self.parked.containsKey((seq,))
            self.parked.updateValue((seq,), held)
            self.n_parked += not known
        self.local = {}

    def _advance(self) -> None:
        """Feed chunks as long as they come without a gap; dead letters are none."""
        while True:
            seq = self.next_seq
            stored = self.parked.getValue((seq,)) if self.n_parked and self.parked.containsKey((seq,)) else None
            if stored is not None:
                self.parked.removeKey((seq,))
                self.n_parked -= 1
            if seq in self.local:
                self._feed(seq, *self.local.pop(seq))
            elif stored is not None:
                self._feed(seq, *stored)
            elif self.n_gone and self.gone.containsKey((seq,)):
                if self.gone.getValue((seq,))[0]:
                    self._flush(seq)
                self.gone.removeKey((seq,))
                self.n_gone -= 1
            else:
                return
            self.next_seq += 1

    def _spill(self, most: int) -> None:
        """Hand out parked chunks beyond ``most``, those farthest ahead first, as dead letters."""
        if self.n_parked <= most:
            return
        for seq in sorted(k[0] for k in self.parked.keys())[most:][::-1]:
            chunk, eos = self.parked.getValue((seq,))
            self.parked.removeKey((seq,))
            self.gone.updateValue((seq,), (eos,))
            self.n_parked, self.n_gone = self.n_parked - 1, self.n_gone + 1
            self._emit(seq, "dead_letter", chunk)

    def _out(self, key: tuple) -> list[Row]:
        out, self.rows = [_ROW(key[0], *r) for r in self.rows], []
        return out

    def _forget(self) -> None:
        for state, n in ((self.parked, self.n_parked), (self.gone, self.n_gone)):
            if n:
                state.clear()
        if self.before is not None:
            self.value.clear()
            self.handle.deleteTimer(self.before + self.idle_ms)

    # --- calls ---

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        for row in rows:
            seq = row.seq
            if seq >= self.next_seq and not (self.n_gone and self.gone.containsKey((seq,))):  # another one is a repeat
                self.local[seq] = (row.chunk, bool(row.eos))
                if seq == self.next_seq:
                    self._advance()
            self.latest = max(self.latest, row.ms)
            if len(self.local) > _LOCAL:
                self._park()
            if len(self.rows) > _LOCAL:
                yield from self._out(key)
        self._advance()
        # only now: what fills a gap may be in a later row
        if not self.done:
            self._park()
            if self.parked_most is not None:
                self._spill(self.parked_most)
                self._advance()
        yield from self._out(key)
        if self.done:
            self._forget()
            return
        self.value.update((self.text.rest(), self.next_seq, self.ord, self.n_parked, self.n_gone, self.latest))
        if self.before != self.latest:
            if self.before is not None:
                self.handle.deleteTimer(self.before + self.idle_ms)
            self.handle.registerTimer(self.latest + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The stream went idle: feed what is parked in order, over its gaps, and flush."""
        self._load()
        if self.before is None or self.latest + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            return
        for seq in sorted(k[0] for k in self.parked.keys()) if self.n_parked else ():
            self.next_seq = seq
            self._feed(seq, *self.parked.getValue((seq,)))
            if len(self.rows) > _LOCAL:
                yield from self._out(key)
        if not self.done:
            self._flush(self.next_seq)
        yield from self._out(key)
        self._forget()

    def close(self) -> None:
        pass


def sentence_stream(chunks: DataFrame, mode: str = "text", idle: str = "10 minutes", parked_most: int | None = None) -> DataFrame:
    """Chunks ``(stream_id, seq, ts, chunk, eos)`` -> sentences, in ``ord`` per stream.

    Chunks may arrive in any order; those beyond a gap are parked. An ``eos`` chunk
    flushes a stream. So does silence: after ``idle`` of event time without a chunk
    it is flushed over any gap and forgotten; a chunk that comes later than that is
    dropped by the watermark. Empty chunks pass through. State per stream is one unfinished
    sentence and the parked chunks, each under its number, so a call touches what it reads and what
    it sets free, however many are parked; what one call reads is bounded by the micro-batch, which
    the source's rate option bounds. ``parked_most`` bounds the parked chunks that outlast a
    call, at the price of text: those farthest ahead come out at once as rows of kind
    ``dead_letter``, and the stream later goes on after them, or ends if one had ``eos``.

    Needs the RocksDB state store (``ordered.ROCKSDB``).
    """
    if mode not in ("text", "chunk"):
        raise ValueError("mode is 'text' or 'chunk'")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    chunks = chunks.filter("seq is not null").select("stream_id", "seq", "ts", "chunk", "eos", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"))
    # rows, not frames: most calls bring a few rows of one stream, and a frame for each costs more than the work
    return (chunks.withWatermark("ts", idle).groupBy("stream_id")
            .transformWithState(_Sentences(mode, idle_ms, parked_most), OUT_SCHEMA, "Append", "EventTime"))


def sanitize_stream(chunks: DataFrame, policy: Policy, mode: str = "text", idle: str = "10 minutes",
                    models: Models = Models(), parked_most: int | None = None) -> DataFrame:
    """Sentences with their verdict and ``emitted``, the text to show."""
    sentences = sentence_stream(chunks, mode, idle, parked_most)
    out = scan(sentences, policy, "sentence", "output", models)
    shown = emit_text(F.col("valid"), F.col("sanitized_text"), F.col("reason"))
    return out.withColumn("emitted", F.concat(shown, F.col("separator")))
