"""Entity spans from patterns, word lists and a caller's recognizer, resolved in one pass.

Matches are found by the JVM, as lengths of the gaps before them and of the matches; only
texts that hold one go on to Python, where an interval sweep gives every character that some
span covers to the best of them, and the text is rewritten once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import EntityRule, entity_rules
from .models import call_each, failure, refilled
from .redaction import GUARDS

# --- fixed values: scores of the kinds (checksums and patterns; lists) ----------
SCORES = {
    "EMAIL_ADDRESS": 1.0,
    "CREDIT_CARD": 1.0,
    "IBAN_CODE": 1.0,
    "US_SSN": 0.85,
    "PHONE_NUMBER": 0.4,
    "PERSON": 0.85,
    "LOCATION": 0.85,
}

Span = tuple[int, int, str, float]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
#: Texts, and their bytes, of which Python objects are held at a time; a longer text is alone.
_ROWS, _BYTES = 256, 1 << 22


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """``(start, number)`` of runs of at most ``_ROWS`` texts of ``_BYTES`` in all; one run if there are no texts."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (i - start >= _ROWS or held + size > _BYTES):
            yield start, i - start
            start, held = i, 0
        held += size
    yield start, len(texts) - start


@dataclass(frozen=True)
class Recognizer:
    """A model for entities: ``load()`` gives a callable from texts to their spans.

    A span is (start, end, kind, score) in code points; ``kinds`` are those it may return. A text
    on which it fails has no spans (``on_error`` 'open'), is redacted as a whole ('closed'), or
    ends the job ('raise').
    """

    load: Callable[[], Callable[[Sequence[str]], Sequence[Iterable[Span]]]]
    kinds: tuple[str, ...] = ("PERSON", "LOCATION")
    on_error: str = "raise"

    def find(self, text: Column) -> Column:
        """``struct(spans, error)`` of each text; spans outside the text, empty, or of other kinds are errors."""
        holder: dict[str, Callable] = {}

        def checked(texts: Sequence[str]) -> list[list[dict]]:
            out = []
            for t, spans in zip(texts, holder["model"](texts), strict=True):
                rows = [(int(s), int(e), str(k), float(p)) for s, e, k, p in spans]
                if any(not 0 <= s < e <= len(t) or k not in self.kinds or not np.isfinite(p) for s, e, k, p in rows):
                    raise ValueError("span outside the text or of an unknown kind")
                out.append([dict(zip(("start", "end", "kind", "score"), r)) for r in rows])
            return out

        @F.arrow_udf("struct<spans: array<struct<start: int, end: int, kind: string, score: double>>, error: string>")
        def find(batch: pa.Array) -> pa.Array:
            if "model" not in holder:
                holder["model"] = self.load()
            out = []
            for start, n in pieces(batch):
                texts = batch.slice(start, n)
                known = np.asarray(texts.is_valid())
                spans, errors = call_each(checked, texts.drop_null().to_pylist())
                out.append(pa.StructArray.from_arrays([refilled(pa.array(spans, _SPANS), known),
                                                       refilled(pa.array(errors, pa.string()), known)], ["spans", "error"]))
            return pa.concat_arrays(out)

        return find(text)


def sweep(spans: Sequence[Span]) -> list[Span]:
    """Disjoint runs (start, end, kind, score) in order: every position that a span covers, with the best span there.

    Best is the higher score, then the longer span, then the earlier start, then the first listed.
    """
    order = sorted(range(len(spans)), key=lambda i: spans[i][0])
    edges = sorted({p for s in spans for p in s[:2]})
    live: list[tuple[float, int, int, int]] = []
    out: list[list] = []
    owner, at = -1, 0
    for here, after in zip(edges, edges[1:]):
        while at < len(order) and spans[order[at]][0] <= here:
            i = order[at]
            start, end, _, score = spans[i]
            heapq.heappush(live, (-score, start - end, start, i))
            at += 1
        while live and spans[live[0][3]][1] <= here:
            heapq.heappop(live)
        best = live[0][3] if live else -1
        if best >= 0:
            if best == owner:
                out[-1][1] = after
            else:
                out.append([here, after, *spans[best][2:]])
        owner = best
    return [tuple(s) for s in out]


def _matches(text: Column, regex: str, valid: Callable[[Column], Column] | None) -> Column:
    """``(gap, size, ok)`` of each match; a rule without a checksum accepts all."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits))
    return F.zip_with(gaps, hits, lambda g, h: F.struct(
        F.char_length(g).alias("gap"), F.char_length(h).alias("size"), (F.lit(True) if valid is None else valid(h)).alias("ok")))


def rule_matches(text: Column, rules: Sequence[EntityRule]) -> Column:
    """The matches of each rule, NULL for a text in which none is accepted."""
    none = F.array().cast("array<struct<gap: int, size: int, ok: boolean>>")
    listed = [F.when((F.lit(True) if r.guard is None else GUARDS[r.guard](text)) & text.rlike(r.regex),
                     _matches(text, r.regex, r.valid)).otherwise(none) for r in rules]
    if not listed:
        return F.lit(None).cast("array<array<struct<gap: int, size: int, ok: boolean>>>")
    accepted = F.filter(F.array(F.array(*listed)), lambda rules_: F.exists(rules_, lambda m: F.exists(m, lambda x: x["ok"])))
    return F.get(accepted, F.lit(0))


def no_spans() -> Column:
    """The result of a recognizer that finds nothing."""
    return F.lit(None).cast("struct<spans: array<struct<start: int, end: int, kind: string, score: double>>, error: string>")


def rewritten(text: Column, rules: Sequence[EntityRule], matches: Column, found: Column, on_error: str = "raise") -> Column:
    """``struct(text, kinds)``: the text with each resolved run replaced by ``<KIND_REDACTED>``, and the kinds found.

    ``matches`` are those of the rules, ``found`` is the result of a recognizer. What several spans cover goes to the
    best one; what is left of the others is replaced under their own name, so nothing that was found
    stays. ``kinds`` are all kinds found, in the order of the rules, then those of the recognizer. NULL for
    texts without a span. With ``on_error`` 'closed', a text on which the recognizer failed is one span of kind TEXT.
    """
    names = [r.name for r in rules]
    scores = [SCORES.get(n, 0.85) for n in names]

    kind = pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))])

    def rewritten_rows(*columns: pa.Array) -> list[dict | None]:
        out = []
        for t, per_rule, listed, broken in zip(*(c.to_pylist() for c in columns)):
            if t is None:
                out.append(None)
                continue
            if broken:
                out.append({"text": "<TEXT_REDACTED>", "kinds": ["TEXT"]})
                continue
            spans: list[Span] = []
            for name, score, rows in zip(names, scores, per_rule or ()):
                at = 0
                for m in rows:
                    at += m["gap"]
                    if m["ok"]:
                        spans.append((at, at + m["size"], name, score))
                    at += m["size"]
            spans += [(s["start"], s["end"], s["kind"], s["score"]) for s in listed or ()]
            parts, at = [], 0
            for start, end, kind, _ in sweep(spans):
                parts += [t[at:start], f"<{kind}_REDACTED>"]
                at = end
            out.append({"text": "".join(parts) + t[at:], "kinds": list(dict.fromkeys(s[2] for s in spans))})
        return out

    @F.arrow_udf("struct<text: string, kinds: array<string>>")
    def rewrite(texts: pa.Array, found_: pa.Array, more: pa.Array, failed: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(rewritten_rows(*(c.slice(start, n) for c in (texts, found_, more, failed))), kind)
                                 for start, n in pieces(texts)])

    stops = failure(found["error"], F.lit("closed"), on_error)  # NULL, or 'closed', or the end of the job
    broken = F.coalesce(stops == "closed", F.lit(False))
    some = matches.isNotNull() | (F.coalesce(F.size(found["spans"]), F.lit(0)) > 0) | broken
    # a Python function is given every row: those without a span as NULL
    return rewrite(F.when(some, text), matches, found["spans"], broken)


def span_rules(persons: Iterable[str] = (), locations: Iterable[str] = ()) -> list[EntityRule]:
    """The rules of ``entity_rules``; here their order only breaks ties."""
    return entity_rules(persons, locations)
