"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's pattern is turned into a Boolean query of trigrams that every match must
hold (letters folded to lower case). The index lists, for each trigram of these queries, the
documents that have it, in posting lists of at most ``BLOCK`` ids. Intersecting the lists
gives the candidates of a rule; only their texts are verified with the pattern. A rule
without mandatory trigrams is verified on every text.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold_case, saved

#: Ids to a posting list: a trigram that a third of all documents have is many lists.
BLOCK = 4096
#: Strings that one part of a pattern may stand for before it counts as "anything".
MOST_STRINGS = 48


class Rule(NamedTuple):
    """``pattern`` in the syntax that Java and Python share; group ``value`` must have ``least`` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published formats of credentials, found besides the base kinds.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)


def _exact(items: list) -> set[str] | None:
    """All strings that a sequence stands for, folded; None if there are too many."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            some = {chr(arg).lower()}
        elif op is sre.IN:
            some = set()
            for kind, value in arg:
                low, high = (value, value) if kind is sre.LITERAL else value if kind is sre.RANGE else (0, 0x10FFFF)
                if high - low > MOST_STRINGS:
                    return None
                some |= {chr(c).lower() for c in range(low, high + 1)}
        elif op is sre.SUBPATTERN:
            some = _exact(list(arg[3]))
        elif op is sre.BRANCH:
            parts = [_exact(list(branch)) for branch in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[1] <= 2 and (one := _exact(list(arg[2]))) is not None:
            some = {"".join(c) for n in range(arg[0], arg[1] + 1) for c in itertools.product(sorted(one), repeat=n)}
        else:
            some = None
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in some}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams, of which every match has one set whole; empty if nothing is mandatory.

    Runs of the pattern that stand for few strings each demand the trigrams of one of these
    strings; the run with the fewest, longest strings is taken.
    """
    items = list(parser.parse(pattern))
    best: list[frozenset[str]] = []
    for first in range(len(items)):
        for last in range(first + 1, len(items) + 1):
            strings = _exact(items[first:last])
            if strings is None:
                break
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
            if frozenset() not in sets and (not best or min(map(len, sets)) > min(map(len, best))):
                best = sorted(sets, key=sorted)
    return best


def _having(value: Column, make) -> Column:
    """``make(v)`` with ``value`` computed once, however often ``make`` uses it."""
    return F.transform(F.array(value), make)[0]


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The index: (gram, block, ids), sorted distinct ids of one block of the doc_id range."""
    grams = sorted({g for rule in rules for clause in trigram_query(rule.pattern) for g in clause})
    vocabulary = F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>")
    present = _having(fold_case(F.col("text")), lambda t: F.filter(vocabulary, lambda g: F.contains(t, g)))
    return (docs.filter("doc_id is not null").select("doc_id", F.explode(present).alias("gram"))
            .groupBy("gram", F.expr(f"doc_id div {BLOCK}").alias("block"))
            .agg(F.sort_array(F.collect_set("doc_id")).alias("ids")))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the documents that meet a clause of a rule's trigram query."""
    clauses = [(rule.kind, i, gram, len(clause)) for rule in rules
               for i, clause in enumerate(trigram_query(rule.pattern)) for gram in sorted(clause)]
    asked = index.sparkSession.createDataFrame(clauses, "kind string, clause int, gram string, need int")
    lists = index.join(F.broadcast(asked), "gram")  # the rules' own trigrams
    met = (lists.groupBy("kind", "clause", "block").agg(F.collect_list("ids").alias("lists"), F.first("need").alias("need"))
           .filter("size(lists) = need"))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], F.array_intersect)
    return (met.select("kind", F.explode(both).alias("doc_id")).distinct()
            .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, end, kind), in code points: matches and the gaps between them add up to the text."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.value)).alias("value"))
    empty = F.lit(None).cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.coalesce(F.char_length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        good = part["hit"].isNotNull() & (F.char_length(part["value"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], F.array(span)))
                        .otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast(
        "array<struct<start:int,rank:int,end:int,kind:string>>")).alias("out"))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, spans (array of start, rank, end, kind).

    ``start`` and ``end`` (exclusive) count code points; matches of one kind are leftmost and do
    not overlap, spans are ordered by start, then by the order of the rules. Null and empty
    texts have no spans. Rows that repeat a doc_id are verified for what any of them shows
    in the index; rows without a doc_id cannot be listed and are verified by every rule.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = saved(posting_lists(docs, rules), "postings")
    asked = saved(candidates(index, rules), "candidates")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = []
    for order, rule in enumerate(rules):
        due = F.col("text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            due = (F.array_contains("kinds", rule.kind) | F.col("doc_id").isNull()) & due
        found.append(F.when(due, _spans(F.col("text"), rule, order)).otherwise(empty))
    return (docs.join(asked, "doc_id", "left")
            .select("doc_id", F.array_sort(F.flatten(F.array(*found))).alias("spans")))
