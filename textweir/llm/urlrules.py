"""URL filters by a sorted sweep over reversed-host keys.

``www.example.net`` becomes ``net.example.www.``, so a rule for a host covers one interval of
the sorted keys: its host and all subdomains. URLs and rules are dealt into ranges of the key,
sorted in their range and swept once; a stack holds the rules of the hosts that enclose the
current one. Rules that began in earlier ranges are handed to every range they reach into.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold_case

#: Greater than every character of a host.
_LAST = "\U0010ffff"
#: Keys sampled to choose the ranges, which affect the balance but no verdict.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/ ? #``, A-Z folded; empty without ``://``."""
    return fold_case(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, a dot after each; empty for no host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Sweep:
    """Active rules while the keys rise: one stack entry for each enclosing host that has rules."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[tuple[str, str, str]]]] = []

    def rise(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, rule: tuple[str, str, str]) -> None:
        self.rise(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, []))
        self.stack[-1][1].append(rule)

    def best(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule text and verdict of the longest rule that fits; of equally long ones the more specific host, then the first by text."""
        self.rise(key)
        fits = [(-len(text), -len(at), text, verdict) for at, rules in self.stack for prefix, text, verdict in rules
                if path.startswith(prefix)]
        return min(fits)[2:] if fits else (None, None)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` has host, path (a prefix) and verdict. A rule fits its host and all subdomains if
    the path starts with its own; the longest fitting rule (host and path together) decides,
    of equals the one with the more specific host, then the smallest text and verdict.
    Without a fitting rule ``rule`` is null and ``verdict`` the ``default``. Null urls and urls without
    ``://`` have an empty host and path, which only a rule with an empty host could fit; rules
    with a null part are ignored. Repeated pages are judged each; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    rules = rules.select(host_key(fold_case(F.col("host"))).alias("key"), "path",
                         F.concat("host", "path").alias("text"), "verdict")
    edges = _edges(urls)
    urls = urls.withColumn("pid", _range(edges)("key", "path", "page_id"))
    # a rule's interval ends before the key with its last character raised
    rules = rules.withColumn("pid", F.explode(_ranges(edges)("key")))
    same = ["pid", "key", "kind", "page_id", "path", "text", "verdict", "host"]
    none = F.lit(None).cast("string")
    events = (urls.select("pid", "key", F.lit(1).alias("kind"), "page_id", "path", none.alias("text"),
                          none.alias("verdict"), "host")
              .unionByName(rules.select("pid", "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("page_id"),
                                        "path", "text", "verdict", none.alias("host"))).select(*same))
    parts = max(len(edges) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = events.repartition(parts, "pid").sortWithinPartitions("pid", "key", "kind", "text", "verdict")
    return dealt.mapInArrow(_swept_rows(default), "page_id bigint, host string, path string, rule string, verdict string")


def _swept_rows(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, pid = _Sweep(), None
        for batch in batches:
            out: list[tuple] = []
            for p, key, kind, page, path, text, verdict, host in zip(*(c.to_pylist() for c in batch.columns)):
                if p != pid:
                    sweep, pid = _Sweep(), p
                if kind == 0:
                    sweep.add(key, (path, text, verdict))
                else:
                    rule, said = sweep.best(key, path)
                    out.append((page, host, path, rule, default if said is None else said))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                names=["page_id", "host", "path", "rule", "verdict"])
    return run


def _edges(urls: DataFrame) -> list[tuple[str, str, int]]:
    """Upper edges of the ranges: quantiles of a sample of (key, path, page_id) of bounded size.

    The page_id is part of the key, so that one host or one page asked for by a third of all
    rows is many ranges.
    """
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = (urls.select("key", "path", "page_id").orderBy(F.xxhash64("page_id", "path")).limit(min(SAMPLE, 100 * parts)))
    got = sorted((r["key"], r["path"], r["page_id"] if r["page_id"] is not None else -1) for r in sample.toLocalIterator())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def _range(edges: list[tuple[str, str, int]]):
    @F.pandas_udf("int")
    def pid(key: pd.Series, path: pd.Series, page: pd.Series) -> pd.Series:
        page = page.fillna(-1).astype(np.int64)
        return pd.Series([bisect_right(edges, e) for e in zip(key, path, page)], dtype="int32")
    return pid


def _ranges(edges: list[tuple[str, str, int]]):
    heads = [e[0] for e in edges]

    @F.pandas_udf("array<int>")
    def pids(key: pd.Series) -> pd.Series:
        out = []
        for k in key:
            low = bisect_left(edges, (k, "", -1))
            high = bisect_left(heads, k + _LAST) if k else len(edges)
            out.append(list(range(low, max(low, high) + 1)))
        return pd.Series(out)
    return pids
