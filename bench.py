"""Times the headline queries; prints one JSON line.

Every query runs to the end into a discarding sink (all rows, all columns); the
better of two runs counts. ``value`` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import warnings
from pathlib import Path

from textweir.plans import all_queries
from textweir.session import local_session

HEADLINE = (
    "scan", "scan_default", "pii_redact_strict", "pii_redact_loose", "pii_redact_entities",
    "topic_flag", "injection_flag", "profanity_redact", "external_guard", "sanitize_corpus_drop",
    "multi_policy_scan", "large_blocklist_match", "semantic_top1", "conversation_gate",
    "conversation_gate_turns", "last_user_message", "payload_messages_api", "sentence_split",
    "sanitize_sentences", "sanitize_by_sentence", "stream_sanitize", "rate_limit_batch",
    "request_rate", "rate_limit_stream", "audit_counts", "rule_frequency", "audit_latest",
    "compliance_summary", "audit_stream",
)


def in_pieces(spark, sf_dir: str, pieces: int) -> str:
    """The tables again, each in several files: one small file would be read by one core."""
    out = tempfile.mkdtemp(prefix="bench-")
    for table in Path(sf_dir).glob("*.parquet"):
        spark.read.parquet(str(table)).repartition(pieces).write.parquet(f"{out}/{table.name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    warnings.simplefilter("ignore")
    spark = local_session(cpus, memory="16g", app="bench")
    queries = all_queries()
    times: dict[str, float] = {}
    source, sf_dir = sf_dir, in_pieces(spark, sf_dir, cpus)
    # start the Python workers' parent and compile the hot paths outside the clock
    queries["scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name:28s} {best:7.3f}", file=sys.stderr, flush=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "count(1) AS n", "sum(octet_length(text)) AS b").first()
    rates = {}
    if "scan" in times:
        rates = {"scan_docs_per_sec": round(docs["n"] / times["scan"]),
                 "scan_mb_per_sec": round(docs["b"] / times["scan"] / 1e6, 1)}
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(source.rstrip("/")),
                      "cpus": cpus, **rates}))


if __name__ == "__main__":
    main()
