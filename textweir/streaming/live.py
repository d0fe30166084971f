"""Live rate limiting, audit streams, windowed counts and policy hot swap."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import audit_events, new_audit_rows
from ..operators.ratelimit import admit, micros
from ..operators.scan import Models, scan
from ..policy import Policy


def rate_limit_stream(requests: DataFrame, client: str, ts: str, order: str, max_requests: int = 60,
                      window_seconds: int = 60, late: str = "10 seconds", path: str | None = None) -> DataFrame:
    """``requests`` plus ``admitted``, decided in (time, order) within a micro-batch.

    With ``path``, requests outside ``/v1/`` pass uncounted. A micro-batch's requests of one
    client are ordered in one task; the source's rate option bounds them.

    State per client: its admitted times of the last W, at most N of them. Requests
    that come after later ones were decided are judged by the state as it then is.
    A client silent for W is forgotten.
    """
    us = window_seconds * 1_000_000
    columns = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        # ordering needs the client's requests of this micro-batch, and only those
        rows = pd.concat(list(batches)).sort_values(["__us", order], kind="stable")
        times = rows["__us"].to_numpy()
        rows["admitted"] = admit(times, max_requests, us, log)
        last = int(times[-1])
        log = [t for t in [*log, *times[rows["admitted"].to_numpy()].tolist()] if last - t < us]
        state.update((log[-max_requests:],))
        state.setTimeoutTimestamp(max((last + us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[[*columns, "admitted"]]

    timed = requests.withWatermark(ts, late).withColumn("__us", micros(F.col(ts)))
    limited = F.lit(True) if path is None else F.coalesce(F.col(path).startswith("/v1/"), F.lit(False))
    judged = timed.filter(limited).groupBy(client).applyInPandasWithState(
        step, schema, "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    if path is None:
        return judged
    return judged.unionByName(timed.filter(~limited).select(*columns, F.lit(True).alias("admitted")))


def audit_batch(policy_source: Callable[[], Policy], sinks: Sequence[Callable[[DataFrame, int], None]],
                text_col: str = "text", source: str = "input", keys: tuple[str, ...] = (),
                models: Models = Models()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: scan once, hand verdicts and audit rows to the sinks.

    ``policy_source`` is asked for every micro-batch, so a replaced policy takes
    effect at the next one without a restart. Each sink gets the batch id with the
    rows, to replace its own output when a batch is retried.
    """
    verdict_sink, *audit_sinks = sinks

    def run(batch: DataFrame, batch_id: int) -> None:
        policy = policy_source()
        scanned = scan(batch, policy, text_col, source, models).withColumn("policy", F.lit(policy.name))
        scanned = scanned.persist()
        try:
            verdict_sink(scanned, batch_id)
            events = audit_events(scanned, policy, source, text_col, keys)
            for sink in audit_sinks:
                sink(events, batch_id)
        finally:
            scanned.unpersist()

    return run


def batch_parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per micro-batch; a retried batch overwrites its own folder."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def audit_tumbling(events: DataFrame, time_col: str = "timestamp", window: str = "1 minute",
                   late: str = "5 minutes") -> DataFrame:
    """Counts per tumbling window and action; rows later than the watermark are dropped."""
    return (events.withWatermark(time_col, late)
            .groupBy(F.window(time_col, window).alias("w"), "action")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "action", "n"))


def follow_audit(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of an audit table (``schema`` with its batch_id) as a stream, with ``notice`` as in ``new_audit_rows``.

    The checkpoint of the query that reads it is the mark: every row comes once, whether it was
    there when the query first ran or came with a later batch.
    """
    return new_audit_rows(spark.readStream.schema(schema).parquet(path), None)
