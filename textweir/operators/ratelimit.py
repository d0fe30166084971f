"""Sliding-log rate limiting of a request log, and its naive upper bound.

The limiter admits a request if fewer than N *admitted* requests are younger than
W; rejected ones do not count. That is sequential per client, so time is cut into
slots and only the stretches that can reject anything are replayed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checked_broadcast, materialize

SLOTS_PER_WINDOW = 8
GROUP_ROWS = 20_000_000  # most requests of one client replayed by one task in one go


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def client_key(client: str) -> Column:
    """Requests without a client count as one client."""
    return F.coalesce(F.col(client).cast("string"), F.lit("unknown"))


def admit(times: np.ndarray, max_requests: int, window_us: int, state: list[int] | None = None) -> np.ndarray:
    """Which of the ascending ``times`` are admitted, given the admitted ``state``.

    Runs once per admission: when the log is full it jumps to the next time at
    which its oldest entry is expired (age exactly W counts as expired).
    """
    log = deque(state or [])
    out = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        now = int(times[i])
        while log and now - log[0] >= window_us:
            log.popleft()
        if len(log) < max_requests:
            out[i] = True
            log.append(now)
            i += 1
        elif not log:  # a limit of zero
            break
        else:
            i += int(np.searchsorted(times[i:], log[0] + window_us, side="left"))
    return out


def request_rate(df: DataFrame, client: str, ts: str, window_seconds: float) -> DataFrame:
    """``df`` plus ``rate``: all requests of the client younger than W, this one included.

    A request counts +1 at its time and -1 when it expires; the rate is the running
    sum. Sums per time slot carry the total over, so no window holds more than one
    client's requests of one short slot. A request without a time has a NULL rate and is
    in no other's.
    """
    timeless = df.filter(F.col(ts).isNull()).withColumn("rate", F.lit(None).cast("bigint"))
    df = df.filter(F.col(ts).isNotNull())
    us = int(window_seconds * 1e6)
    slot_us = us // gcd(us, 64)  # slots divide the window, so a whole slot expires at once
    columns = df.columns
    arrive = df.withColumns({"__c": client_key(client), "__us": micros(F.col(ts)), "__d": F.lit(1)})
    slot = (F.col("__us") - F.pmod("__us", F.lit(slot_us))).alias("__slot")
    arrived = arrive.groupBy("__c", slot).agg(F.count(F.lit(1)).alias("__n"))
    moves = arrived.unionByName(arrived.select("__c", (F.col("__slot") + us).alias("__slot"), (-F.col("__n")).alias("__n")))
    before = Window.partitionBy("__c").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (moves.groupBy("__c", "__slot").agg(F.sum("__n").alias("__n"))
               .select("__c", "__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__carry")))

    expire = arrive.select("__c", (F.col("__us") + us).alias("__us"), F.lit(-1).alias("__d"))
    both = arrive.unionByName(expire, allowMissingColumns=True).withColumn("__slot", slot)
    within = Window.partitionBy("__c", "__slot").orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("__run", F.sum("__d").over(within))
            .filter("__d = 1").join(carried, ["__c", "__slot"])
            .select(*columns, (F.col("__run") + F.col("__carry")).alias("rate"))
            .unionByName(timeless))


def _slots(df: DataFrame, max_requests: int, us: int, slot_us: int, group_rows: int) -> DataFrame:
    """Per client and slot: ``__run`` (the stretch to replay it in, else NULL) and ``__seg``.

    A slot is *calm* if it and the W before it hold at most N requests: all of
    them are admitted whatever came before. A stretch starts at a slot that is
    not calm with only calm ones in the W before it; those calm slots, whose
    requests make up the limiter's state, are replayed along with it.
    """
    reach = us if us % slot_us == 0 else us + slot_us  # slots that the W before a slot touches
    by_time = Window.partitionBy("__c").orderBy("__slot")
    slots = df.groupBy("__c", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    busy = F.when(F.sum("__n").over(by_time.rangeBetween(-reach, 0)) > max_requests, 1).otherwise(0)
    slots = slots.withColumn("__busy", busy)
    busy_before = F.coalesce(F.max("__busy").over(by_time.rangeBetween(-reach, -1)), F.lit(0))
    start = (F.col("__busy") == 1) & (busy_before == 0)
    slots = slots.withColumn("__start", F.when(start, F.col("__slot")))
    running = by_time.rowsBetween(Window.unboundedPreceding, 0)
    busy_run = F.when(F.col("__busy") == 1, F.max("__start").over(running))
    slots = slots.withColumn("__busy_run", busy_run)
    ahead = by_time.rangeBetween(1, reach)
    run = F.coalesce("__busy_run", F.first("__busy_run", ignorenulls=True).over(ahead))
    slots = slots.withColumn("__run", run)
    in_run = Window.partitionBy("__c", "__run").orderBy("__slot")
    seen = F.coalesce(F.sum("__n").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("__seg", F.when(F.col("__run").isNotNull(), F.floor(seen / group_rows)))
    dense = F.dense_rank().over(Window.partitionBy("__c", "__run").orderBy("__seg")) - 1
    return slots.select("__c", "__slot", "__run", F.when(F.col("__run").isNotNull(), dense).alias("__seg"))


def _suspects(df: DataFrame, max_requests: int, us: int) -> DataFrame:
    """Clients that may ever be limited. With at most N/2 requests in every aligned
    window, no W holds more than N; nearly all clients are ruled out so, by two
    partial aggregations."""
    window = (F.col("__us") - F.pmod("__us", F.lit(us))).alias("__w")
    most = df.groupBy("__c", window).agg(F.count(F.lit(1)).alias("__n")).groupBy("__c").agg(F.max("__n").alias("__n"))
    return most.filter(F.col("__n") * 2 > max_requests).select("__c")


def _replay(max_requests: int, us: int):
    """``mapInArrow`` body over rows sorted by client, stretch, time and order.

    Stretches stream through, batch by batch; only the log of the current one is
    kept. ``__seed`` rows fill the log and are not passed on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = None, []
        for batch in batches:
            if not len(batch):
                continue
            times = batch.column("__us").to_numpy(zero_copy_only=False)
            runs = batch.column("__run").to_numpy(zero_copy_only=False)
            seeds = batch.column("__seed").to_numpy(zero_copy_only=False)
            who = batch.column("__c")
            codes = who.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((codes[1:] != codes[:-1]) | (runs[1:] != runs[:-1])) + 1
            out = np.zeros(len(batch), dtype=bool)
            for start, end in zip([0, *turns], [*turns, len(batch)]):
                this = (who[start].as_py(), runs[start])
                if this != key:
                    key, log = this, []
                first = start + int(np.count_nonzero(seeds[start:end]))  # seeds are older, so they lead
                log += times[start:first].tolist()
                if first < end:
                    out[first:end] = admit(times[first:end], max_requests, us, log)
                    log += times[first:end][out[first:end]].tolist()
                    log = log[-max_requests:]
            table = batch.drop_columns(["__seed"]).append_column("admitted", pa.array(out))
            yield table.filter(pa.array(~seeds))

    return run


def rate_limit(df: DataFrame, client: str, ts: str, order: str, max_requests: int = 60,
               window_seconds: float = 60, path: str | None = None,
               group_rows: int = GROUP_ROWS, slots_per_window: int = SLOTS_PER_WINDOW) -> DataFrame:
    """``df`` plus ``admitted``. Equal times are taken in ``order``.

    With ``path``, requests outside ``/v1/`` pass uncounted. Stretches of at most
    ``group_rows`` requests are replayed in one pass; longer ones in rounds, each
    starting from the requests that were still in the log when the round before
    ended (at most N), so no task replays more than about ``group_rows`` of one
    client's requests at a time. A request without a time is in no window: it passes
    uncounted.
    """
    us = int(window_seconds * 1e6)
    slot_us = max(us // slots_per_window, 1)
    columns = df.columns
    timeless, df = df.filter(F.col(ts).isNull()), df.filter(F.col(ts).isNotNull())
    timed = df.withColumns({"__c": client_key(client), "__us": micros(F.col(ts))})
    timed = timed.withColumn("__slot", F.col("__us") - F.pmod("__us", F.lit(slot_us)))
    counted = timed if path is None else timed.filter(F.col(path).startswith("/v1/"))

    # small tables that are read several times
    suspects = checked_broadcast(materialize(_suspects(counted, max_requests, us), "suspects"))
    free = counted.join(suspects, "__c", "left_anti")
    counted = counted.join(suspects, "__c", "left_semi")
    slots = materialize(_slots(counted, max_requests, us, slot_us, group_rows), "slots")
    rounds = slots.agg(F.max("__seg")).first()[0]  # one number
    placed = counted.join(slots, ["__c", "__slot"])

    result = free.select(*columns).unionByName(placed.filter(F.col("__run").isNull()).select(*columns))
    if path is not None:
        result = result.unionByName(timed.filter(~F.coalesce(F.col(path).startswith("/v1/"), F.lit(False))).select(*columns))
    result = result.unionByName(timeless).withColumn("admitted", F.lit(True))
    if rounds is None:
        return result

    keys = ["__c", "__run"]
    busy = placed.filter(F.col("__run").isNotNull()).withColumn("__seed", F.lit(False))
    busy = busy.select(*columns, "__c", "__us", "__run", "__seg", "__seed")
    if rounds:  # read once for each round, by round
        busy = materialize(busy, "busy", "__seg")
    out_schema = T.StructType([*busy.drop("__seg", "__seed").schema.fields, T.StructField("admitted", T.BooleanType())])

    def replay(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "__us", F.desc("__seed"), order)
        return ordered.mapInArrow(_replay(max_requests, us), out_schema)

    done = replay(busy.filter("__seg = 0").drop("__seg"))
    if rounds == 0:
        return result.unionByName(done.select(*columns, "admitted"))

    # rounds build on one another, so each is cut off from its lineage
    done = materialize(done, "round")
    result = result.unionByName(done.select(*columns, "admitted"))
    log = done.filter("admitted").select(*keys, "__us")
    for seg in range(1, rounds + 1):
        # found by an aggregate, so that no long round is gathered for it
        ends = done.groupBy(*keys).agg(F.max("__us").alias("__end"))
        log = log.join(ends, keys).filter(F.col("__us") > F.col("__end") - us).select(*keys, "__us")
        log = materialize(log, "log")
        rows = busy.filter(F.col("__seg") == seg).drop("__seg")
        seeds = log.withColumn("__seed", F.lit(True))
        done = materialize(replay(rows.unionByName(seeds, allowMissingColumns=True)), "round")
        result = result.unionByName(done.select(*columns, "admitted"))
        log = log.union(done.filter("admitted").select(*keys, "__us"))
    return result

