"""The live limiter in event-time order, on state that is read and written piece by piece.

Needs the RocksDB state store (``ROCKSDB``), as every query with ``transformWithState`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ratelimit import admit, client_key, micros

#: The setting of a session whose streams keep such state.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class _Limiter(StatefulProcessor):
    """Requests wait in slots of time until the watermark has passed their slot; then a slot is decided in order."""

    def __init__(self, columns: list[str], order: str, most: int, window_us: int, slot_us: int):
        self.columns, self.order, self.most, self.window_us, self.slot_us = columns, order, most, window_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "times array<bigint>")  # of admitted requests, the most at most
        self.parts = handle.getMapState("parts", "slot bigint", "n bigint")  # pieces of each waiting slot
        self.rows = handle.getMapState("rows", "slot bigint, n bigint", "data binary")

    def _times(self) -> list[int]:
        return list(self.log.get()[0]) if self.log.exists() else []

    def _decide(self, rows: pd.DataFrame, log: list[int]) -> tuple[pd.DataFrame, list[int]]:
        rows = rows.sort_values(["__us", self.order], kind="stable")
        times = rows["__us"].to_numpy()
        ok = admit(times, self.most, self.window_us, log)
        rows["admitted"] = ok
        log = [t for t in [*log, *times[ok].tolist()] if int(times[-1]) - t < self.window_us][-self.most:] if self.most else []
        return rows[[*self.columns, "admitted"]], log

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        for piece in rows:
            piece.columns = [*self.columns, "__c", "__us"]  # rows come as tuples, whose fields cannot have every name
            for slot, part in piece.groupby(piece["__us"] // self.slot_us):
                end = (int(slot) + 1) * self.slot_us
                if end <= passed:  # its slot is decided: judged by the state as it is
                    out, log = self._decide(part.copy(), self._times())
                    self.log.update((log,))
                    yield out
                    continue
                slot = (int(slot),)
                n = self.parts.getValue(slot)[0] if self.parts.containsKey(slot) else 0
                self.rows.updateValue((slot[0], n), (_packed(part),))
                self.parts.updateValue(slot, (n + 1,))
                if not n:
                    self.handle.registerTimer(-(-end // 1_000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1_000
        log = self._times()
        for slot in sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.slot_us <= due):
            names = [(slot, n) for n in range(self.parts.getValue((slot,))[0])]
            rows = pd.concat([_unpacked(self.rows.getValue(n)[0]) for n in names])  # the requests of one slot
            for n in names:
                self.rows.removeKey(n)
            self.parts.removeKey((slot,))
            out, log = self._decide(rows, log)
            self.log.update((log,))
            self.handle.registerTimer(-(-((slot + 1) * self.slot_us + self.window_us) // 1_000))
            yield out
        # silent for a window: forgotten, unless requests wait, which may be older than the timer
        if log and due >= log[-1] + self.window_us and not any(True for _ in self.parts.keys()):
            self.log.clear()

    def close(self) -> None:
        pass


def rate_limit_in_order(requests: DataFrame, client: str, ts: str, order: str, max_requests: int = 60, window_seconds: float = 60,
                        late: str = "10 seconds", path: str | None = None, slot_seconds: float = 1.0) -> DataFrame:
    """A stream of ``requests`` plus ``admitted``, decided in the order of (time, order) over all micro-batches.

    A request is decided once the watermark (``late`` behind the newest request) has passed its slot
    of ``slot_seconds``, so one that arrives late, but not later than that, is decided at its place; the last
    ones of a stream wait for a later request. With ``path``, requests outside ``/v1/`` pass
    uncounted. Requests without a time are dropped by the watermark; requests without a client are one client.

    State per client: its admitted times of the last W (at most N), and the waiting requests by slot, as Arrow
    pieces that are written once and read once. A task holds one slot of one client at a time.
    """
    columns = requests.columns
    schema = T.StructType([*requests.schema.fields, T.StructField("admitted", T.BooleanType())])
    timed = requests.withWatermark(ts, late).withColumns({"__c": client_key(client), "__us": micros(F.col(ts))})
    limited = F.lit(True) if path is None else F.coalesce(F.col(path).startswith("/v1/"), F.lit(False))
    processor = _Limiter(columns, order, max_requests, int(window_seconds * 1e6), int(slot_seconds * 1e6))
    judged = timed.filter(limited).groupBy("__c").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    if path is None:
        return judged
    return judged.unionByName(timed.filter(~limited).select(*columns, F.lit(True).alias("admitted")))
