"""Sinks: audit files, console lines, audit tables, result and report files.

A sink is called with the rows and a batch id, which a stream's ``foreachBatch``
hands over and a batch job may leave out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import console_line
from ..operators.compliance import compliance_summary, report_details
from ..session import materialize

Sink = Callable[..., None]


def _batch_folder(path: str, batch_id: int | None) -> tuple[str, str]:
    """Where a batch goes, and how: with an id it replaces what an earlier try of it wrote."""
    return (path, "append") if batch_id is None else (f"{path}/batch_id={batch_id}", "overwrite")


def jsonl_sink(path: str) -> Sink:
    """Append events as JSON lines, NULL fields included, times in ISO form with ``Z``."""
    def write(events: DataFrame, batch_id: int | None = None) -> None:
        folder, mode = _batch_folder(path, batch_id)
        (events.write.mode(mode).option("ignoreNullFields", "false").option("timeZone", "UTC")
         .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder))
    return write


def console_sink(show: Callable[[str], None] = print) -> Sink:
    """Print the audit line of every row on the executor that has it; nothing goes through the driver."""
    def lines(rows) -> None:
        for row in rows:
            show(row["line"])

    def write(events: DataFrame, batch_id: int | None = None) -> None:
        events.select(console_line().alias("line")).foreachPartition(lines)
    return write


def null_sink() -> Sink:
    """Run the plan and discard its rows."""
    def write(events: DataFrame, batch_id: int | None = None) -> None:
        events.write.format("noop").mode("overwrite").save()
    return write


def table_sink(path: str, time_col: str = "timestamp") -> Sink:
    """Append gateway audit rows to a Parquet table, one folder for each batch.

    Rows are numbered within a batch, so ``(batch_id, id)`` orders them by arrival. Every batch
    needs an id of its own; one that is retried, on whatever day, replaces its own files.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        folder, mode = _batch_folder(path, batch_id)
        (rows.withColumns({"id": F.monotonically_increasing_id(), "date": F.to_date(time_col)})
         .write.mode(mode).parquet(folder))
    return write


def result_json(valid: Column, action: Column, reason: Column, text: Column) -> Column:
    return F.to_json(F.struct(valid.alias("valid"), action.alias("action"), reason.alias("reason"),
                              text.alias("sanitized_text")), {"ignoreNullFields": "false"})


def result_json_sink(path: str) -> Sink:
    def write(scanned: DataFrame, batch_id: int | None = None) -> None:
        folder, mode = _batch_folder(path, batch_id)
        cols = [F.col(c) for c in ("valid", "action", "reason", "sanitized_text")]
        scanned.select(result_json(*cols).alias("value")).write.mode(mode).text(folder)
    return write


def compliance_report_sink(path: str, keys: tuple[str, ...] = ()) -> Sink:
    """``summary`` (one row) and ``details`` (a row per prompt that was sent) below ``path``.

    The prompts are scanned once: verdicts are stored, and both parts are written from them.
    """
    def write(details: DataFrame, batch_id: int | None = None) -> None:
        folder = path if batch_id is None else f"{path}/batch_id={batch_id}"
        stored = materialize(details, "report")
        report_details(stored, keys=keys).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/details")
        (compliance_summary(stored).withColumn("timestamp", F.current_timestamp())
         .write.mode("overwrite").json(f"{folder}/summary"))
    return write
