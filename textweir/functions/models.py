"""Calls of caller-supplied models: loaded once per task, no NULLs, one failing text does not fail its batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import score_message

#: What a failed text means: no finding, a finding of its own, or the end of the job.
ON_ERROR = ("open", "closed", "raise")


def call_each(model: Callable[[Sequence[str]], Sequence[Any]], texts: Sequence[str]) -> tuple[list[Any], list[str | None]]:
    """One result and one error for each text; a batch that fails is halved until the failing texts are alone.

    A model that returns another number of results than it got texts has failed.
    """
    if not texts:
        return [], []
    try:
        got = list(model(texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} results for {len(texts)} texts")
        return got, [None] * len(texts)
    except Exception as error:  # noqa: BLE001  any failure of foreign code
        if len(texts) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
    half = len(texts) // 2
    left, right = call_each(model, texts[:half]), call_each(model, texts[half:])
    return left[0] + right[0], left[1] + right[1]


def refilled(values: pa.Array, known: np.ndarray) -> pa.Array:
    """``values`` at the places of ``known``, NULL at the others."""
    place = np.where(known, np.cumsum(known) - 1, 0)
    return values.take(pa.array(place, mask=~known))


def model_result(text: Column, load: Callable[[], Callable[[Sequence[str]], Sequence[float]]]) -> Column:
    """``struct(score, error)`` from a model; both NULL for a NULL text, which never reaches it.

    A score that is no finite number is an error as well.
    """
    holder: dict[str, Callable] = {}

    @F.arrow_udf("struct<score: double, error: string>")
    def result(batch: pa.Array) -> pa.Array:
        if "model" not in holder:
            holder["model"] = load()

        def finite(texts: Sequence[str]) -> list[float]:
            scores = [float(s) for s in holder["model"](texts)]
            if not all(np.isfinite(scores)):
                raise ValueError("score is no finite number")
            return scores

        known = np.asarray(batch.is_valid())
        scores, errors = call_each(finite, batch.drop_null().to_pylist())
        return pa.StructArray.from_arrays([refilled(pa.array(scores, pa.float64()), known),
                                           refilled(pa.array(errors, pa.string()), known)], ["score", "error"])

    return result(text)


def failure(error: Column, message: Column, on_error: str | Column) -> Column:
    """What an error means: NULL (``open``), ``message`` (``closed``), or the end of the job (``raise``).

    ``on_error`` may be a column, so each row has its own rule; an unknown rule raises.
    """
    if isinstance(on_error, str):
        if on_error not in ON_ERROR:
            raise ValueError(f"on_error is one of {', '.join(ON_ERROR)}")
        on_error = F.lit(on_error)
    return F.when(error.isNotNull(), F.when(on_error == "open", F.lit(None).cast("string")).when(on_error == "closed", message)
                  .otherwise(F.raise_error(error).cast("string")))


def model_message(result: Column, threshold: float = 0.5, on_error: str | Column = "raise") -> Column:
    """The message of a score over the threshold; where the model failed, what ``on_error`` says."""
    failed = failure(result["error"], F.concat(F.lit("LangKit: scan failed ("), result["error"], F.lit(")")), on_error)
    return F.coalesce(failed, score_message(result["score"], threshold))
