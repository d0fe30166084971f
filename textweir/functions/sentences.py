"""Sentence segmentation: cut after ``.?!`` that white space or the end follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import java_regex

# One sentence with its separator, or the unfinished rest of the text.
_PIECE = "(?s)(?:" + java_regex(r".*?[.?!](?:\s+|\Z)") + r"|.+\z)"
# Splits one piece; the rest of a text (no final .?!) has an empty separator.
_PARTS = "(?s)^(.*?)(" + java_regex(r"(?<=[.?!])\s+") + r")?\z"


def sentence_pieces(text: Column) -> Column:
    """Array of sentences with separators kept: joining it gives the text back."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def sentence_body(piece: Column) -> Column:
    return F.regexp_extract(piece, _PARTS, 1)


def sentence_separator(piece: Column) -> Column:
    return F.substr(piece, F.length(sentence_body(piece)) + F.lit(1))
