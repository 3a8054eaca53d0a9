"""Chunk-wise extraction over a stream: the narrow operators are the same on streams.

The batch operators that number lines or carry pages across a document need all of it
and take a document per row, so a stream of whole documents is cut by paragraph here
with expressions alone. This is an addition; it keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.entities import extracted
from ..sources.vocabulary import DEFAULT


def paragraphs(docs: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, seq, content`` of a stream of ``doc_id, text``."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda x: x != "")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(parts).alias("seq", "content"))
    return rows.select(F.format_string("%s_%04d", "doc_id", "seq").alias("chunk_id"), "doc_id", "seq", "content")


def mentions(docs: DataFrame, vocabulary: dict = DEFAULT) -> DataFrame:
    return extracted(paragraphs(docs), vocabulary)
