"""Sizes and portions; folders and tables are the library's."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.scratch import Scratch, gathered, partitions

__all__ = ["Scratch", "gathered", "partitions", "portions", "text_bytes"]


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in a column, over all rows."""
    return docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0


def portions(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in order, about limit bytes at a time, so that what a step builds beside them stays small."""
    first = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= limit:
            yield texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield texts[first:]
