"""Text rules that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.plans.storage import ship


def words(text: Column) -> Column:
    """Maximal runs of [^\\x20\\x09-\\x0D], in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class (as within []) a text has."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 with A-Z lower-cased; bytes.split() knows the same six space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shipped(df: DataFrame) -> DataFrame:
    """For operators that run Python: hand workers this package."""
    ship(df.sparkSession)
    return df


def cut(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in batches of so many at most, so that what is made of long texts stays within a worker's memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
