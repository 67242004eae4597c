"""Helpers shared by the operators on training text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters other than blank and \t \n \v \f \r; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes to bytes for ``plain_words``: A-Z to a-z, other ASCII that is no letter or digit to a blank.
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII, as bytes of UTF-8."""
    return text.translate(_PLAIN).split()


def bytes_and_bounds(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, one after the other, and where each value ends (from 0)."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, bounds - bounds[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else the input has cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blocks(total: int, per_block: int) -> int:
    return max(1, -(-total // per_block))
