"""Hashes of lists that are never made: rows of a group are sorted, and a running hash goes over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DIGESTS = "group string, digest string, n bigint"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by group; what is kept is one hash and one count."""
    group, state, n = None, None, 0
    for pdf in batches:
        done = []
        for g, text in zip(pdf["group"], pdf["text"]):
            if g != group:
                if state is not None:
                    done.append((group, state.hexdigest(), n))
                group, state, n = g, hashlib.sha256(), 0
            state.update((b"|" if n else b"") + text.encode())
            n += 1
        yield pd.DataFrame(done, columns=["group", "digest", "n"])
    if state is not None:
        yield pd.DataFrame([(group, state.hexdigest(), n)], columns=["group", "digest", "n"])


def joined_sha256(rows: DataFrame, group: Column, order: Sequence[Column], text: Column) -> DataFrame:
    """``group, digest, n``: the SHA-256 of each group's texts in ``order``, joined by ``|``, as hex digits.

    The same as ``sha2`` over the joined list, in constant memory: sorting spills, and a group of any size passes through one
    task as a stream. ``group`` must be a text; null texts count as empty.
    """
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = rows.select(group.alias("group"), F.coalesce(text, F.lit("")).alias("text"), *named)
    ordered = rows.repartition("group").sortWithinPartitions("group", *[f"o{i}" for i in range(len(order))])
    return ordered.select("group", "text").mapInPandas(_run, DIGESTS)


def short_id(prefix: str, digest: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(digest, 1, 10)))
