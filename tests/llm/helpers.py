"""Small tables with everything that may go wrong, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Columns beyond the operators' own, named like columns that the operators use inside.
EXTRA = ", fp long, k1 string, start int, component_id string, size double, spans string, label string, q int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("", "n", "s", "th", "mber", "é")]


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``rows`` of doc_id, text and optionally source."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2, "y", 3.0, "z", "w", 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(rng: random.Random) -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    shared = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (None, "no id at all here"), (6, prose(rng, 40_000))]
    rows += [(10 + i, f"{prose(rng, 30)} {shared} {prose(rng, 20)}") for i in range(4)]
    rows += [(20, prose(rng, 80))] * 3 + [(21, rows[-1][1]), (None, rows[-1][1]), (22, "\u00a0x\u2003y Ünï")]
    return rows
