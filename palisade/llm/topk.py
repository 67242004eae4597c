"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to whole numbers, and a block of rows is kept as bitmaps: bit s of attribute i over all rows of the
block is one slice. A query's score is then a sum of slices: attribute i counts |q_i| times, so slice s enters at weight
2^(s+j) for each bit j of |q_i| (complemented if q_i is negative, which leaves a constant). Full adders over whole
bitmaps, three slices of a weight to one of it and one of the next, add them up until one slice is left at each weight.
The largest scores are found from the most significant slice downward; the rows that tie at the boundary go by vec_id.

There are as many slices as the block's numbers have bits, so components of any size count in full; scores are whole numbers
without a limit until the very end, where one that does not fit 64 bits is an error.

Blocks are dealt to parts of up to ``PART_BLOCKS`` blocks. A part's task opens its blocks once, then streams the queries past them,
so it holds the blocks and one Arrow batch of queries; blocks are shuffled once, queries once a part. Each part returns at
most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import blocks, narrow
from palisade.session import stage

#: Expected rows of an index block, and blocks of one part.
BLOCK_ROWS, PART_BLOCKS = 8_192, 32
#: Numbers below this, and their sums of a few, are safe in 64 bits.
SMALL = float(1 << 60)


def finite(embedding: Column) -> Column:
    """The components as doubles; null for vectors that are null or hold a null, NaN or infinite component."""
    wide = embedding.cast("array<double>")
    good = embedding.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, wide)


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers: 64-bit ones where all are small, else Python's own."""
    with np.errstate(over="ignore"):
        product = np.floor(values * scale)
    if not product.size or np.abs(product).max() < SMALL:
        return product.astype(np.int64)
    exact = [int(p) if math.isfinite(p) else math.floor(Fraction(x) * Fraction(scale))
             for x, p in zip(values.ravel().tolist(), product.ravel().tolist())]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(values.shape)


def pack_slices(values: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows of whole numbers to ``least`` of each attribute, ``width`` in bits, and the slices of (value - least), one
    bitmap of 64-bit words each, attributes in order and low bits first."""
    rows, dims = values.shape
    least = [int(values[:, i].min()) for i in range(dims)] if rows else [0] * dims
    width = np.array([int(values[:, i].max() - least[i]).bit_length() if rows else 0 for i in range(dims)], np.int64)
    words = -(-rows // 64)
    out = np.zeros((int(width.sum()), words * 8), np.uint8)
    at = 0
    for i in range(dims):
        above = values[:, i] - least[i]
        for s in range(width[i]):
            bits = np.packbits((above >> s & 1).astype(np.uint8), bitorder="little")
            out[at, : len(bits)] = bits
            at += 1
    return least, width, out.view(np.uint64)


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> tuple[np.ndarray, int]:
    """Adds bitmaps given by weight (power of two); the sum's slices, lowest weight first, and that weight."""
    low = min(columns, default=0)
    out, weight = [], low
    carry: list[np.ndarray] = []
    pending = {w: list(c) for w, c in columns.items()}
    while pending or carry:
        stack = pending.pop(weight, []) + carry
        carry = []
        rows = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            half = a ^ b
            carry.append(a & b | half & c)
            rows = np.concatenate([half ^ c, rows[3 * third :]])
        if len(rows) == 2:
            carry.append(rows[0:1] & rows[1:2])
            rows = rows[0:1] ^ rows[1:2]
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        weight += 1
    return (np.stack(out) if out else np.zeros((0, words), np.uint64)), low


def top_rows(slices: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k largest sums among the allowed ones, boundary ties to the smaller row; slices lowest first."""
    sure, tied = np.zeros_like(allowed), allowed
    for s in slices[::-1]:
        ones = tied & s
        n = int(np.bitwise_count(sure | ones).sum())
        if n > k:
            tied = ones
        else:
            sure, tied = sure | ones, tied & ~s
            if n == k:
                tied = np.zeros_like(tied)
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if len(rows) < k:
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        rows = np.concatenate([rows, rest[: k - len(rows)]])
    return rows


class Block:
    """One block of the index, opened; its rows are in the order of their vec_id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, least: list[int], width: np.ndarray, slices: np.ndarray):
        self.rows, self.ids, self.least, self.width, self.slices = rows, ids, least, width, slices
        self.first = np.cumsum(width) - width
        self.words = -(-len(ids) // 64)
        self.every = np.zeros(self.words * 8, np.uint8)
        bits = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.every[: len(bits)] = bits
        self.every = self.every.view(np.uint64)

    def search(self, row: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Scores and ids of the k best rows other than the query's own."""
        n = min(len(query), len(self.width))
        query = query[:n]
        given = query.tolist()
        constant = sum(q * at for q, at in zip(given, self.least))
        columns: dict[int, list[np.ndarray]] = {}
        for sign in (1, -1):
            size = np.where(query * sign > 0, query * sign, 0)
            if sign < 0:
                # -q * v = q * (2^w - 1 - v) - q * (2^w - 1): the complement's slices and a constant.
                constant -= sum(q * ((1 << w) - 1) for q, w in zip(size.tolist(), self.width.tolist()))
            for j in range(int(size.max(initial=0)).bit_length()):
                dims = np.flatnonzero(size >> j & 1)
                for s in range(int(self.width[dims].max(initial=0))):
                    use = self.first[dims[self.width[dims] > s]] + s
                    taken = self.slices[use]
                    columns.setdefault(s + j, []).append(taken if sign > 0 else ~taken)
        total, low = add_slices(columns, self.words)
        allowed = self.every.copy()
        for own in np.flatnonzero(self.rows == row).tolist():
            allowed[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        found = top_rows(total, allowed, k)
        bits = (total[:, found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)).T.tolist()
        return [(constant + sum(b << s for s, b in enumerate(one, low)), i) for one, i in zip(bits, self.ids[found].tolist())]


def _index_block(rows: pd.DataFrame, scale: float) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "row"])
    values = np.zeros((len(rows), max(map(len, rows.x))))
    for i, x in enumerate(rows.x):
        values[i, : len(x)] = x
    least, width, slices = pack_slices(quantised(values, scale))
    return pd.DataFrame({
        "block": [rows.block.iloc[0]], "rows": [rows.row.to_numpy(np.int64).tobytes()], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()],
        "least": [list(map(str, least))], "width": [width.tobytes()], "slices": [slices.tobytes()]})


INDEX = "rows binary, ids binary, least array<string>, width binary, slices binary"


def build_index(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """``block, rows, ids, least, width, slices``: the bit-sliced index of ``row, vec_id, x``; rows are dealt to blocks by a hash."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks(rows, BLOCK_ROWS))))
    return dealt.groupBy("block").applyInPandas(lambda pdf: _index_block(pdf, scale), f"block long, {INDEX}")


def _open(row: dict) -> Block:
    width = np.frombuffer(row["width"], np.int64)
    ids = np.frombuffer(row["ids"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint64).reshape(int(width.sum()), -(-len(ids) // 64))
    return Block(np.frombuffer(row["rows"], np.int64), ids, list(map(int, row["least"])), width, slices)


def sortable(number: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(number).bit_length() + 7) // 8
    plain = size.to_bytes(4, "big") + abs(number).to_bytes(size, "big")
    return b"\1" + plain if number >= 0 else b"\0" + bytes(255 - b for b in plain)


def _search(batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by part, blocks before queries."""
    part, opened = None, []
    for batch in batches:
        out = {"query": [], "query_id": [], "vec_id": [], "score": [], "wide": []}
        for i in range(batch.num_rows):
            at = batch.column("part")[i].as_py()
            if at != part:
                part, opened = at, []
            if batch.column("slices")[i].is_valid:
                opened.append(_open({n: batch.column(n)[i].as_py() for n in ("rows", "ids", "least", "width", "slices")}))
                continue
            row, query_id = batch.column("row")[i].as_py(), batch.column("vec_id")[i].as_py()
            query = quantised(batch.column("x")[i].values.to_numpy(), scale)
            best = sorted((pair for block in opened for pair in block.search(row, query, k)), key=lambda p: (-p[0], p[1]))
            for score, vec_id in best[:k]:
                out["query"].append(row)
                out["query_id"].append(query_id)
                out["vec_id"].append(vec_id)
                out["score"].append(score if -(1 << 63) <= score < 1 << 63 else None)
                out["wide"].append(sortable(score))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (a condition on ``vec_id``) holds, the k other rows
    with the largest inner product of the components floor(scale * x), ties to the smaller vec_id; fewer if there are fewer.

    Every row but the query's own is a candidate: rows that share an id are rows of their own, each found and, if the condition
    holds, each asking for itself. Rows without an id, and vectors that are null or hold a null, NaN or infinite component, take no part. A
    shorter vector counts as filled up with zeros. Components may have any finite size; a score among the k best that does not
    fit 64 bits is an error. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = narrow(vectors, vec_id=vec_id, embedding=embedding).select("vec_id", finite(F.col("embedding")).alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND x IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    # Written, so that a row's number stays the same for the index and the queries.
    rows = stage(rows, "vectors")
    total = rows.count()
    index = stage(build_index(rows, total, scale), "bit-slices")
    # Parts of at most PART_BLOCKS blocks; smaller ones where there would be fewer parts than cores.
    many = blocks(total, BLOCK_ROWS)
    parts = max(blocks(many, PART_BLOCKS), min(many, rows.sparkSession.sparkContext.defaultParallelism))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in INDEX.split(", "))]
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "vec_id", "x", *none)
    opened = index.select(
        F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("vec_id"),
        F.lit(None).cast("array<double>").alias("x"), "rows", "ids", "least", "width", "slices")
    dealt = opened.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", F.col("slices").isNull())
    found = dealt.mapInArrow(partial(_search, k=k, scale=scale), "query long, query_id long, vec_id long, score long, wide binary")
    best = Window.partitionBy("query").orderBy(F.desc("wide"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))
