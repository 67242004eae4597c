"""Near-duplicate documents by SimHash: fingerprints within a few bits of each other are linked.

Words are those between blanks, A-Z in lower case. A bit of the 64-bit fingerprint is set if it is set in more than
half of the hashes (XXH64, seed 42) of the document's shingles, repeats counted. Distinct fingerprints are laid out in
tiles that share the population counts of their four quarters (eight octets for very many fingerprints); two
fingerprints ``radius`` bits apart cannot differ in those counts by more than ``radius`` in sum, so only tile pairs
within it are compared, exactly, with numpy's exclusive-or and bit count. Large tiles are cut further.

Each comparison returns a spanning forest of its links, never all pairs: groups of thousands of copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from palisade.llm.common import narrow
from palisade.operators.components import connected_components
from palisade.session import stage

#: Fingerprints on the home side of one comparison task.
TILE = 8192
#: Fingerprints above this number are laid out by octets.
FINE_ABOVE = 1 << 24
#: Home rows of a tile compared at a time; bounds the comparison matrix.
STRIP = 512


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text (UTF-8); 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        stops = (ends[shingle - 1:] - 1).tolist()
        starts = [0, *ends[: len(stops) - 1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(flat[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return simhash(text.cast("binary"))


def _counts(parts: int) -> list[Column]:
    width = 64 // parts
    low = (1 << width) - 1 if width < 64 else -1
    return [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(low))) for i in range(parts)]


def _offsets(parts: int, radius: int) -> list[list[int]]:
    """One of each two opposite steps between cells whose counts differ by at most ``radius`` in sum."""
    if parts == 1:
        return [[d] for d in range(1, radius + 1)]
    near = [(0,) * parts]
    for _ in range(radius):
        near += [p[:i] + (p[i] + s,) + p[i + 1:] for p in near for i, s in product(range(parts), (-1, 1))]
    return sorted(list(p) for p in set(near) if p > (0,) * parts)


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of ``label`` that the pairs link; a group is named by its first member."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        la, lb = la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _compare(radius: int):
    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        home = tile.home.to_numpy()
        fps = np.concatenate([tile.fp.to_numpy()[home], tile.fp.to_numpy()[~home]]).view(np.uint64)
        m, label = int(home.sum()), np.arange(len(fps))
        for at in range(0, m, STRIP):
            strip = fps[at : min(at + STRIP, m)]
            for col in range(at, len(fps), 1 << 14):
                near = np.bitwise_count(strip[:, None] ^ fps[None, col : col + (1 << 14)]) <= radius
                i, j = np.nonzero(near)
                _forest(label, i + at, j + col)
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})

    return compare


def near_links(fps: DataFrame, radius: int = 2, parts: int | None = None) -> DataFrame:
    """Links ``a, b`` between the distinct values of ``fp`` (long) that connect exactly those fingerprints which chains of
    steps of at most ``radius`` bits connect. ``fps`` should be a written table: it is read twice."""
    parts = parts or (4 if fps.count() <= FINE_ABOVE else 8)
    rows = fps.select("fp", F.array(*_counts(parts)).alias("cell"))
    cells = stage(rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "tiles")
    own = rows.join(cells, "cell").select("cell", F.expr("pmod(xxhash64(fp), tiles)").alias("tile"), "fp", "tiles")
    # Rows of a tile meet the cell's other tiles and those of the neighbouring cells; cells without rows fall out.
    rest = own.where("tile > 0").select("cell", "fp", F.explode(F.expr("sequence(0L, tile - 1)")).alias("tile"))
    steps = F.array(*[F.array(*[F.lit(d) for d in step]) for step in _offsets(parts, radius)])
    away = rows.select("fp", F.explode(steps).alias("step"), "cell").select(
        "fp", F.zip_with("cell", "step", lambda c, d: c + d).alias("cell")
    ).join(cells, "cell").select("cell", "fp", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile"))
    laid = own.select("cell", "tile", "fp", F.lit(True).alias("home")).unionByName(
        rest.unionByName(away).withColumn("home", F.lit(False))
    )
    return laid.groupBy("cell", "tile").applyInPandas(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, text_key, fp, group_fp, component_id``.

    ``fp`` is the fingerprint as a signed long, ``text_key`` a 64-bit hash of the text, ``group_fp`` the smallest
    fingerprint of the row's group and ``component_id`` the smallest doc_id in it. A null or empty text has fingerprint 0
    and is linked like any other. Repeated rows stay; rows without a doc_id take part, and a group that has only those
    has a null ``component_id``. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    marked = stage(rows.select(
        "doc_id", F.xxhash64("text").alias("text_key"), fingerprint_column(F.col("text"), shingle).alias("fp")
    ), "fingerprints")
    firsts = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = stage(near_links(firsts.select("fp"), radius), "links")
    found = connected_components(links).select(
        F.col("node").alias("fp"), F.col("component").alias("group_fp")
    )
    named = stage(firsts.join(found, "fp", "left").select("fp", "first", F.coalesce("group_fp", "fp").alias("group_fp")), "groups")
    least = named.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    of_fp = named.join(least, "group_fp").select("fp", "group_fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_key", "fp", "group_fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The input's rows and columns, one row of each group: that with the smallest doc_id (rows without one come last),
    ties to the smaller hash of the text. Of rows alike in both, one stays."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    groups = simhash_groups(docs, **options)
    chosen = stage(
        groups.groupBy("group_fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("k"))
        .select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_key").alias("keep_key")), "kept")
    # The input's columns travel as one, so none of them can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("own_id"), F.xxhash64(F.col(f"`{text}`")).alias("own_key"))
    kept = rows.join(chosen, F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_key") == F.col("keep_key")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_key"]).select("row.*")
