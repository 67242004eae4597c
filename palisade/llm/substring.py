"""Substring de-duplication: words covered by a window that also starts anywhere else are removed.

A window is ``length`` consecutive words of one document. Each window has a minimiser, the m-gram of words with the least
hash in it, and consecutive windows that share one travel as one packed string (a super-k-mer) to the bucket of that
hash, together with a return address. All windows with the same words have the same minimiser, so they meet in one
bucket; sorting them there by a rolling hash, and comparing the words themselves, counts them exactly.

Super-k-mers that are alike within a map block (copies, shared passages) are settled there: their windows are known to
repeat, and one copy travels on for all of them. So a passage that half the corpus shares reaches its bucket once a block.

Inside a task the work is numpy over a block's bytes. Hashes only sort and propose: equality is decided on the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import blocks, narrow
from palisade.session import stage

#: Bytes of text that a map task works through at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of packed strings that a bucket should hold.
BUCKET_BYTES = 12 << 20
#: Packed strings weigh about three times the text they come from.
SPREAD = 3
#: Multiplier of the rolling hash (odd, so it has an inverse modulo 2**64), and bytes hashed at a time.
BASE, STEP = 0x9E3779B97F4A7C15, 1 << 17
#: Return address: two 64-bit hashes of the text; first window and number of windows.
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("count", "<u4")])


def _powers(base: int) -> np.ndarray:
    powers = np.full(STEP + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of several texts laid one after the other, each with its words joined by one blank and a newline at its end,
    and polynomial hashes of any stretch of words."""

    def __init__(self, flat: bytes):
        self.flat = flat
        data = np.frombuffer(flat, np.uint8)
        self.stop = np.flatnonzero((data == 32) | (data == 10))
        self.start = np.concatenate([[0], self.stop[:-1] + 1]).astype(np.int64)[: len(self.stop)]
        #: Index of the word after a text's last one, and of its first one, for each text.
        self.text_end = np.flatnonzero(data[self.stop] == 10) + 1
        self.text_begin = np.concatenate([[0], self.text_end[:-1]]).astype(np.int64)[: len(self.text_end)]
        self._at_start, self._at_stop, self._down = self._prefixes(data)

    def _prefixes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at_start, at_stop, down = (np.empty(len(self.start), np.uint64) for _ in range(3))
        total, up, inverse, w, v = np.uint64(0), 1, 1, 0, 0
        step_up, step_down = int(UP[STEP]), int(DOWN[STEP])
        for at in range(0, len(data), STEP):
            part = data[at : at + STEP]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * UP[: len(part)], out=sums[1:])
            sums = sums * np.uint64(up) + total
            w2, v2 = np.searchsorted(self.start, at + len(part)), np.searchsorted(self.stop, at + len(part))
            local = self.start[w:w2] - at
            at_start[w:w2], down[w:w2] = sums[local], DOWN[local] * np.uint64(inverse)
            at_stop[v:v2] = sums[self.stop[v:v2] - at]
            total, w, v = sums[-1], w2, v2
            up, inverse = up * step_up % (1 << 64), inverse * step_down % (1 << 64)
        return at_start, at_stop, down

    def hashes(self, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
        return mixed((self._at_stop[last] - self._at_start[first]) * self._down[first])

    def windows(self, length: int) -> np.ndarray:
        """Indices of the words where a whole window of one text starts."""
        end = np.repeat(self.text_end, self.text_end - self.text_begin)
        return np.flatnonzero(np.arange(len(end)) + length <= end)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs(*breaks: np.ndarray) -> np.ndarray:
    """Where runs begin, given for each element but the first whether one begins there."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(breaks)]))


def super_kmers(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first window, number of windows, hash of the minimiser`` of each super-k-mer."""
    windows = words.windows(length)
    if not len(windows):
        return windows, windows, np.zeros(0, np.uint64)
    gram = min(gram, length)
    n = len(words.start) - gram + 1
    grams = words.hashes(slice(0, n), slice(gram - 1, None))
    # The position in the low half makes the leftmost of equal m-grams the minimiser.
    low = np.uint64((1 << 32) - 1)
    least = sliding_min((grams & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1)[windows]
    first = runs(least[1:] != least[:-1], np.diff(windows) != 1)
    return windows[first], np.diff(np.append(first, len(windows))), grams[(least[first] & low).astype(np.int64)]


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
    keys, texts, size = [], [], 0
    for frame in frames:
        for k1, k2, text in zip(frame.k1.tolist(), frame.k2.tolist(), frame.text):
            flat = b" ".join((text or b"").split())
            if not flat:
                continue
            if size and size + len(flat) > BLOCK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append((k1, k2))
            texts.append(flat + b"\n")
            size += len(flat)
    if keys:
        yield keys, texts


def _packed_spans(address: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    out = np.empty(len(address), SPAN)
    out["k1"], out["k2"], out["start"], out["count"] = address[:, 0], address[:, 1], start, count
    return out.tobytes()


def _scatter(length: int, gram: int, buckets: int):
    """Texts to rows ``bucket, packed, spans, settled``: the super-k-mers for a bucket with their return addresses
    (``settled``: a byte for each, 1 if it is known to repeat and wants no answer), or answers already known (no strings)."""

    def scatter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=5)
        for turn, (keys, texts) in enumerate(_blocks(frames)):
            words = Words(b"".join(texts))
            first, count, minimiser = super_kmers(words, length, gram)
            if not len(first):
                continue
            of = np.searchsorted(words.text_end, first, side="right")
            address, local = np.array(keys, np.int64)[of], first - words.text_begin[of]
            flat, lo, hi = words.flat, words.start[first].tolist(), words.stop[first + count + length - 2].tolist()
            seen: dict[bytes, int] = {}
            same = np.fromiter((seen.setdefault(flat[a:b], i) for i, (a, b) in enumerate(zip(lo, hi))), np.int64, len(lo))
            del seen
            copies = np.bincount(same, minlength=len(lo))
            known = copies[same] > 1
            rows = []
            if known.any():
                rows.append((int(minimiser[0] % np.uint64(buckets)), b"", _packed_spans(address[known], local[known], count[known]), b""))
            sent = np.flatnonzero(copies > 0)
            bucket = (minimiser[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            cuts = runs(bucket[1:] != bucket[:-1]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(sent)]):
                part = sent[a:b]
                body = b"".join([flat[lo[i] : hi[i]] + b"\n" for i in part.tolist()])
                rows.append((int(bucket[a]), press.compress(body), _packed_spans(address[part], local[part], count[part]),
                             (copies[part] > 1).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "packed", "spans", "settled"])

    return scatter


def repeating(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the words, and which of them occur more than once."""
    windows = words.windows(length)
    repeats = np.zeros(len(windows), bool)
    if not len(windows):
        return windows, repeats
    flat, start, stop = words.flat, words.start[windows], words.stop[windows + length - 1]
    string = np.searchsorted(words.text_end, windows, side="right")
    hashes = words.hashes(windows, windows + length - 1)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
    # The first window of a run of equal hashes stands for the run.
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(head != np.arange(len(head)))
    if len(again):
        # Consecutive windows that point to consecutive heads are compared in one go.
        cuts = runs(np.diff(again) != 1, np.diff(head[again]) != 1, np.diff(string[again]) != 0, np.diff(string[head[again]]) != 0).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(again)]):
            i, j = again[a], again[b - 1]
            p, q = head[i], head[j]
            if flat[start[i] : stop[j]] == flat[start[p] : stop[q]]:
                repeats[i : j + 1] = repeats[p : q + 1] = True
            else:  # the same hash for other words: count these windows by their words
                for k in range(i, j + 1):
                    equal = [x for x in np.flatnonzero(hashes == hashes[k]) if flat[start[x] : stop[x]] == flat[start[k] : stop[k]]]
                    repeats[equal] |= len(equal) > 1
    return windows, repeats


def _count(length: int):
    """A bucket's super-k-mers to answers: ``k1, k2, spans`` with the stretches of windows that repeat, one row a text."""

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        opened = zstandard.ZstdDecompressor()
        strings = bucket.packed.map(len).to_numpy() > 0
        words = Words(b"".join(opened.decompress(p) for p in bucket.packed[strings]))
        sent = np.frombuffer(b"".join(bucket.spans[strings]), SPAN)
        settled = np.frombuffer(b"".join(bucket.settled[strings]), np.uint8) > 0
        answers = [np.frombuffer(b"".join(bucket.spans[~strings]), SPAN)]
        windows, repeats = repeating(words, length)
        at = np.flatnonzero(repeats)
        if len(at):
            string = np.searchsorted(words.text_end, windows[at], side="right")
            local = windows[at] - words.text_begin[string] + sent["start"][string]
            cut = runs(np.diff(at) != 1, np.diff(string) != 0)
            size = np.diff(np.append(cut, len(at)))
            wanted = ~settled[string[cut]]
            found = sent[string[cut[wanted]]].copy()
            found["start"], found["count"] = local[cut[wanted]], size[wanted]
            answers.append(found)
        every = np.concatenate(answers)
        if not len(every):
            return pd.DataFrame({"k1": np.zeros(0, np.int64), "k2": np.zeros(0, np.int64), "spans": pd.Series([], dtype=object)})
        every = every[np.lexsort((every["start"], every["k2"], every["k1"]))]
        cuts = runs(np.diff(every["k1"]) != 0, np.diff(every["k2"]) != 0)
        pairs = np.stack([every["start"], every["count"]], axis=1)
        parts = [merged(pairs[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(every)])]
        return pd.DataFrame({"k1": every["k1"][cuts], "k2": every["k2"][cuts], "spans": parts})

    return count


def merged(spans: np.ndarray) -> bytes:
    """Stretches ``start, count`` in the order of their starts, those that touch or overlap made one; packed."""
    spans = spans.astype(np.int64)
    stop = np.maximum.accumulate(spans.sum(axis=1))
    cut = runs(spans[1:, 0] > stop[:-1])
    first = spans[cut, 0]
    return np.stack([first, stop[np.append(cut[1:] - 1, len(spans) - 1)] - first], axis=1).astype("<u4").tobytes()


def without(words: list[bytes], spans: list[bytes] | None, length: int) -> tuple[list[bytes], int]:
    """The words kept and the number removed, given packed stretches of repeated windows."""
    if spans is None or not len(spans):
        return words, 0
    covered = np.zeros(len(words) + 1, np.int64)
    stretch = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
    np.add.at(covered, stretch[:, 0], 1)
    np.add.at(covered, stretch.sum(axis=1) + length - 1, -1)
    gone = np.cumsum(covered[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def _strip(length: int, keep_text: bool):
    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            totals, gone, digests, bodies = [], [], [], []
            for text, spans in zip(frame.text, frame.spans):
                words = (text or b"").split()
                kept, removed = without(words, spans, length)
                body = b" ".join(kept)
                totals.append(len(words))
                gone.append(removed)
                digests.append(hashlib.sha256(body).hexdigest())
                bodies.append(body.decode("utf-8", "replace") if keep_text else None)
            out = pd.DataFrame({"doc_id": frame.doc_id, "n_words": totals, "n_removed": gone, "kept_sha256": digests})
            yield out.assign(kept=bodies) if keep_text else out

    return strip


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 8, text: str = "text", doc_id: str = "doc_id",
                   keep_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, the ``kept`` text (the
    words left, joined by one blank).

    A null, empty or blank text has no words (the digest is that of the empty string). Texts of fewer than ``length``
    words lose nothing. Repeated rows are documents of their own, so all their windows repeat and go. A null doc_id is
    passed on. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit("second"), "text").alias("k2"))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(blocks(SPREAD * total, BUCKET_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packets = rows.select("k1", "k2", "text").mapInPandas(
        _scatter(length, gram, buckets), "bucket long, packed binary, spans binary, settled binary")
    answers = packets.groupBy("bucket").applyInPandas(_count(length), "k1 long, k2 long, spans binary")
    # Written before the join, so that a text with very many copies can be split there.
    spans = stage(answers.groupBy("k1", "k2").agg(F.collect_set("spans").alias("spans")), "repeats")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInPandas(
        _strip(length, keep_text), schema + ", kept string" * keep_text)
