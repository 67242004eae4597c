r"""Byte-level BPE: encoding by rounds of merges over padded matrices of token ids, and decoding.

A text is cut into pieces by a pattern. A piece that is itself in the vocabulary is its one token; every other piece starts
as its bytes' tokens. Pieces of like length stand as rows of one padded matrix, beside a matrix of the ranks of neighbouring
pairs (found in a hash table, open addressing). Each round every row merges its leftmost pair of least rank: the pair's two
cells become one, all rows move up by one cell, and the two new neighbour pairs are looked up. Rows without a pair left leave
the matrix. Pieces of more than ``WIDEST`` bytes (a row's work grows with the square of its width) merge in the same order by
a heap over linked tokens, so any length is encoded exactly.

Each distinct piece of a chunk of texts is encoded once and remembered, up to ``MEMORY`` pieces. Documents are independent:
nothing is shuffled, and the vocabulary file is read on the driver (its size is checked) and travels with the function.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import narrow

#: Bytes of the widest matrix row, cells of one matrix, bytes of one chunk of texts (and ids of one in decoding),
#: remembered pieces beside those of a chunk, bytes of a file.
WIDEST, CELLS, CHUNK, MEMORY, MOST_FILE = 1024, 1 << 18, 1 << 19, 1 << 17, 64 << 20
NONE = np.int32(2**31 - 1)

#: Letters and numbers that the installed pattern library knows and the tokenizer's (Unicode 16) does not.
YOUNG_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
YOUNG_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


class Vocabulary:
    """Tokens by rank, the hash table of pairs, and the bytes of each token."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._index_tokens()
        self._index_pairs()

    def _index_tokens(self) -> None:
        by_rank = sorted((rank, token) for token, rank in self.ranks.items())
        size = by_rank[-1][0] + 1
        self.lengths = np.full(size, -1, np.int64)
        self.lengths[[rank for rank, _ in by_rank]] = [len(token) for _, token in by_rank]
        self.starts = np.zeros(size, np.int64)
        held = self.lengths >= 0
        self.starts[held] = np.cumsum(self.lengths[held]) - self.lengths[held]
        self.bytes = np.frombuffer(b"".join(token for _, token in by_rank), np.uint8)

    def _index_pairs(self) -> None:
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys, ranks = np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(rank, np.int32)
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]  # the last of several that want one slot has it
            settled = self.keys[slot] == keys
            self.values[slot[settled]] = ranks[settled]
            keys, ranks, slot = keys[~settled], ranks[~settled], (slot[~settled] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE for pairs that are no token and for padding (-1)."""
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero(right >= 0)
        key = left[todo].astype(np.int64) << 32 | right[todo]
        slot = self._slot(key)
        while len(todo):
            held = self.keys[slot]
            hit = held == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of 2 to ``width`` bytes: groups of finished rows as their places, numbers of tokens, and tokens."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        tokens = np.full((n, width), -1, np.int32)
        tokens[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        place = np.arange(n)
        while len(place):
            row = np.arange(len(place))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(place), np.int64)
            least = ranks[row, at] if ranks.shape[1] else np.full(len(place), NONE)
            going = least != NONE
            if not going.all():
                over = tokens[~going]
                yield place[~going], (over >= 0).sum(axis=1), over[over >= 0]
                tokens, ranks, place, at, least = tokens[going], ranks[going], place[going], at[going], least[going]
                row = np.arange(len(place))
            if not len(place):
                return
            rows, cells = tokens.shape
            tokens[row, at] = least
            keep = np.ones((rows, cells), bool)
            keep[row, at + 1] = False
            tokens = tokens[keep].reshape(rows, cells - 1)
            keep = np.ones((rows, cells - 1), bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(rows, cells - 2)
            for first in (at - 1, at):
                inside = np.flatnonzero((first >= 0) & (first < cells - 2))
                a = first[inside]
                ranks[inside, a] = self.pair_ranks(tokens[inside, a], tokens[inside, a + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one piece of any length: pairs wait in a heap by rank, then place."""
        tokens = self.of_byte[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(tokens[:-1], tokens[1:])
        token, n = tokens.tolist(), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(first[i]), i, token[i], token[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        spelled = [piece[i : i + 1] for i in range(n)]
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = rank, -1
            spelled[i] += spelled[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for l, r in ((before[i], i), (i, after[i])):
                if l >= 0 and r < n:
                    joined = self.ranks.get(spelled[l] + spelled[r])
                    if joined is not None:
                        heapq.heappush(heap, (joined, l, token[l], token[r]))
        return np.array([t for t in token if t >= 0], np.int32)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces in one array, and where each piece's start and how many they are."""
        count, start = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat: list[np.ndarray] = []
        end = 0
        whole, wide = [], {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                whole.append((i, rank))
            else:
                wide.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        if whole:
            at = np.array(whole, np.int64)
            start[at[:, 0]], count[at[:, 0]] = np.arange(len(at)), 1
            flat, end = [at[:, 1].astype(np.int32)], len(at)
        for width, members in wide.items():
            if width > WIDEST:
                for i in members:
                    flat.append(self.merge_long(pieces[i]))
                    start[i], count[i] = end, len(flat[-1])
                    end += len(flat[-1])
                continue
            step = max(1, CELLS // width)
            for low in range(0, len(members), step):
                some = np.array(members[low : low + step])
                for place, n, tokens in self.merge_rows([pieces[i] for i in some], width):
                    at = some[place]
                    count[at], start[at] = n, end + np.cumsum(n) - n
                    flat.append(tokens)
                    end += len(tokens)
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), start, count


    def spelled(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids between two bounds."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or self.lengths[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = self.lengths[ids]
        out = self.bytes[_ranges(self.starts[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:])]


class _Places(dict):
    """Pieces numbered as they come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        return place


class Encoder:
    """Texts to token ids; remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.cut = regex.compile(pattern).findall
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{YOUNG_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{YOUNG_NUMBERS}]]")
        self.cut_older = regex.compile(older, regex.V1).findall
        self.young = re.compile(f"[{YOUNG_LETTERS}{YOUNG_NUMBERS}]").search
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and self.young(text):
            return self.cut_older(text)
        return self.cut(text)

    def _learn(self, pieces: list[str]) -> None:
        flat, start, count = self.vocabulary.merged([p.encode() for p in pieces])
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        cut = [self.pieces(t) for t in texts]
        every = [p for pieces in cut for p in pieces]
        if len(self.place) > MEMORY or len(self.flat) > 8 * MEMORY:
            self._forget()
        known = len(self.place)
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        if len(self.place) > known:
            self._learn(list(itertools.islice(self.place, known, None)))
        count = self.count[at]
        ids = self.flat[_ranges(self.start[at], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        return ids, np.diff(ends[bounds])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] values, then the same for start[1], and so on."""
    shift = start - (np.cumsum(count) - count)
    return np.repeat(shift, count) + np.arange(int(count.sum()))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about CHUNK bytes of text, one row at least, and where each begins; only one of them is unpacked at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield low, texts.slice(low, high - low).to_pylist()
        low = high


@lru_cache(maxsize=4)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


@lru_cache(maxsize=4)
def _encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(_vocabulary(file), pattern)


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, rank a line), read on the driver and shipped with the functions; at most 64 MB."""
    with open(path, "rb") as f:
        data = f.read(MOST_FILE + 1)
    if len(data) > MOST_FILE:
        raise ValueError(f"{path} is larger than {MOST_FILE} bytes")
    return data


def _encode(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks, pattern)
    for batch in batches:
        for low, chunk in _chunks(batch.column("text")):
            ids, n = encoder.encode(chunk)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            rows = batch.slice(low, len(chunk))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, one row a row of ``docs``.

    A null or empty text has no ids; repeated rows are encoded each, a null doc_id is kept, any type of doc_id will do. There
    are no special tokens: text that looks like one is text. A text of any length is one row (its ids are one array). Where two
    pairs have the same rank the left one merges first. An empty table gives an empty table; other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_encode, ranks=ranks, pattern=pattern), f"doc_id {kind}, ids array<int>")


def decode(ids: Column, ranks: bytes) -> Column:
    """The bytes that an array of ids spells; null for null, empty for none. An id outside the vocabulary is an error."""

    def spell(lists: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(ranks)
        bounds = lists.offsets.to_numpy()
        made: list[bytes | None] = []
        low = 0
        while low < len(lists):
            # As many rows as hold CHUNK ids together, one at least.
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, "right")) - 1)
            made += vocabulary.spelled(lists.values[bounds[low] : bounds[high]].to_numpy(), bounds[low : high + 1] - bounds[low])
            low = high
        if lists.null_count:
            made = [b if held else None for b, held in zip(made, lists.is_valid().to_pylist())]
        return pa.array(made, pa.binary())

    return F.arrow_udf(spell, "binary")(ids)
