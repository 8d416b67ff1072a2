"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut into pieces by the tokenizer's pattern. Pieces that a worker has
not met are put into buckets by their length in bytes; a bucket is a padded
matrix of token ids with one piece per row. In each round every row finds the
rank of each adjacent pair by a hashed lookup, merges its leftmost pair of least
rank, and closes the gap; rows without a mergeable pair leave the matrix.

Two ids merge into the id of their joined bytes, as the ranks of a vocabulary
file mean it, so the table of pairs holds every split of every token into two
tokens. Pieces over `LONG` bytes are merged one at a time with a queue of pairs,
in the same order, because a matrix of such a row costs the square of its length.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import common

LONG = 256
WIDTHS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONG]
CELLS = 1 << 18
CACHED = 150_000
_NONE = np.int32(2**31 - 1)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        splits = (
            (ranks[t[:k]] << 32 | ranks[t[k:]], i)
            for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        )
        pairs = np.fromiter(splits, dtype=[("key", np.uint64), ("id", np.int32)])
        self._build(pairs["key"].copy(), pairs["id"].copy())
        self.pieces: dict[str, bytes] = {}  # ids of a piece as 32-bit numbers

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: all keys step on together until each has a slot of its own."""
        self.bits = max(12, int(len(keys) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        self.steps = 0
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or `_NONE`. Padding is -1 and never found."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        flat, keys, slot = out.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        for _ in range(self.steps):
            if not len(open_):
                break
            at = slot[open_]
            same = self.keys[at] == keys[open_]
            flat[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (self.keys[at] != np.uint64(2**64 - 1))]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """Merge all rows of one padded matrix to the end."""
        out: list[tuple[int, ...]] = [()] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
            else:
                at = np.zeros(len(rows), dtype=np.int64)
                best = np.full(len(rows), _NONE, dtype=np.int32)
            done = best == _NONE
            if done.any():
                for r, row in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[r] = tuple(i for i in row if i >= 0)
                keep = ~done
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
            # Close the gap: columns after the merged pair move one to the left.
            n, wide = ids.shape
            column = np.arange(wide - 1)
            source = column + (column > at[:, None])
            line = np.arange(n)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[line, at] = best
            if wide > 2:
                ranks = np.take_along_axis(ranks, source[:, : wide - 2], axis=1)
                right = at < wide - 2
                if right.any():
                    a = at[right]
                    ranks[line[right], a] = self.ranks(ids[line[right], a], ids[line[right], a + 1])
                left = at > 0
                if left.any():
                    a = at[left] - 1
                    ranks[line[left], a] = self.ranks(ids[line[left], a], ids[line[left], a + 1])
        return out

    def rank(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        slot = (key * int(_MULTIPLY) & (1 << 64) - 1) >> (64 - self.bits)
        while (held := int(self.keys[slot])) != key:
            if held == (1 << 64) - 1:
                return None
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.values[slot])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks(np.array(ids[:-1], dtype=np.int32), np.array(ids[1:], dtype=np.int32)).tolist()
        queue = [(r, i) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or self.rank(ids[i], ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    new = self.rank(ids[a], ids[after[a]])
                    if new is not None:
                        heapq.heappush(queue, (new, a))
        return tuple(i for i in ids if i >= 0)

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces into the cache: whole tokens, then buckets by length, then long ones."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw])
        order = np.argsort(size, kind="stable")
        for narrow, width in zip([0, *WIDTHS], WIDTHS, strict=False):
            a, b = np.searchsorted(size[order], [narrow + 1, width + 1])
            step = max(1, CELLS // width)
            for k in range(a, b, step):
                own = order[k : min(b, k + step)].tolist()
                data = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in own), dtype=np.uint8)
                ids = self.byte_ids[data.reshape(len(own), width)]
                ids[np.arange(width) >= size[own][:, None]] = -1
                for i, found in zip(own, self.merge_rows(ids), strict=True):
                    self.pieces[pieces[i]] = np.array(found, dtype=np.int32).tobytes()
        for i in order[np.searchsorted(size[order], LONG + 1) :].tolist():
            self.pieces[pieces[i]] = np.array(self.merge_long(raw[i]), dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.find(t) for t in texts]
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        new = {p for c in cut for p in c}.difference(self.pieces)
        if new:
            self.learn(sorted(new))
        known = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(known, c)), dtype=np.int32) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


_IDS = T.ArrayType(T.IntegerType())


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoder(path: str, pattern: str, again: bool):
    @F.arrow_udf(T.StructType([T.StructField("ids", _IDS), T.StructField("decoded", T.BinaryType())]) if again else _IDS)
    def encode(texts: pa.Array) -> pa.Array:
        model = vocabulary(path, pattern)
        found, back = [], []
        for part in common.chunks(texts):
            held = model.encode([x.decode() for x in part])
            found += held
            if again:
                back += [model.decode(ids.tolist()) for ids in held]
        ids = _lists(found)
        return pa.StructArray.from_arrays([ids, pa.array(back, pa.binary())], ["ids", "decoded"]) if again else ids

    return encode


def _decoder(path: str, pattern: str):
    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        model = vocabulary(path, pattern)
        return pa.array([None if row is None else model.decode(row) for row in ids.to_pylist()], pa.binary())

    return decode


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of each text (null: none), as array<int> in the column `ids`.

    Special strings are ordinary text. An input column of that name gives way.
    """
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn(ids, _encoder(path, pattern, False)(F.col(text)))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that the ids stand for (null: null). An id outside the vocabulary is an error."""
    return rows.withColumn(out, _decoder(path, pattern)(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with ids and decoded, the bytes made from the ids, in one pass through Python.

    `decode` after `encode` in one plan would encode twice: once for the ids and
    once more inside the decoder. Columns of these names give way.
    """
    common.bounded_batches(docs.sparkSession)
    return common.attach(docs, _encoder(path, pattern, True)(F.col(text)), ["ids", "decoded"])


def digest(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    return rows.select(
        doc_id, F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
