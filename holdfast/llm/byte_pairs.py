"""Byte-level BPE by a rank file: encoding and exact decoding.

A pre-token that is in the vocabulary is found by a minimal perfect hash: two 64-bit
halves of one hash give a bucket and, with the bucket's displacement, a place of its own
among as many places as there are entries. Other pre-tokens are merged with a heap of
adjacent pairs over linked bytes.

Defined results: a null text is an empty one, without ids; repeated rows are encoded each;
other columns stay; an empty table gives no rows. One text is held by one task.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.encoding import BLOCK_BYTES, MARKS, Memo, as_ids, encode, encoder_of
from holdfast.llm.tables import spread, text_slices

KEYS_PER_BUCKET = 2
_STEP, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _place(high: int, low: int, shift: int, n: int) -> int:
    return (((high + shift * _STEP) * (low | 1) & _WORD) >> 32) % n


class PerfectHash:
    """Places 0 .. n - 1 for n distinct byte strings."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // KEYS_PER_BUCKET)
        self.shift = array("q", bytes(8 * self.buckets))
        self.keys: list[bytes] = [b""] * self.n
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            low, high = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
            members[low % self.buckets].append((high, low, i))
        free = [True] * self.n
        single, order = [], sorted(range(self.buckets), key=lambda b: -len(members[b]))
        self.place_of = [0] * self.n
        for b in order:
            group = members[b]
            if len(group) == 1:
                single.append(b)
                continue
            d = 0
            while group:
                places = [_place(high, low, d, self.n) for high, low, _ in group]
                if all(free[p] for p in places) and len(set(places)) == len(places):
                    self._put(b, d, places, group, keys, free)
                    break
                d += 1
        rest = iter([p for p in range(self.n) if free[p]])
        for b in single:  # a lone key's displacement names its place
            p = next(rest)
            self._put(b, -p - 1, [p], members[b], keys, free)

    def _put(self, bucket, shift, places, group, keys, free) -> None:
        self.shift[bucket] = shift
        for place, (_, _, i) in zip(places, group):
            free[place], self.keys[place], self.place_of[i] = False, keys[i], place

    def find(self, key: bytes) -> int:
        """The key's place, or -1 if it is none of the keys."""
        low, high = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
        d = self.shift[low % self.buckets]
        place = -d - 1 if d < 0 else _place(high, low, d, self.n)
        return place if self.keys[place] == key else -1


class RankCoder:
    """Encoder and decoder of a rank file, with the pattern that cuts texts into pre-tokens."""

    lowered = False

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)}
        keys = list(self.ranks)
        self.vocabulary = PerfectHash(keys)
        self.rank_at = [0] * len(keys)
        for i, key in enumerate(keys):
            self.rank_at[self.vocabulary.place_of[i]] = self.ranks[key]
        self.memo = Memo(self._ids)
        space = r"\p{White_Space}"
        pattern = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)
        self.findall = regex.compile(pattern).findall
        by_rank = dict(sorted((rank, key) for key, rank in self.ranks.items()))
        self.lengths = np.zeros(max(by_rank, default=-1) + 1, np.int64)
        self.lengths[list(by_rank)] = [len(key) for key in by_rank.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank.values()), np.uint8)

    def _ids(self, pre_token: str) -> bytes:
        key = pre_token.encode("utf-8")
        place = self.vocabulary.find(key)
        return as_ids([self.rank_at[place]] if place >= 0 else self.merge(key))

    def merge(self, data: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of its parts has changed meanwhile
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(data[i : end[stop]])) is not None:
                    heappush(heap, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(data[left:stop])) is not None:
                heappush(heap, (rank, left, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.findall(text)))

    def piece(self, lead: str, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if word.isalpha():
            tail = self.memo[piece[len(word) :]] if len(word) < len(piece) else b""
            return self.memo[lead + word] + tail
        return self.whole(lead + piece)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids and the number of bytes of each."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        return self.bytes[spread(self.starts[ids], lengths)], lengths


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts of ``data``; ends: of the parts, in bytes."""
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a binary column of ids, four bytes each, in the place of the text."""
    kept = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(RankCoder, path, pattern)
        for block in text_slices(batches, BLOCK_BYTES, text):
            tokens, counts = encode(coder, block.column(len(kept)))
            rest = [block.column(i) for i in range(len(kept))]
            yield pa.record_batch([*rest, binary(tokens, 4 * np.cumsum(counts))], names=[*kept, ids])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in docs.select(*kept).dtypes)
    return docs.select(*kept, text).mapInArrow(run, f"{fields}{', ' * bool(kept)}`{ids}` binary")


def decoded(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``tokens`` with a binary column of the bytes that its ids stand for."""
    tokens = tokens.drop(data)
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(RankCoder, path, pattern)
        for block in text_slices(batches, BLOCK_BYTES, ids):
            column = block.column(names.index(ids)).fill_null(b"")
            counts = pc.binary_length(column).to_numpy().astype(np.int64) // 4
            flat, lengths = coder.decode(np.frombuffer(b"".join(column.to_pylist()), "<u4"))
            sums = np.concatenate(([0], np.cumsum(lengths)))
            yield pa.record_batch([*block.columns, binary(flat, sums[np.cumsum(counts)])], names=[*names, data])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in tokens.dtypes)
    return tokens.mapInArrow(run, f"{fields}, `{data}` binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the sha-256 of the ids and of the bytes decoded from them."""
    both = decoded(encoded(docs.select("doc_id", "text"), path, pattern), path, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
