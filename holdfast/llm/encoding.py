"""Tokenising whole texts inside a task, each distinct pre-token once.

A text is cut at its single spaces. A space between two other characters always begins
a pre-token, so the pieces tokenise on their own; texts with white space in a row, or
with rare control characters, are pre-tokenised whole instead. Arrow finds the distinct
pieces of a block, a bounded memo keeps the ids of pre-tokens, and the ids of all texts
are gathered with numpy.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from holdfast.llm.tables import spread

MEMO_ENTRIES = 1 << 17
BLOCK_BYTES = 4 << 20
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}|[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]|<\|"

# The printable stand-ins of bytes in byte-level vocabularies.
_KEPT = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_MOVED = [b for b in range(256) if b not in _KEPT]
STAND_INS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(_MOVED)}


# Marks that end a word and are one pre-token together; an apostrophe can begin another kind.
MARKS = ".,;:!?%$&*#|"


def is_latin(piece: str) -> bool:
    """Characters that normalisation leaves alone and that lower-case one by one."""
    try:
        piece.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memo(dict):
    """Ids by pre-token as bytes; when full, entries unused for a generation are forgotten."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def as_ids(ids: list[int]) -> bytes:
    """Four bytes an id, in the byte order of the machine (little-endian wherever Spark runs)."""
    return array("I", ids).tobytes()


class LibraryEncoder:
    """Ids of a vocabulary file of the tokenizers library.

    The library's own model merges each pre-token; ``lowered`` is for the vocabulary that
    normalises and drops white space, else spaces lead their words.
    """

    def __init__(self, path: str, lowered: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memo stands in for the library's small cache
        self.lowered = lowered
        self.memo = Memo(self._merge)
        space = r"\p{White_Space}"
        words = (
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
            if lowered
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.findall = regex.compile(words.replace(r"[^\s", f"[^{space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", space)).findall

    def _merge(self, pre_token: str) -> bytes:
        plain = pre_token.isascii() and pre_token.isalnum()  # each byte is its own stand-in
        mapped = pre_token if plain else pre_token.encode("utf-8").decode("latin-1").translate(STAND_INS)
        return as_ids([t.id for t in self.model.tokenize(mapped)])

    def whole(self, text: str) -> bytes:
        return as_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, lead: str, piece: str) -> bytes:
        if self.lowered:
            piece = piece.lower() if piece.isascii() or is_latin(piece) else self.tokenizer.normalizer.normalize_str(piece)
        memo = self.memo
        word = piece.rstrip(MARKS)
        if word.isalpha():
            return memo[lead + word] + memo[piece[len(word) :]] if len(word) < len(piece) else memo[lead + word]
        return b"".join(map(memo.__getitem__, self.findall(lead + piece)))


def encode(encoder, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts as uint32 and the number of ids of each; a null is an empty text."""
    text = text.fill_null("")
    if len(text) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    unsafe = pc.match_substring_regex(text, UNSAFE).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(text if not unsafe.any() else pc.if_else(pa.array(unsafe), "", text), " ")
    bounds = cut.offsets.to_numpy().astype(np.int64)
    pieces = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds -= bounds[0]
    codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = bounds[:-1]
    lead = "" if encoder.lowered else " "
    # numpy makes strings of a whole array at once, to_pylist a scalar for each.
    tables = [encoder.piece(lead, p) for p in pieces.dictionary.to_numpy(zero_copy_only=False)]
    n_tables = len(tables)
    # The first piece of a text has no space before it; an unsafe text is one piece of its own.
    heads = pieces.dictionary.take(pa.array(codes[first])).to_numpy(zero_copy_only=False)
    if not encoder.lowered:
        own = {}
        for i, head in enumerate(heads):
            codes[first[i]] = own.setdefault(head, n_tables + len(own))
        tables += [encoder.piece("", head) if head else b"" for head in own]
    for i in np.flatnonzero(unsafe):
        codes[first[i]] = len(tables)
        tables.append(encoder.whole(text[int(i)].as_py()))
    lengths = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
    flat = np.frombuffer(b"".join(tables), dtype="<u4")
    starts = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ids = flat[spread(starts[codes], n)]
    sums = np.concatenate(([0], np.cumsum(n)))
    return ids, sums[bounds[1:]] - sums[bounds[:-1]]


_encoders: dict[tuple, object] = {}


def encoder_of(kind, *args):
    """One encoder in each Python worker, its memo kept from task to task."""
    key = (kind, *args)
    if key not in _encoders:
        _encoders[key] = kind(*args)
    return _encoders[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text, and the counts with it."""
    out = np.full(len(ids) + len(counts), end, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1
