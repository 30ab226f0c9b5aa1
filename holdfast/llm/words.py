"""Distinct words of a block of texts, found by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, each word's number in order, and where texts begin and end.

    A null text has no words; empty strings (at white space around a text) may be among the words.
    """
    cut = pc.ascii_split_whitespace(text.fill_null(""))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    words = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0]


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, one for each text; zero for a text without rows."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]
