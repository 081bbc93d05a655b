"""Token ids of many texts by way of their distinct pieces: each piece is tokenised once per worker, then looked up.

A piece is a stretch of text that a tokenizer never joins with its neighbours, so the ids of a text are those of its
pieces in order. The memory of pieces is bounded and only saves work: it changes no result. No pieces give no ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class Pieces(dict):
    """Ids of pieces as bytes, tokenised when first asked for. When it holds `limit` pieces they become the old ones,
    of which those that are asked for again come back; the older ones before them go."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 200_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        found = self[piece] = self.encode(piece) if found is None else found
        return found


def ids_of(pieces: pa.Array, lookup: Callable[[str], bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a string array's values in order, and the end of each value's ids among them."""
    coded = pieces.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    found = list(map(lookup, coded.dictionary.to_pylist()))
    flat = np.frombuffer(b"".join(found), dtype)
    size = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(dtype).itemsize
    first = np.cumsum(size) - size
    count = size[codes]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first[codes] - (ends - count), count) + np.arange(total)
    return flat[at], ends


def ends_of_rows(offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each list's ids end, from the list offsets and the end of each element."""
    padded = np.concatenate([[0], ends])
    return padded[offsets[1:]]
