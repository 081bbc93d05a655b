"""Static range asymmetric numeral system over token ids, in interleaved lanes.

Lane j of a block holds its ids j, j + lanes, j + 2 lanes, …; a row is one id of each lane. All lanes share one
frequency table of 2**BITS slots and one stream of 32-bit words. After every `every` rows the states of the lanes and
the place in the stream are kept with a CRC-32 of the ids up to the next such checkpoint, so that stretches between
checkpoints can be decoded apart and are verified apart.

A block in bytes, all little-endian: ids, lanes, every, words as uint32; for each checkpoint a uint32 place and CRC;
the lane states of all checkpoints as uint64; the words as uint32.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LOW = np.uint64(1 << 31)
LANES, ROWS_A_LANE, EVERY = 4096, 128, 128
_WORD, _SHIFT, _MASK = np.uint64(32), np.uint64(BITS), np.uint64((1 << BITS) - 1)


@dataclass
class Table:
    """Slots of each id (zero: the id does not occur) and where they begin."""

    freq: np.ndarray
    first: np.ndarray
    of_slot: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Frequencies that sum to 2**BITS; an id that occurs has one slot at least."""
        total, some = int(counts.sum()), counts > 0
        if some.sum() > 1 << BITS:
            raise ValueError("more ids than slots")
        freq = np.where(some, np.maximum(1, counts.astype(float) * (1 << BITS) / max(total, 1)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        excess = int(freq.sum()) - (1 << BITS) if total else 0
        for k in order:  # from the most frequent ids, which bear it best
            if not excess:
                break
            change = min(excess, max(0, int(freq[k]) - 1) // 2 + 1 if freq[k] > 1 else 0) if excess > 0 else excess
            freq[k] -= change
            excess -= change
        if excess:
            return cls.of_counts(np.where(some, 1, 0))
        first = np.cumsum(freq) - freq
        return cls(freq.astype(np.uint64), first.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // ROWS_A_LANE))
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = [None] * rows
    states = {}
    for r in range(rows - 1, -1, -1):
        own = ids[r * lanes : (r + 1) * lanes]
        f, x = table.freq[own], state[: len(own)]
        over = x >= (f << np.uint64(63 - BITS))
        chunks[r] = x[over].astype(np.uint32)
        x = np.where(over, x >> _WORD, x)
        q = x // f
        state[: len(own)] = (q << _SHIFT) + (x - q * f) + table.first[own]
        if r % EVERY == 0:
            states[r] = state.copy()
    sizes = np.cumsum([0, *map(len, chunks)])
    marks = list(range(0, rows, EVERY))
    heads = b"".join(struct.pack("<II", sizes[r], zlib.crc32(ids[r * lanes : (r + EVERY) * lanes].astype("<u4"))) for r in marks)
    words = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
    head = struct.pack("<IIII", n, lanes, EVERY, len(words))
    return head + heads + b"".join(states[r].astype("<u8").tobytes() for r in marks) + words.astype("<u4").tobytes()


def checkpoints(block: bytes) -> int:
    n, lanes, every, _ = struct.unpack_from("<IIII", block)
    return -(-(-(-n // lanes)) // every)


def decode(block: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids between two checkpoints (all by default), each stretch held against its checksum."""
    n, lanes, every, size = struct.unpack_from("<IIII", block)
    marks = checkpoints(block)
    stop = marks if stop is None else stop
    heads = np.frombuffer(block, "<u4", 2 * marks, 16).reshape(-1, 2)
    states = np.frombuffer(block, "<u8", marks * lanes, 16 + 8 * marks).reshape(-1, lanes)
    words = np.frombuffer(block, "<u4", size, 16 + 8 * marks * (1 + lanes))
    out = np.empty(max(0, min(n, stop * every * lanes) - start * every * lanes), np.uint32)
    filled = 0
    for mark in range(start, stop):
        state, at, begin = states[mark].copy(), int(heads[mark, 0]), filled
        for r in range(mark * every, min((mark + 1) * every, -(-n // lanes))):
            m = min(lanes, n - r * lanes)
            x = state[:m]
            slot = x & _MASK
            ids = table.of_slot[slot]
            x = table.freq[ids] * (x >> _SHIFT) + slot - table.first[ids]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << _WORD) | words[at : at + len(low)]
            at += len(low)
            state[:m] = x
            out[filled : filled + m] = ids
            filled += m
        if zlib.crc32(out[begin:filled].astype("<u4")) != heads[mark, 1]:
            raise ValueError(f"checksum of stretch {mark} differs")
    return out
