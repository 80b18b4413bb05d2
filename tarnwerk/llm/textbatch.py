"""Array views of text columns: bytes, words and their hashes without a Python object per word.

Every function works on one Arrow column of texts at a time and handles nulls (as empty texts),
empty texts and empty columns. Buffers are cut into blocks of a bounded number of bytes, so the
memory of a task follows the block size (or the single longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SEPARATOR = 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z share those of a-z."""
    out = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
    if fold_case:
        out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse modulo 2**64."""
    key = int(inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = max(n, BLOCK_BYTES + (1 << 16)) if n <= 4 * BLOCK_BYTES else n
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * BLOCK_BYTES:  # too long to keep
            return have[:n]
        _powers[key] = have
    return have[:n]


@dataclass
class Block:
    """Consecutive texts of a batch in one buffer, each followed by a separator byte."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Polynomial prefix sums; see ``span_hash``."""
        out = np.empty(len(self.data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(values[self.data] * powers(len(self.data)), out=out[1:])
        return out


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column, in blocks of at most ``block_bytes`` or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        to = min(to, n)
        starts = offsets[at:to] - offsets[at] + np.arange(to - at)
        ends = offsets[at + 1 : to + 1] - offsets[at] + np.arange(to - at)
        data = np.full(int(ends[-1]) + 1, SEPARATOR, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[ends] = False
        data[keep] = raw[offsets[at] : offsets[to]]
        yield Block(at, data, starts, ends)
        at = to


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes and lengths wherever they stand."""
    inverse = powers(len(prefix), inverse=True)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def spans(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]`` true: starts, ends and the text of each.
    The separator must not be inside."""
    flags = np.zeros(len(block.data) + 2, dtype=np.int8)
    flags[1:-1] = inside[block.data]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, ends, np.searchsorted(block.starts, starts, side="right") - 1


def word_bytes() -> np.ndarray:
    """Bytes of words: all but the space and 0x09-0x0D."""
    out = np.ones(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def letter_bytes() -> np.ndarray:
    """Bytes of plain words: ASCII letters, digits and every byte of a longer code point."""
    out = np.zeros(256, dtype=bool)
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = out[ord("0") : ord("9") + 1] = True
    out[128:] = True
    return out
