"""Token ids of whole texts, each distinct piece encoded once a worker.

A tokenizer that cuts texts into pieces before it merges gives a piece the same ids wherever it
stands, so the batch's distinct pieces are looked up in a bounded cache and gathered by arrays.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textbatch as tb

#: Texts are cut into larger blocks here: pieces repeat more.
ENCODE_BYTES = 4 << 20
#: Distinct pieces that a worker remembers; beyond it starts anew.
CACHE_PIECES = 700_000
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


class PieceEncoder:
    """Encodes blocks of texts. ``cut`` gives the byte spans of the pieces, ``encode`` maps a list of
    pieces to their ids."""

    def __init__(self, cut: Callable[[tb.Block], Spans], encode: Callable[[list[bytes]], Sequence[Sequence[int]]], cache_pieces: int = CACHE_PIECES):
        self.cut, self.encode, self.cache_pieces = cut, encode, cache_pieces
        self.known: dict[bytes, bytes] = {}

    def block(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block's texts: the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        starts, ends, text = self.cut(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(block) + 1, np.int64)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        # bytes between pieces are left out: +1 where pieces start, -1 where they end
        inside = np.zeros(len(block.data) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        data = block.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy()
        known = self.known
        got = list(map(known.get, distinct))
        new = [i for i, ids in enumerate(got) if ids is None]
        if new:
            if len(known) + len(new) > self.cache_pieces:
                known.clear()
            for i, ids in zip(new, self.encode([distinct[i] for i in new]), strict=True):
                got[i] = known[distinct[i]] = array("I", ids).tobytes()
        flat = np.frombuffer(b"".join(got), np.uint32)
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(n) - n
        count = n[code]
        to = np.cumsum(count)
        ids = flat[np.repeat(first[code] - (to - count), count) + np.arange(to[-1])]
        return ids, np.concatenate([[0], to])[np.searchsorted(text, np.arange(len(block) + 1))]
