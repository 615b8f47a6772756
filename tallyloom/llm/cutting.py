"""Words of many texts at once, by classes of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Cut:
    """Maximal runs of the ``inside`` bytes, A-Z lower-cased, of every text; none crosses texts.

    ``names``: the distinct words (binary). ``codes``, ``starts``: the word of each place and
    where it begins in ``data``; text i is ``data[begins[i]:begins[i + 1]]``.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        self.begins = offsets - offsets[0]
        word = inside[self.data]
        self.edge = np.zeros(len(word) + 1, bool)
        self.edge[self.begins] = True
        self.starts = np.flatnonzero(word & (self.edge[:-1] | ~np.r_[False, word][:-1]))
        ends = np.flatnonzero(word & (self.edge[1:] | ~np.r_[word, False][1:])) + 1
        bounds = np.r_[0, np.cumsum(ends - self.starts)].astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[self.data[word]])])
        coded = words.dictionary_encode()
        self.names = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)

    def owners(self) -> np.ndarray:
        """The text each place belongs to."""
        return np.searchsorted(self.begins, self.starts, "right") - 1
