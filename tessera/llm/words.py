"""Words of a run of texts as arrays, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
WHITE = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def array_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) of consecutive runs of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if stop > start:
            yield start, texts.slice(start, stop - start)


@dataclass
class Words:
    """``words`` of all texts in order, the number ``text`` of each word's text
    and ``piece``, equal for words of one text with no break between them."""

    words: pa.Array
    text: np.ndarray
    piece: np.ndarray

    def codes(self, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """A number per word, equal for equal words, and the word of each number."""
        part = self.words.slice(start, None if stop is None else stop - start).dictionary_encode()
        return part.indices.to_numpy().astype(np.int64), part.dictionary


def split_words(texts: pa.Array, space: bytes = WHITE, breaks: bytes = b"", lower: bool = False) -> Words:
    """Cut ``texts`` (null: empty) at the ASCII characters of ``space`` and
    ``breaks``; ``lower`` turns A-Z into lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    gap, stop = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    gap[list(space + breaks)] = True
    stop[list(breaks)] = True
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)          # a text begins here
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = text + (np.cumsum(stop[data])[starts] if breaks and len(starts) else 0)
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    if at[-1] < 2**31:
        words = words.cast(pa.string())
    return Words(words, text, piece)
