"""Words of whole texts as Arrow arrays: runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from calorix.llm.shared import cut

#: The byte that each byte of a word becomes; 0 for bytes that separate words.
BYTES = np.zeros(256, np.uint8)
for _b in [*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]:
    BYTES[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    BYTES[_b] = _b + 32
#: Bytes of the texts that are cut into words at once (one text at least).
TEXT_BYTES = 1 << 21


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text that each is in; null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if at[-1] == at[0]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data = BYTES[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    ends = at - at[0]
    ok = data != 0
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    first[edges] = ok[edges]
    starts = np.flatnonzero(first)
    offsets = np.append(np.cumsum(ok, dtype=np.int32)[starts] - 1, np.count_nonzero(ok)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ok]))
    return words, np.searchsorted(ends[:-1], starts, "right") - 1


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, a few texts at a time."""
    for batch in batches:
        yield from cut(batch, text, most)
