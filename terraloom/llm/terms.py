"""Terms of texts, cut by numpy on their UTF-8 bytes.

A term is a run of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. As all bytes of a character
beyond ASCII are 0x80 or more, a byte tells by itself whether it belongs to a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODES = np.arange(256)
_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
_INSIDE = _UPPER | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
_LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
#: Texts are handled in slices of about so many bytes; a longer text stays whole and ends its slice.
SLICE_BYTES = 8 << 20


def byte_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries without nulls, joined, and where each starts (one more at the end)."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of texts without nulls; then of each occurrence, in order, its term's number and its text's."""
    data, offsets = byte_parts(texts)
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1]
    starts = starts[starts < len(data)]
    first[starts] = inside[starts]
    begin = np.flatnonzero(first)
    kept = _LOWER[data[inside]]
    edges = np.append(np.flatnonzero(first[inside]), len(kept))
    found = binaries(kept, edges).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets[:-1], begin, "right") - 1


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.Table]:
    """The rows of all batches in tables of about SLICE_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        data, offsets = byte_parts(batch.column(text))
        cuts = np.flatnonzero(np.diff((size + offsets[1:]) // SLICE_BYTES, prepend=size // SLICE_BYTES)) + 1 if len(batch) else []
        at = 0
        for end in cuts:
            held.append(batch.slice(at, end - at))
            yield pa.Table.from_batches(held)
            held, at = [], end
        if at < len(batch):
            held.append(batch.slice(at))
        size = (size + len(data)) % SLICE_BYTES
    if held:
        yield pa.Table.from_batches(held)


def whole(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    column = table.column(name).cast(pa.large_string()).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
