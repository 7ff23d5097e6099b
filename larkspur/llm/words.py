"""Words of many texts at once, on UTF-8 bytes in numpy and Arrow."""

from __future__ import annotations

import numpy as np


def byte_class(separators) -> np.ndarray:
    """True for bytes that belong to words."""
    lut = np.ones(256, bool)
    lut[list(separators)] = False
    return lut


#: Digits, letters and everything beyond ASCII; upper case is folded first.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: All but white space.
NONSPACE = byte_class([0x20, *range(0x09, 0x0E)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lower-cased, and each text's end in them. texts: an Arrow string array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    total = int(offs[-1] - offs[0])
    buf = np.frombuffer(texts.buffers()[2], np.uint8, total, int(offs[0])) if total else np.zeros(0, np.uint8)
    return _FOLD[buf], offs[1:] - offs[0]


def spans(buf: np.ndarray, ends: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more than there are texts). No word reaches over a text's end."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = lut[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    if len(buf):
        at = ends[(ends > 0) & (ends < len(buf))]
        both = at[inside[1:-1][at] & inside[1:-1][at - 1]]
        first[both] = True
        last[both - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    before = np.concatenate([[0], np.searchsorted(start, ends)])
    return start, end, before


def word_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The words as an Arrow large_binary array."""
    import pyarrow as pa

    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(buf[keep]))])
