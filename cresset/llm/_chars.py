"""Character classes and code point views of Arrow text, for vectorised scanning."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: No letter or number lies in the planes from here on.
_LETTERS_END = 0x33480


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: other, letter (L*), number (N*) or white space."""
    out = np.zeros(0x110000, dtype=np.uint8)
    first = np.array([unicodedata.category(chr(i))[0] for i in range(_LETTERS_END)])
    out[:_LETTERS_END][first == "L"] = LETTER
    out[:_LETTERS_END][first == "N"] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to at most ``limit``; a larger single one has its own range."""
    ends = np.cumsum(sizes)
    start, done = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def text_sizes(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the length of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


def slices_of_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow binary array of the UTF-8 bytes of ``points[starts[i]:ends[i]]``, for ranges in order without overlap."""
    raw = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, dtype=np.int32)
    np.cumsum(width, out=at[1:])
    first, last = at[starts], at[ends]
    if len(starts) and not np.array_equal(first[1:], last[:-1]):  # gaps between the ranges are left out
        edge = np.zeros(len(raw) + 1, dtype=np.int8)
        edge[first] += 1
        edge[last] -= 1
        raw = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    elif len(starts):
        raw = raw[first[0] : last[-1]]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(last - first, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
