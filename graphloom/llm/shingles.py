"""Word and shingle hashes of Arrow text columns, computed over whole batches with numpy.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. A shingle is K consecutive words; a text
with fewer words, but at least one, has a single shingle of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 5
#: Texts are worked on in slices of about so many bytes (a longer text is a slice by itself).
SLICE_BYTES = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FACTORS = mix(np.arange(1000, 1000 + 64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = _U(1)
    return np.cumprod(out)


def byte_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words per text) of all words of all texts, in order."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    first[inner] = solid[inner]  # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, counts
    at = np.flatnonzero(solid)
    word = np.cumsum(first[at]) - 1
    inside = at - starts[word]
    values = _TABLE[data[at]] * _powers(int(inside.max()) + 1)[inside]
    heads = np.searchsorted(at, starts)
    hashes = mix(np.add.reduceat(values, heads))
    lengths = np.diff(np.append(heads, len(at)))
    return hashes, starts, starts + lengths, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the first word, shingles per text)."""
    n = len(hashes)
    out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), out
    begin = np.cumsum(counts) - counts
    total = int(out.sum())
    text = np.repeat(np.arange(len(counts)), out)
    first = begin[text] + (np.arange(total) - np.repeat(np.cumsum(out) - out, out))
    acc = np.zeros(total, np.uint64)
    have = np.minimum(counts, k)[text]
    for j in range(k):
        acc += np.where(j < have, hashes[np.minimum(first + j, n - 1)] * _FACTORS[j], _U(0))
    return mix(acc + have.astype(np.uint64)), first, out


def weighted(sh: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, multiplicity) of the distinct shingles of each text, sorted."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((sh, text))
    text, sh = text[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], sh[at], np.diff(np.append(at, len(sh)))
