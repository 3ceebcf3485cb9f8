"""Words, word hashes and word windows of Arrow text columns, over whole batches by NumPy.

Words are maximal runs of bytes outside space and 0x09-0x0D, which is `[^\\x20\\x09-\\x0D]+` on UTF-8.
A word's hash is a polynomial over its bytes modulo 2**64, mixed; a window's is one over its words' hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the 8-byte arrays made beside the text.
SPAN = 1 << 21
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_TABLE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading 0."""
    out = np.empty(len(x) + 1, np.uint64)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


@dataclass
class Words:
    """Words of some documents: data[start:end] are their bytes, those of document d are first[d]:first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they lie in one document."""
        n = len(self.hash)
        inside = np.zeros(n, bool)
        if n < k:
            return np.zeros(n, np.uint64), inside
        up, down = powers(_STEP, n + 1)
        total = sums(self.hash * up[:n])
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))
        stop = np.repeat(self.first[1:], np.diff(self.first))
        inside[:] = np.arange(n) + k <= stop
        return out, inside

    def whole(self, d: int) -> np.uint64:
        """The hash of all words of document d as one window."""
        h = self.hash[self.first[d] : self.first[d + 1]]
        return mix(np.array([(h * powers(_STEP, len(h) + 1)[0][: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))[0]


def _buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = powers(_BASE, b - a + 1)
        total = sums(_TABLE[data[a:b]] * up[: b - a])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are inside; texts begin and end at `at`, and no run goes over an end."""
    solid = np.zeros(len(inside) + 2, np.int8)
    solid[1:-1] = inside
    turn = np.diff(solid)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # a word that runs over the end of a text is two words
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(inside))])
    cut = cut[(solid[cut] == 1) & (solid[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    """The words of each text; null counts as empty. lower: A-Z become a-z first."""
    data, at = _buffers(texts)
    if not len(texts):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    data = data[at[0] : at[-1]]
    at = at - at[0]
    if lower:
        data = lowered(data)
    start, end = spans(solid(data), at)
    return Words(data, start, end, np.searchsorted(start, at), word_hashes(data, start, end))


@dataclass
class Coded:
    """Words of some documents as numbers: those of document d are code[first[d]:first[d + 1]], and vocabulary[code] is their bytes. Equal numbers are equal words."""

    code: np.ndarray
    first: np.ndarray
    vocabulary: pa.Array


def solid(data: np.ndarray) -> np.ndarray:
    """Whether bytes are of words `[^\\x20\\x09-\\x0D]+`."""
    return (data != 32) & ((data < 9) | (data > 13))


def coded(texts: pa.Array | pa.ChunkedArray, inside: Callable[[np.ndarray], np.ndarray] = solid, lower: bool = False) -> Coded:
    """The maximal runs of bytes that are inside, as numbers; null counts as empty. lower: A-Z become a-z first."""
    data, at = _buffers(texts)
    data = data[at[0] : at[-1]]
    at = at - at[0]
    if lower:
        data = lowered(data)
    held = inside(data)
    start, end = spans(held, at)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data[held]))]).dictionary_encode()
    return Coded(found.indices.to_numpy().astype(np.int64), np.searchsorted(start, at), found.dictionary)


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """batch in pieces of about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over bytes that are already in order."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
