"""Vectorised word helpers over the byte buffer of an Arrow string column.

Python workers get whole Arrow batches. The functions here work on a batch's
UTF-8 buffer with numpy, so no Python object is made per word; ``slices`` cuts
a batch by bytes, which bounds a worker's memory however long the texts are
(a single longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# the six characters that separate words: space and U+0009..U+000D
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U64 = np.uint64

_RNG = np.random.default_rng(20240117)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
_PLACE_KEYS = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | _U64(1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most max_bytes of text (at least one row each)."""
    if batch.num_rows == 0:
        return
    _, at = utf8(batch.column(text))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + max_bytes, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Pieces:
    """Pieces of a slice's texts in order: concatenated bytes, n + 1 offsets and
    the number of pieces of each text."""

    data: np.ndarray
    offsets: np.ndarray
    per_text: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first piece, and the end."""
        return np.concatenate([[0], np.cumsum(self.per_text)])

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """Codes of the pieces, and the distinct pieces (binary)."""
        n = len(self.offsets) - 1
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(self.offsets, dtype=np.int64)),
                                   pa.py_buffer(np.ascontiguousarray(self.data))])
        coded = made.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self) -> np.ndarray:
        return hash_pieces(self.data, self.offsets)


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Pieces:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; lower maps A-Z only."""
    inside = ~_IS_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    start[first] = inside[first]
    per_text = np.diff(np.searchsorted(np.flatnonzero(start), at))
    kept = data[inside]
    offsets = np.append(np.flatnonzero(start[inside]), len(kept))
    return Pieces(_LOWER[kept] if lower else kept, offsets, per_text)


def chunks(data: np.ndarray, at: np.ndarray) -> Pieces:
    """Texts cut in front of every ASCII white space that follows a character
    which is surely no white space itself.

    A byte-level BPE pre-tokenizer always ends a piece there and matches what
    follows independently of what went before, so the chunks' ids, joined,
    are the text's ids.
    """
    n = len(data)
    cut = _IS_SPACE[data]
    if n:
        before = np.empty(n, dtype=np.uint8)
        before[0], before[1:] = 32, data[:-1]
        # after ASCII, or after the two-byte letters from U+00C0 on
        sure = (before > 32) & (before < 127)
        wide = np.zeros(n, dtype=bool)
        wide[2:] = (before[2:] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        cut = cut & (sure | wide)
        cut[at[:-1][at[1:] > at[:-1]]] = True
    starts = np.flatnonzero(cut)
    return Pieces(data, np.append(starts, n), np.diff(np.searchsorted(starts, at)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64-bit words."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def hash_pieces(data: np.ndarray, offsets: np.ndarray, run_bytes: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of non-empty pieces: multilinear over (byte, place), then
    mixed. Some pieces at a time, as the terms take many times a piece's bytes."""
    out = np.zeros(max(len(offsets) - 1, 0), dtype=np.uint64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + run_bytes, side="right")) - 1)
        out[lo:hi] = _hash_run(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi
    return out


def _hash_run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], sizes)
    with np.errstate(over="ignore"):
        terms = _BYTE_KEYS[data] * _PLACE_KEYS[place & 4095]
        if sizes.max() > 4096:
            terms *= (2 * (place >> 12) + 1).astype(np.uint64)
        return mix(np.add.reduceat(terms, offsets[:-1]) + sizes.astype(np.uint64) * _U64(0x9E3779B97F4A7C15))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def list_array(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values per row."""
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
