"""Simple-8b word-aligned coding of unsigned integers, vectorised.

A 64-bit word holds a selector in its top four bits and up to 60 payload bits:
selector s packs ``COUNTS[s]`` values of ``BITS[s]`` bits each, lowest bits
first. Selector 0 is the escape: its payload is the index of a full 64-bit
value in a list beside the words. Values are coded in blocks of ``BLOCK``; each
block starts on a word of its own, whose offset is kept, so blocks decode
independently of each other and all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 240
# fixed values: the classic selector table without its zero runs; selector 0 escapes
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U64 = np.uint64
_BIT_LENGTH = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word offset of every block, and the escaped values."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    longest = int(COUNTS.max())
    width = BLOCK + longest
    narrow = np.uint32 if values.max() < 1 << 32 else np.uint64
    padded = np.zeros((blocks, width), dtype=narrow)
    flat = np.zeros(blocks * BLOCK, dtype=narrow)
    flat[:n] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    choice = _selectors(padded)
    # walk all blocks in step: at each step every unfinished block emits a word
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    packs = COUNTS[choice]
    at = np.zeros(blocks, dtype=np.int64)
    alive = np.arange(blocks)
    emitted, steps = [], np.zeros(blocks, dtype=np.int64)
    while len(alive):
        here = at[alive]
        emitted.append((alive, here))
        steps[alive] += 1
        at[alive] = here + packs[alive, here]
        alive = alive[at[alive] < size[alive]]
    first = np.cumsum(steps) - steps
    where = np.empty(int(steps.sum()), dtype=np.int64)
    for step, (block, here) in enumerate(emitted):
        where[first[block] + step] = block * width + here
    selector = choice[where // width, where % width]
    source = padded.ravel()
    words = selector.astype(np.uint64) << _U64(60)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            from_, packed = where[rows], np.zeros(len(rows), dtype=np.uint64)
            for k in range(COUNTS[s]):
                packed |= source[from_ + k].astype(np.uint64) << _U64(BITS[s] * k)
            words[rows] |= packed
    rows = np.flatnonzero(selector == 0)
    words[rows] |= np.arange(len(rows), dtype=np.uint64)
    return words, first, source[where[rows]].astype(np.uint64)


def _selectors(padded: np.ndarray) -> np.ndarray:
    """For every place of the blocks, the selector that packs most values from there."""
    # the exponent of a double is the bit length, or one more where a large value rounds up
    if padded.max() < len(_BIT_LENGTH):
        bits = _BIT_LENGTH[padded]
    else:
        bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    fit = np.zeros((len(padded), BLOCK), dtype=np.int8)
    # reach: the largest bit length among the next `have` values; every count is
    # at most twice the one before, so two overlapping runs give the next reach
    reach, have = bits, 1
    for s in range(len(COUNTS) - 1, 0, -1):
        more = int(COUNTS[s]) - have
        if more:
            reach, have = np.maximum(reach[:, :-more], reach[:, more:]), have + more
        fits = reach[:, :BLOCK] <= BITS[s]
        if not fits.any():
            break
        fit += fits
    # a count that fits means that every smaller one does
    return np.where(fit > 0, len(COUNTS) - fit, 0)


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n values of ``encode``."""
    words = np.asarray(words, dtype=np.uint64)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    selector = (words >> _U64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    place = ends - counts
    place = place - place[offsets][block]  # within the block
    # room for what the last word of a block packs beyond its end
    width = BLOCK + int(COUNTS.max())
    start = block * width + place
    out = np.zeros(len(offsets) * width, dtype=np.uint64)
    payload = words & _U64((1 << 60) - 1)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            mask = _U64((1 << int(BITS[s])) - 1)
            to, packed = start[rows], payload[rows]
            for k in range(COUNTS[s]):
                out[to + k] = (packed >> _U64(BITS[s] * k)) & mask
    rows = np.flatnonzero(selector == 0)
    out[start[rows]] = np.asarray(escaped, dtype=np.uint64)[payload[rows].astype(np.int64)]
    return out.reshape(-1, width)[:, :BLOCK].ravel()[:n]
