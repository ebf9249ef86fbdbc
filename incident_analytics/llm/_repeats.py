"""Repeated windows of fixed width inside tasks: sampled positions, deep-shallow
sorting, and the windows that two sorted neighbours share."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

from ._text import mix

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_FILL = 0xFF  # no byte of UTF-8: ends a string shorter than the others

STEP = 1 << 16


def _powers(base, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[_U64(1)], np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)])


_UP, _DOWN = _powers(_BASE, STEP + 1024), _powers(_INVERSE, STEP + 1024)


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start, place) over one text's bytes.

    Every window of ``width`` bytes has as its anchor the leftmost place of the
    least gram hash in it, so equal windows have anchors of equal key at equal
    distance. Consecutive windows with one anchor are one row.
    """
    found = []
    for lo in range(0, len(data) - width + 1, STEP):
        found.append([x + lo if k else x for k, x in enumerate(_anchors(data[lo:lo + STEP + width - 1], width, gram))])
    if not found:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, width: int, gram: int):
    n, span = len(data), width - gram + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U64(0)], np.cumsum((data + _U64(1)) * _UP[:n], dtype=np.uint64)])
        grams = mix((sums[gram:] - sums[:-gram]) * _DOWN[:n - gram + 1])
    blocks = -(-len(grams) // span)
    codes = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    # the place inside a block of span grams breaks ties to the left
    codes[:len(grams)] = grams & ~_U64(255)
    codes = codes.reshape(blocks, span) | np.arange(span, dtype=np.uint64)
    before = np.minimum.accumulate(codes, axis=1).ravel()
    after = np.minimum.accumulate(codes[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - width + 1)
    left, right = after[:len(start)], before[span - 1:span - 1 + len(start)]
    block = start // span * span
    in_left = (left >> _U64(8)) <= (right >> _U64(8))
    place = np.where(in_left, block + (left & _U64(255)).astype(np.int64),
                     (start + span - 1) // span * span + (right & _U64(255)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], first, np.append(first[1:], len(place)) - 1, place[first]


class BlindTrie:
    """Sorts strings of one length: inner nodes hold only the place of the first
    difference below them and a branch per byte there; a string goes down blindly,
    is compared once with the leaf it reaches and branches off at its difference."""

    def __init__(self):
        self.root = None

    def add(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = [len(string), string, [item]]
            return
        path, node = [], self.root
        while len(node) == 2:
            path.append(node)
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        differ = int.from_bytes(string) ^ int.from_bytes(node[1])
        if not differ:
            node[2].append(item)
            return
        depth = len(string) - (differ.bit_length() + 7) // 8
        while path and path[-1][0] >= depth:
            below = path.pop()
            if below[0] == depth:
                below[1][string[depth]] = [len(string), string, [item]]
                return
        other = node[1]
        child = path[-1][1][string[path[-1][0]]] if path else self.root
        branch = [depth, {other[depth]: child, string[depth]: [len(string), string, [item]]}]
        if path:
            path[-1][1][string[path[-1][0]]] = branch
        else:
            self.root = branch

    def items(self):
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield from node[2]


def deep_shallow_order(strings: np.ndarray, group: np.ndarray, shallow: int) -> np.ndarray:
    """Order of the rows of ``strings`` (n x length bytes) by group, then content.

    Multikey quicksort by words of eight bytes, all groups at once, to the
    shallow depth; what is still equal there goes through a blind trie each.
    """
    n, length = strings.shape
    wide = np.full((n, -(-length // 8) * 8), _FILL, dtype=np.uint8)
    wide[:, :length] = strings
    words = wide.view(">u8")
    order = np.argsort(group, kind="stable")
    part = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)]) if n else np.zeros(0, np.int64)
    depth = np.zeros(n, dtype=np.int64)          # in words, by position in order
    levels = min(-(-shallow // 8), words.shape[1])
    while True:
        sizes = np.bincount(part, minlength=part[-1] + 1 if n else 0)
        live = np.flatnonzero((sizes[part] > 1) & (depth < levels)) if n else []
        if not len(live):
            break
        head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        middle = head[part[live]] + sizes[part[live]] // 2
        mine = words[order[live], depth[live]]
        pivot = words[order[middle], depth[live]]
        side = (mine > pivot).astype(np.int8) - (mine < pivot) + 1
        full = np.ones(n, dtype=np.int8)
        full[live] = side
        deeper = depth.copy()
        deeper[live[side == 1]] += 1
        moved = np.lexsort((full, part))
        order, full, depth, old = order[moved], full[moved], deeper[moved], part[moved]
        part = np.concatenate([[0], np.cumsum((old[1:] != old[:-1]) | (full[1:] != full[:-1]))])
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [n]]) if n else np.zeros(1, np.int64)
    for lo, hi in pairwise(edges.tolist()):
        if hi - lo > 1:
            trie = BlindTrie()
            for item in order[lo:hi].tolist():
                trie.add(strings[item].tobytes(), item)
            order[lo:hi] = list(trie.items())
    return order


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of each pair of rows' common start."""
    differ = np.concatenate([a != b, np.ones((len(a), 1), dtype=bool)], axis=1)
    return differ.argmax(axis=1)


def _filled(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, back: bool) -> np.ndarray:
    """Rows of ``length`` bytes: size bytes from start on (or backwards from start - 1), then fill."""
    step = np.arange(length)
    at = start[:, None] + (-1 - step if back else step)
    return np.where(step < size[:, None], data[np.clip(at, 0, max(len(data) - 1, 0))], _FILL).astype(np.uint8)


def shared_windows(keys: np.ndarray, left: np.ndarray, starts: np.ndarray, data: np.ndarray, ends: np.ndarray,
                   width: int, gram: int) -> np.ndarray:
    """Which windows of different blocks of a key occur in another one.

    Block i holds the bytes data[ends[i]:ends[i + 1]] of ``starts[i]`` windows in
    a row; its anchor is ``left[i]`` bytes behind its first byte. Returns a
    boolean per block and distance of a window's start in front of the anchor.

    Sorted by what follows the anchor, then by what precedes it, and the other
    way round, a block's neighbours include the ones it shares most with on
    either side. Windows inside a neighbour's shared stretch occur in it;
    windows beyond the longest share on a side occur nowhere. Between the two,
    where no neighbour reaches but the two longest shares would, blocks of the
    key are grouped by the window itself.
    """
    n, span = len(keys), width - gram + 1
    size = np.diff(ends)
    right = size - left
    after = _filled(data, ends[:-1] + left, right, width, False)
    before = _filled(data, ends[:-1] + left, left, span - 1, True)
    group = np.unique(keys, return_inverse=True)[1]
    distance = np.arange(span)
    least, most = left - starts + 1, left
    shared = np.zeros((n, span), dtype=bool)
    best = {}
    for name, strings, depth in (("right", np.hstack([after, before]), gram + 16), ("left", np.hstack([before, after]), 16)):
        order = deep_shallow_order(strings, group, depth)
        a, b = order[:-1], order[1:]
        a, b = a[group[a] == group[b]], b[group[a] == group[b]]
        to_right = np.minimum(_common(after[a], after[b]), np.minimum(right[a], right[b]))
        to_left = np.minimum(_common(before[a], before[b]), np.minimum(left[a], left[b]))
        top = np.zeros(n, dtype=np.int64)
        for one in (a, b):
            np.maximum.at(top, one, to_right if name == "right" else to_left)
            shared[one] |= (distance >= width - to_right[:, None]) & (distance <= to_left[:, None])
        best[name] = top
    own = (distance >= least[:, None]) & (distance <= most[:, None])
    shared &= own
    open_ = own & ~shared & (distance >= width - best["right"][:, None]) & (distance <= best["left"][:, None])
    for g in np.unique(group[open_.any(axis=1)]):
        rows = np.flatnonzero(group == g)
        for d in np.flatnonzero(open_[rows].any(axis=0)):
            seen: dict[bytes, list[int]] = {}
            for i in rows[own[rows, d]]:
                at = ends[i] + left[i] - d
                seen.setdefault(data[at:at + width].tobytes(), []).append(i)
            for same in seen.values():
                if len(same) > 1:
                    shared[same, d] = True
    return shared
