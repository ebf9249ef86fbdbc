"""Token ids of text chunks by the tokenizers library, cached per worker."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa

from ._text import gather

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
CACHE_CHUNKS = 1_000_000  # entries of a worker's cache; only speed depends on it


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of the chunks that ``_text.chunks`` cuts.

    New chunks are encoded many at a time as one text. Where the next chunk
    starts with ASCII white space and the one before ends in a sure character
    the tokenizer cuts anyway, so the joined text has the chunks' ids in order,
    and as the bytes of a text's pieces add up to the text, the pieces' lengths
    tell which ids belong to which chunk. Other chunks are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = id_bytes(self.tokenizer)
        self.piece_size = np.array([len(x) for x in self.pieces], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        """Known chunks by number, and the numbers' sizes and ids."""
        self.seen: dict[bytes, int] = {}
        self.size, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def encode(self, distinct: pa.Array, remember: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids one after the other."""
        if not remember:
            return self._encode_new(distinct)
        chunks = distinct.to_pylist()
        at = np.fromiter(map(self.seen.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            sizes, ids = self._encode_new(distinct.take(pa.array(new)))
            at[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.size, self.ids = np.append(self.size, sizes), np.append(self.ids, ids)
        sizes = self.size[at]
        ids = self.ids[gather((np.cumsum(self.size) - self.size)[at], sizes)]
        if len(self.size) > CACHE_CHUNKS:
            self._forget()
        elif len(new):
            self.seen.update(zip([chunks[i] for i in new.tolist()], at[new].tolist(), strict=True))
        return sizes, ids

    def _ids(self, data: np.ndarray, edges: list[int], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the edges, and their numbers; so many texts are Python objects at a time."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(edges) - 1, at_once):
            texts = [data[a:b].tobytes().decode() for a, b in pairwise(edges[lo:lo + at_once + 1])]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_new(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(distinct)
        at = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset:distinct.offset + n + 1]
        raw = distinct.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        length = np.diff(at)
        joined = np.zeros(n, dtype=bool)
        some = np.flatnonzero(length > 1)
        last, before = data[at[some + 1] - 1], data[at[some + 1] - 2]
        # the last character is surely no white space (the rule of ``_text.chunks``)
        sure = (last > 32) & (last < 127) | (last >= 0x80) & (before >= 0xC3) & (before <= 0xDF)
        joined[some] = _ASCII_SPACE[data[at[some]]] & sure
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        sizes = np.zeros(n, dtype=np.int64)
        ends = np.cumsum(length[together])
        ids, _ = self._ids(data[gather(at[together], length[together])], [0, *ends[_JOINED - 1:-1:_JOINED].tolist(), *ends[-1:].tolist()],
                           _AT_ONCE // _JOINED)
        sizes[together] = np.diff(np.searchsorted(np.cumsum(self.piece_size[ids]), ends, side="right"), prepend=0)
        ends = np.cumsum(length[alone])
        others, sizes[alone] = self._ids(data[gather(at[alone], length[alone])], [0, *ends.tolist()], _AT_ONCE)
        # back in the chunks' order
        starts = np.empty(n, dtype=np.int64)
        order = np.concatenate([together, alone])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, np.concatenate([ids, others])[gather(starts, sizes)]


_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_JOINED = 500  # chunks encoded as one text
_AT_ONCE = 20_000  # chunks whose ids are Python objects at a time


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def id_bytes(tokenizer) -> list[bytes]:
    """Bytes by id of a byte-level vocabulary. Byte-level BPE writes each byte as
    one printable character: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on. Added tokens are plain text."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = added[i].encode() if i in added else bytes(byte_of[c] for c in token)
    return out
