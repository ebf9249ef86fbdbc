"""Distinct-piece tables by block: a join of every piece of every text with a
table of distinct pieces that moves each block's distinct pieces only.

Tasks cut their documents into blocks of at most ``BLOCK_BYTES`` of text and
code each text's pieces (words, chunks) as positions in the block's list of
distinct pieces. Two messages leave a block:

* ``piece_messages``: per (block, bucket) the block's distinct pieces of that
  hash bucket with their counts; grouped by bucket, every distinct piece of
  the corpus meets exactly once and gets its value;
* ``block_rows``: the documents' ids and coded pieces.

``joined`` brings a block's codes and its pieces' values together again. A
block's pieces are numbered bucket by bucket, so the values need no keys.
Buckets and blocks are bounded whatever the keys' skew: a word in a third of
all places is one entry per block. Both messages are made from the same scan
of the input, which must give the same rows in the same order twice (a table
or a written intermediate); a digest per block raises if it does not.
``rows_and_messages`` makes both from one scan, for a written intermediate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._text import Pieces, gather, hash_pieces, slices, utf8

BLOCK_BYTES = 8 << 20
BUCKETS = 3


def shrink(values: np.ndarray) -> bytes:
    """Integers as zstd over their byte planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def grow(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(data).tobytes())


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)


@dataclass
class Block:
    block: int
    doc_ids: pa.Array
    per_text: np.ndarray
    codes: np.ndarray        # of every piece, into the distinct pieces
    data: np.ndarray         # distinct pieces, bucket by bucket
    offsets: np.ndarray
    bucket_of: np.ndarray
    extra: pa.RecordBatch    # the slice itself

    @property
    def digest(self) -> int:
        total = hash_pieces(self.data, self.offsets).sum(dtype=np.uint64) + np.uint64(len(self.codes))
        return int(total.astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], cut: Callable[[np.ndarray, np.ndarray], Pieces],
            buckets: int) -> Iterator[Block]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            pieces = cut(*utf8(part.column("text")))
            codes, distinct = pieces.distinct()
            at = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[:len(distinct) + 1]
            raw = distinct.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
            bucket_of = (hash_pieces(data, at) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket_of, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            sizes = np.diff(at)[order]
            yield Block(number, part.column("doc_id"), pieces.per_text, rank[codes] if len(codes) else
                        np.zeros(0, np.uint32), data[gather(at[:-1][order], sizes)],
                        np.concatenate([[0], np.cumsum(sizes)]), bucket_of[order], part)
            number += 1


def bucket_count(docs: DataFrame) -> int:
    """Buckets grow as a vocabulary does, slower than the input: a block sends a
    message to each, so with as many buckets as blocks messages would be many
    and tiny."""
    return max(8, math.ceil(BUCKETS * docs.rdd.getNumPartitions() ** 0.6))


MESSAGES = "block LONG, bucket INT, n LONG, digest LONG, pieces BINARY, sizes BINARY, counts BINARY"
_MESSAGES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("digest", pa.int64()),
                       ("pieces", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])
BLOCKS = "block LONG, digest LONG, doc_ids ARRAY<LONG>, per_text ARRAY<INT>, codes BINARY"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                           ("per_text", pa.list_(pa.int32())), ("codes", pa.binary())])


def _pieces(b: Block, buckets: int, weight: str | None) -> Iterator[dict]:
    """The block's distinct pieces with their counts, a message for each bucket."""
    times = np.ones(len(b.per_text)) if weight is None else b.extra.column(weight).to_numpy(zero_copy_only=False)
    counts = np.bincount(b.codes, weights=np.repeat(times, b.per_text),
                         minlength=len(b.bucket_of)).astype(np.uint32)
    digest = b.digest
    edges = np.searchsorted(b.bucket_of, np.arange(buckets + 1))
    sizes = np.diff(b.offsets)
    for k in range(buckets):
        lo, hi = int(edges[k]), int(edges[k + 1])
        if lo < hi:
            yield {"block": b.block, "bucket": k, "n": hi - lo, "digest": digest,
                   "pieces": squeeze(b.data[b.offsets[lo]:b.offsets[hi]]),
                   "sizes": shrink(sizes[lo:hi].astype(np.uint32)),
                   "counts": shrink(counts[lo:hi])}


def _row(b: Block, weight: str | None) -> dict:
    """The block's documents and coded pieces."""
    row = {"block": b.block, "digest": b.digest, "doc_ids": b.doc_ids.to_pylist(),
           "per_text": b.per_text.tolist(), "codes": shrink(b.codes)}
    return row if weight is None else {**row, "weights": b.extra.column(weight).to_pylist()}


def piece_messages(docs: DataFrame, cut, buckets: int, weight: str | None = None) -> DataFrame:
    """(block, bucket, pieces, sizes, counts); a column of weights, if named, says
    how often a text counts (default: once)."""
    def run(batches):
        for b in _blocks(batches, cut, buckets):
            for message in _pieces(b, buckets, weight):
                yield pa.RecordBatch.from_pylist([message], schema=_MESSAGES)
    return docs.mapInArrow(run, MESSAGES)


def block_rows(docs: DataFrame, cut, buckets: int, weight: str | None = None) -> DataFrame:
    """(block, digest, doc_ids, per_text, codes), and a column of weights, if named, as ``weights``."""
    schema = _BLOCK_SCHEMA if weight is None else _BLOCK_SCHEMA.append(pa.field("weights", pa.list_(pa.int32())))

    def run(batches):
        for b in _blocks(batches, cut, buckets):
            yield pa.RecordBatch.from_pylist([_row(b, weight)], schema=schema)
    return docs.mapInArrow(run, BLOCKS if weight is None else BLOCKS + ", weights ARRAY<INT>")


def rows_and_messages(docs: DataFrame, cut, buckets: int, weight: str) -> DataFrame:
    """``piece_messages`` and, with a null bucket, ``block_rows`` from one scan, to be written and read twice."""
    schema = pa.schema([*_MESSAGES, *[f for f in _BLOCK_SCHEMA if f.name not in ("block", "digest")],
                        ("weights", pa.list_(pa.int32()))])

    def run(batches):
        for b in _blocks(batches, cut, buckets):
            yield pa.RecordBatch.from_pylist([_row(b, weight)], schema=schema)
            for message in _pieces(b, buckets, weight):
                yield pa.RecordBatch.from_pylist([message], schema=schema)
    return docs.mapInArrow(run, MESSAGES + ", doc_ids ARRAY<LONG>, per_text ARRAY<INT>, codes BINARY, weights ARRAY<INT>")


def bucket_pieces(table: pa.Table) -> tuple[np.ndarray, pa.Array, list[int]]:
    """Of one bucket's messages: codes of all entries into the bucket's distinct
    pieces, those pieces, and the number of entries of each message."""
    data, sizes, ns = [], [], []
    for row in table.select(["pieces", "sizes", "n"]).to_pylist():
        data.append(expand(row["pieces"]))
        sizes.append(grow(row["sizes"], np.uint32).astype(np.int64))
        ns.append(row["n"])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    codes, distinct = Pieces(np.concatenate(data), offsets, np.array([len(offsets) - 1])).distinct()
    return codes, distinct, ns


def joined(blocks: DataFrame, values: DataFrame, combine: Callable[[dict, list[dict]], Iterator[pa.RecordBatch]],
           schema: str) -> DataFrame:
    """combine(block's row, its value rows in bucket order) for every block."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def run(left, right):
        made = []
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        for row in left.to_pylist():
            if any(r["digest"] != row["digest"] for r in rows) or (row["codes"] and not rows and len(grow(row["codes"], np.uint32))):
                raise ValueError("the input gave other rows when read again: write it to a table first")
            made.extend(combine(row, rows))
        return pa.Table.from_batches(made, schema=out) if made else out.empty_table()

    out = to_arrow_schema(_parse_datatype_string(schema))
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)


def runs(per_text: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a block's texts with at most so many pieces (or one text): bounds the memory of a step."""
    ends = np.cumsum(per_text)
    lo = 0
    while lo < len(per_text):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - per_text[lo] + most, side="right")))
        yield lo, hi
        lo = hi
