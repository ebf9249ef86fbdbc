"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

Texts are split in front of white space (``_text.chunks``); every distinct
chunk of the corpus is encoded once, in its hash bucket, by the tokenizers
library; ids go back to the chunks' positions (``_blocks``). Decoding joins
ids with the vocabulary's id-to-piece table, whose size is the vocabulary's.

Scale: what is shuffled is each block's distinct chunks, their ids and the
coded texts, together less than the texts. No group depends on a word's
frequency. Defined results: null and empty texts have no ids and decode to the
empty text; rows with equal ids stay separate rows; an empty table gives an
empty result; a text of any length is handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _blocks
from ._bpe import encoder, tokenizer_path
from ._io import id_and_text, table
from ._ship import ship
from ._text import chunks, gather

_VALUES = "block LONG, bucket INT, digest LONG, sizes BINARY, ids BINARY"


def _bucket_ids(path: str):
    def run(key, group):
        codes, distinct, ns = _blocks.bucket_pieces(group)
        sizes, ids = encoder(path).encode(distinct, remember=False)  # each chunk meets here once
        starts = np.cumsum(sizes) - sizes
        made, at = [], 0
        for row, n in zip(group.select(["block", "bucket", "digest"]).to_pylist(), ns, strict=True):
            mine = codes[at:at + n]
            at += n
            made.append({**row, "sizes": _blocks.shrink(sizes[mine].astype(np.uint32)),
                         "ids": _blocks.shrink(ids[gather(starts[mine], sizes[mine])].astype(np.uint32))})
        return pa.Table.from_pylist(made, schema=pa.schema([
            ("block", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()),
            ("sizes", pa.binary()), ("ids", pa.binary())]))
    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids): every row's token ids, as the tokenizers library gives them."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text)
    buckets = _blocks.bucket_count(rows)
    messages = _blocks.piece_messages(rows, chunks, buckets).drop("counts")
    values = messages.groupBy("bucket").applyInArrow(_bucket_ids(tokenizer or tokenizer_path()), _VALUES)

    def combine(row, parts):
        per_text = np.array(row["per_text"], dtype=np.int64)
        sizes = np.concatenate([np.zeros(0, np.int64), *[_blocks.grow(p["sizes"], np.uint32).astype(np.int64) for p in parts]])
        ids = np.concatenate([np.zeros(0, np.uint32), *[_blocks.grow(p["ids"], np.uint32) for p in parts]])
        starts = np.cumsum(sizes) - sizes
        codes = _blocks.grow(row["codes"], np.uint32)
        ends = np.cumsum(per_text)
        for lo, hi in _blocks.runs(per_text):  # some documents at a time bounds the memory
            mine = codes[ends[lo] - per_text[lo]:ends[hi - 1]]
            doc = np.repeat(np.arange(hi - lo), per_text[lo:hi])
            n = np.bincount(doc, weights=sizes[mine], minlength=hi - lo).astype(np.int64)
            flat = ids[gather(starts[mine], sizes[mine])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"][lo:hi], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))],
                names=["doc_id", "ids"])

    return _blocks.joined(_blocks.block_rows(rows, chunks, buckets), values, combine, "doc_id LONG, ids ARRAY<INT>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _spelled(pieces: pa.Array, ids: np.ndarray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The pieces of ids joined, and where each document starts in them."""
    taken = pieces.take(pa.array(ids, pa.int64()))
    if not len(taken):
        return memoryview(b""), np.zeros(len(at), dtype=np.int64)
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[:len(taken) + 1]
    return memoryview(taken.buffers()[2] or b""), offsets[at]


def decode_documents(encoded: DataFrame, tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, ids) to (doc_id, n_tokens, text); with digests, to (doc_id,
    n_tokens, ids_sha256, decoded_sha256) of the decimal ids and the text."""
    path = tokenizer or tokenizer_path()
    ship(encoded.sparkSession)

    def run(batches):
        table_ = encoder(path).pieces
        pieces = pa.array(table_, pa.large_binary())
        decimal = pa.array([f"{i},".encode() for i in range(len(table_))], pa.large_binary())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids, at = _flat(batch.column("ids"))
                raw, ends = _spelled(pieces, ids, at)
                texts = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                counts = pa.array(np.diff(at), pa.int64())
                if digests:
                    text, cuts = _spelled(decimal, ids, at)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id"), counts,
                        pa.array([sha(text[a:max(a, b - 1)]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
                        pa.array([sha(t.encode()) for t in texts], pa.string())],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(texts, pa.string())],
                                                     names=["doc_id", "n_tokens", "text"])
        pa.default_memory_pool().release_unused()  # an idle worker gives it back
    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id LONG, n_tokens LONG, " + ("ids_sha256 STRING, decoded_sha256 STRING" if digests else "text STRING"))


def query(spark, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(table(spark, sf_dir, "documents")), digests=True)
