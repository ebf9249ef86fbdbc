"""Token-id files: documents' ids, Simple-8b coded, in ascending document order.

A token file set is a Parquet table of pages. Texts are range-partitioned by
id and sorted, encoded by the tokenizers library (every distinct chunk of a
slice once), and each task writes its documents as pages of about
``PAGE_IDS`` ids: the documents' ids and id counts, Simple-8b words, per-block
word offsets and escaped values. ``shard`` and ``page`` order the pages. A page
decodes on its own; a document longer than a page is a page of its own.

Scale: one shuffle (the texts, by range). Where a document starts in the whole
stream follows from sums per shard (a row per task), sums within a shard, and
the page's own counts, so no window orders all rows in one task.

Defined results: null or empty text is the end id alone; a null id sorts
first; rows with equal ids are ordered by text; an empty table writes no page.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import simple8b
from ._bpe import encoder, tokenizer_path
from ._io import id_and_text, table
from ._ship import ship
from ._text import chunks, gather, slices, utf8

PAGE_IDS = 1 << 18
SLICE_BYTES = 6 << 20
PAGES = ("shard INT, page LONG, n_ids LONG, doc_ids ARRAY<LONG>, n_tokens ARRAY<INT>, "
         "words BINARY, blocks BINARY, escaped BINARY")


def _encode_slice(part: pa.RecordBatch, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice, the end id after each document, and the counts."""
    cut = chunks(*utf8(part.column("text")))
    codes, distinct = cut.distinct()
    sizes, ids = encoder(path).encode(distinct)
    starts = np.cumsum(sizes) - sizes
    # the end id is one more chunk, after the last chunk of each document
    sizes, starts = np.append(sizes, 1), np.append(starts, len(ids))
    ids = np.append(ids, np.uint32(end_id))
    codes = np.insert(codes, cut.first[1:], len(sizes) - 1)
    doc = np.repeat(np.arange(part.num_rows), cut.per_text + 1)
    counts = np.bincount(doc, weights=sizes[codes], minlength=part.num_rows).astype(np.int64)
    return ids[gather(starts[codes], sizes[codes])], counts


def _pages(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        page = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = _encode_slice(part, path, end_id)
                ends = np.cumsum(counts)
                names = part.column("doc_id").to_pylist()
                row = 0
                while row < part.num_rows:
                    before = ends[row] - counts[row]
                    last = max(row + 1, int(np.searchsorted(ends, before + PAGE_IDS, side="right")))
                    words, blocks, escaped = simple8b.encode(ids[before:ends[last - 1]])
                    yield pa.RecordBatch.from_pylist([{
                        "shard": shard, "page": page, "n_ids": int(ends[last - 1] - before),
                        "doc_ids": names[row:last], "n_tokens": counts[row:last].tolist(),
                        "words": words.tobytes(), "blocks": blocks.astype(np.int32).tobytes(),
                        "escaped": escaped.tobytes()}], schema=_PAGE_SCHEMA)
                    page, row = page + 1, last
    return run


_PAGE_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("page", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int32())), ("words", pa.binary()), ("blocks", pa.binary()), ("escaped", pa.binary())])


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                      tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> str:
    """Write docs' token ids below path and return it."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text)
    spread = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    ordered = spread.sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(_pages(tokenizer or tokenizer_path(), end_id), PAGES)
     .write.option("compression", "zstd").parquet(path))
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages with ``page_start``, the number of ids before each page."""
    pages = spark.read.schema(PAGES).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = pages.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select(
        "shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("shard", "page", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_shard")).join(
        shards, "shard").select("shard", "page", (F.col("shard_start") + F.col("in_shard")).alias("page_start"))
    return pages.join(starts, ["shard", "page"])


def page_ids(row: dict) -> np.ndarray:
    """The ids of one page."""
    return simple8b.decode(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["blocks"], np.int32).astype(np.int64),
                           np.frombuffer(row["escaped"], np.uint64), row["n_ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids from the files, end id included."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["page_start"] + ends - sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                             pa.array(page_ids(row).astype(np.int64)))], names=["doc_id", "start", "ids"])
    return read_pages(spark, path).mapInArrow(run, "doc_id LONG, start LONG, ids ARRAY<LONG>")


def document_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(page_ids(row).astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["page_start"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read_pages(spark, path).mapInArrow(run, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")


def query(spark, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return document_checksums(spark, path)
