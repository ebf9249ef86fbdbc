"""Removal of bytes covered by repeated 200-byte strings, by deep-shallow sorting.

A byte goes if a string of ``width`` bytes over it also starts anywhere else, in
the same document or another one; strings are judged on the input, never cross
documents, and overlaps count. Text is UTF-8, null is empty.

1. Texts are told apart by their SHA-256. A text of two or more rows is covered
   whole (if it has a window at all); from here on each text stands once.
2. Every window has an anchor: the leftmost place of the least hash of
   ``gram`` bytes in it (``_repeats.anchors``). Equal windows have equal anchors,
   about one anchor in 70 bytes; keys of a single anchor are dropped.
3. The windows of one anchor are a block: the bytes from the first window's
   start to the last one's end. Equal blocks are counted before they move, so
   a passage of a third of all documents is one block; two equal blocks are
   repeated whole.
4. The different blocks of a key are suffixes (and, backwards, prefixes) from
   the anchor. Tasks sort them deep-shallow: multikey quicksort on words of
   eight bytes to a shallow depth, blind tries for the groups still equal
   there. What sorted neighbours share gives the repeated windows, exactly
   (``_repeats.shared_windows``).
5. Starts of repeated windows go back to their documents and become byte runs.

Step 4 groups keys into buckets of about BUCKET_ROWS blocks. A key of more than
KEY_ROWS different blocks is split: its blocks are cut to the windows in one
half of the distances to the anchor, and keyed anew by the longer string which
all those windows share. Halving goes on while a key is larger, down to single
windows, which are counted with partial sums. So no key is one task's, whatever
its size, and no block or pair is dropped.

Joins whose key can be frequent (a gram, a block, a text) are dealt over SALTS.
Every step is written below ``spark.checkpoint.dir``. Rows of equal or null id
are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats
from ._io import id_and_text, table, written
from ._ship import ship

GRAM = 32
SALTS = 4
BUCKET_ROWS = 5_000
KEY_ROWS = 20_000
SLICE = 8 << 20

_NO_BYTES = hashlib.sha256(b"").hexdigest()
_RANGES = "ARRAY<STRUCT<first: INT, last: INT>>"
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _texts(batch: pa.RecordBatch):
    for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
        yield digest, np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(digest, text, copies, doc_id of one row): each text once."""
    rows = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    return rows.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"),
                                      F.min("doc_id").alias("doc_id"))


def repeated_anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(digest, places): per text the numbers of its anchors whose key another anchor has."""
    def run(batches):
        for batch in batches:
            for digest, data in _texts(batch):
                keys = _repeats.anchors(data, width, gram)[0]
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array([digest] * len(keys), pa.binary()),
                         pa.array(np.arange(len(keys), dtype=np.int32))], names=["key", "digest", "place"])
    rows = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    found = written(rows.mapInArrow(run, "key LONG, digest BINARY, place INT"), "repeat-anchors")
    # rows of one text give the same anchors: different ones only make a key repeated
    mark = F.xxhash64("digest", "place")
    keys = found.groupBy("key").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a < b").select("key")
    hits = found.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS))).join(_salted(keys), ["key", "salt"])
    return written(hits.groupBy("digest").agg(F.collect_set("place").alias("places")), "repeat-places", drop=[found])


_BLOCK = pa.schema([("block", pa.binary()), ("key", pa.int64()), ("left", pa.int32()), ("starts", pa.int32()),
                    ("content", pa.binary()), ("n", pa.int64()),
                    ("refs", pa.list_(pa.struct([("digest", pa.binary()), ("at", pa.int32())])))])


def _block_id(key: int, left: int, starts: int, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16, key=b"%d/%d/%d" % (key, left, starts)).digest()


def blocks(texts: DataFrame, hits: DataFrame, width: int, gram: int) -> DataFrame:
    """(block, key, left, starts, content, n, refs) of the repeated anchors: equal
    blocks of a slice of texts are one row with the places they start at."""
    def flush(found):
        for lo in range(0, len(found), 2000):
            some = list(found.items())[lo:lo + 2000] if len(found) > 2000 else list(found.items())
            yield pa.RecordBatch.from_pylist(
                [{"block": b, "key": k, "left": left, "starts": s, "content": c, "n": len(refs), "refs": refs}
                 for b, (k, left, s, c, refs) in some], schema=_BLOCK)

    def run(batches):
        found, size = {}, 0
        for batch in batches:
            wanted = batch.column("places").to_pylist()
            for (digest, data), places in zip(_texts(batch), wanted, strict=True):
                keys, first, last, at = _repeats.anchors(data, width, gram)
                raw = data.tobytes()
                for i in sorted(places):
                    k, a, b = int(keys[i].view(np.int64)), int(first[i]), int(last[i])
                    content = raw[a:b + width]
                    block = _block_id(k, int(at[i]) - a, b - a + 1, content)
                    if block not in found:
                        found[block] = (k, int(at[i]) - a, b - a + 1, content, [])
                        size += len(content)
                    found[block][4].append({"digest": digest, "at": a})
                    size += 150
                if size > SLICE:
                    yield from flush(found)
                    found, size = {}, 0
        yield from flush(found)
    kind = ("block BINARY, key LONG, left INT, starts INT, content BINARY, n LONG, "
            "refs ARRAY<STRUCT<digest: BINARY, at: INT>>")
    return texts.join(hits, "digest").select("digest", "text", "places").mapInArrow(run, kind)


def _halved(width: int, gram: int, low: int, high: int):
    """Blocks whose windows lie at distances low..high, cut to each half and keyed by what the half's windows share."""
    middle = (low + high) // 2

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for lo, hi in ((low, middle), (middle + 1, high)):
                    most, least = min(r["left"], hi), max(r["left"] - r["starts"] + 1, lo)
                    if least > most or lo > hi:
                        continue
                    begin = r["left"] - most
                    content = r["content"][begin:r["left"] - least + width]
                    shared = r["content"][r["left"] - lo:r["left"] - hi + width]
                    key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=b"%d" % lo).digest(), "big", signed=True)
                    rows.append({"block": r["block"], "key": key, "left": most, "starts": most - least + 1,
                                 "content": content, "low": lo, "high": hi})
            yield pa.RecordBatch.from_pylist(rows, schema=_PART)
    return run


_PART = pa.schema([("block", pa.binary()), ("key", pa.int64()), ("left", pa.int32()), ("starts", pa.int32()),
                   ("content", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
_PART_KIND = "block BINARY, key LONG, left INT, starts INT, content BINARY, low INT, high INT"


def _window_ranges(parts: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """(block, distances): per block the distances in front of its anchor at which
    its window is one of another block of the key too."""
    out = pa.schema([("block", pa.binary()), ("distances", _RANGE)])

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        content = group.column("content").to_pylist()
        ends = np.concatenate([[0], np.cumsum([len(c) for c in content])]).astype(np.int64)
        shared = _repeats.shared_windows(
            keys, group.column("left").to_numpy().astype(np.int64), group.column("starts").to_numpy().astype(np.int64),
            np.frombuffer(b"".join(content), dtype=np.uint8), ends, width, gram)
        some = np.flatnonzero(shared.any(axis=1))
        names = group.column("block").to_pylist()
        return pa.Table.from_pylist([{"block": names[i], "distances": _runs(np.flatnonzero(shared[i]))} for i in some],
                                    schema=out)
    return (parts.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets))).groupBy("bucket")
            .applyInArrow(run, f"block BINARY, distances {_RANGES}"))


def _runs(places: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(places) != 1)
    first, last = np.append(places[:1], places[edges + 1]), np.append(places[edges], places[-1:])
    return [{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def repeated_windows(found: DataFrame, width: int, gram: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """(block, distances, left) of every block with a repeated window."""
    distinct = written(found.groupBy("block", "key", "left", "starts", "content").agg(F.sum("n").alias("n")),
                       "repeat-blocks")
    whole = F.array(F.struct((F.col("left") - F.col("starts") + 1).alias("first"), F.col("left").alias("last")))
    results = [distinct.where("n > 1").select("block", whole.cast(_RANGES).alias("distances"))]
    tallies = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    parts = distinct.join(tallies, "key").withColumns({"low": F.lit(0), "high": F.lit(width - gram)})
    while True:
        parts = written(parts.select(*_PART.names, "blocks"), "repeat-parts")
        small = parts.where(F.col("blocks") <= key_rows)
        buckets = max(1, -(-small.count() // BUCKET_ROWS))
        results.append(written(_window_ranges(small, buckets, width, gram), "repeat-ranges"))
        large = parts.where(F.col("blocks") > key_rows)
        spans = [(r["low"], r["high"]) for r in large.select("low", "high").distinct().collect()]
        if not spans:
            break
        # single windows need no sorting: as many blocks as share the key have the window
        at = F.array(F.struct(F.col("low").alias("first"), F.col("low").alias("last")))
        results.append(large.where("low = high").select("block", at.cast(_RANGES).alias("distances")))
        halves = [large.where((F.col("low") == lo) & (F.col("high") == hi)).select(*_PART.names)
                  .mapInArrow(_halved(width, gram, lo, hi), _PART_KIND) for lo, hi in spans if lo < hi]
        if not halves:
            break
        halves = written(reduce(DataFrame.unionByName, halves), "repeat-halves")
        tallies = halves.groupBy("key", "low", "high").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
        salt = F.pmod(F.hash("block"), F.lit(SALTS))
        parts = halves.withColumn("salt", salt).join(_salted(tallies), ["key", "low", "high", "salt"])
    ranges = reduce(DataFrame.unionByName, results)
    return ranges.groupBy("block").agg(F.flatten(F.collect_list("distances")).alias("distances"))


def repeated_runs(docs: DataFrame, width: int = 200, gram: int = GRAM, key_rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(digest, runs) of each text with a repeated window, starts of windows as
    runs of places; and the repeated texts with their rows' number."""
    ship(docs.sparkSession)
    hits = repeated_anchors(docs, width, gram)
    found = written(blocks(distinct_texts(docs), hits, width, gram), "repeat-refs", drop=[hits])
    ranges = written(repeated_windows(found, width, gram, key_rows), "repeat-windows")
    refs = found.select("block", "left", "refs", F.pmod(F.xxhash64("refs"), F.lit(SALTS)).cast("int").alias("salt"))
    starts = (refs.join(_salted(ranges), ["block", "salt"]).select("left", "distances", F.explode("refs").alias("ref"))
              .select("ref.digest", F.explode(F.transform("distances", lambda d: F.struct(
                  (F.col("ref.at") + F.col("left") - d["last"]).alias("first"),
                  (F.col("ref.at") + F.col("left") - d["first"]).alias("last")))).alias("run")))
    runs = starts.groupBy("digest").agg(F.collect_list("run").alias("runs"))
    return written(runs, "repeat-runs", drop=[found]), ranges


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("text", pa.large_binary())])
_RESULT_KIND = "doc_id LONG, n_bytes LONG, n_removed LONG, n_spans LONG, kept_sha256 STRING, text BINARY"


def _cut(width: int, texts: bool):
    def run(batches):
        for batch in batches:
            rows = []
            runs = batch.column("runs").to_pylist()
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), runs, strict=True):
                raw = (text.as_py() or "").encode()
                change = np.zeros(len(raw) + 1, dtype=np.int32)
                if found:
                    np.add.at(change, [r["first"] for r in found], 1)
                    np.add.at(change, [r["last"] + width for r in found], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": int(gone.sum()),
                             "n_spans": int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()),
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "text": kept if texts else None})
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)
    return run


def remove_repeats(docs: DataFrame, width: int = 200, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM,
                   texts: bool = True, key_rows: int = KEY_ROWS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, the remaining bytes as ``text`` (binary: a cut may split a character)."""
    rows = id_and_text(docs, doc_id, text)
    runs, _ = repeated_runs(rows, width, gram, key_rows)
    distinct = distinct_texts(rows)
    once = (distinct.where("copies = 1").join(runs, "digest", "left").select("doc_id", "text", "runs")
            .mapInArrow(_cut(width, texts), _RESULT_KIND))
    # rows of a text that others have: covered whole, or too short for a window
    ids = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"),
                      *([F.col("text").cast("binary").alias("text")] if texts else []))
    copied = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest")
    ids = ids.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(_salted(copied), ["digest", "salt"])
    gone = F.col("n_bytes") >= width
    more = ids.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, _NO_BYTES).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        (F.when(gone, F.lit(b"")).otherwise(F.col("text")) if texts else F.lit(None).cast("binary")).alias("text"))
    out = once.unionByName(more)
    return out if texts else out.drop("text")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
