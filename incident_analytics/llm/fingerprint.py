"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line with a word) hashes to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, so it does not depend on
their order and paragraphs can be inserted or deleted by adding or subtracting
vectors (``combine``). The vector has two parts:

* ``LANES`` words modulo 2**64 hashed from the whole paragraph: equal
  multisets are equal, other ones differ but for chance;
* ``COUNTERS`` signed counters modulo 2**32, to which each two-word shingle of
  the paragraph (and its first word) adds +1 or -1 at a hashed place. Their
  cosine estimates how much two documents share: 0 to 1, about 0 for unrelated
  ones. Sums stay exact up to 2**31 - 1 per counter, more than a text has words.

Every line counts, those without a word too, in the first part only, so texts
that differ in white space have other fingerprints.

Neighbours: ``with_next`` pairs each document with the next one by id. Cut
points come from the ids alone; each range's first document is also sent to the
range before it, so the texts are shuffled once and no window orders all rows.

Defined results: null text is empty; the empty text has the zero vector's
fingerprint, its likeness is 1 to another empty text, else 0; rows with equal
ids are ordered by text; a null id sorts first; a lone document is its own
next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import id_and_text, table
from ._ship import ship
from ._text import gather, hash_pieces, mix, utf8, words

LANES = 8
COUNTERS = 256
_U64 = np.uint64
_LANE_KEYS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_NO_ID = -(2**63)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the non-empty pieces between line breaks (each with the break
    that ends it), over all texts, and their number per text."""
    start = np.zeros(len(data), dtype=bool)
    start[1:] = data[:-1] == 10
    start[at[:-1][at[1:] > at[:-1]]] = True
    starts = np.flatnonzero(start)
    return np.append(starts, len(data)), np.diff(np.searchsorted(starts, at)), start


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums modulo 2**64 (n, LANES) and modulo 2**32 (n, COUNTERS) of the texts."""
    data, at = utf8(texts)
    n = len(at) - 1
    lanes = np.zeros((n, LANES), dtype=np.uint64)
    counters = np.zeros(n * COUNTERS, dtype=np.int64)
    if not len(data):
        return lanes, counters.reshape(n, COUNTERS).astype(np.uint32)
    offsets, per_text, start = _lines(data, at)
    # a line's hash is that of its bytes without the break, so the last line equals one in the middle
    ends = offsets[1:] - (data[offsets[1:] - 1] == 10)
    hashes = _hash_spans(data, offsets[:-1], ends)
    with np.errstate(over="ignore"):
        first = np.flatnonzero(per_text)
        rows = np.concatenate([[0], np.cumsum(per_text)])[:-1][first]
        for k in range(LANES):
            lanes[first, k] = np.add.reduceat(mix(hashes ^ _LANE_KEYS[k]), rows)
    # shingles within lines
    word = words(data, at)
    if len(word.offsets) > 1:
        h = word.hashes()
        inside = np.cumsum(start) - 1
        from_ = np.flatnonzero(_starts(data, at))
        line = inside[from_]
        before = np.zeros(len(h), dtype=np.uint64)
        joined = line[1:] == line[:-1]
        before[1:][joined] = h[:-1][joined]
        with np.errstate(over="ignore"):
            shingle = mix(before * _U64(0x9FB21C651E98DF25) + h)
        doc = np.repeat(np.arange(n), word.per_text)
        sign = 1 - 2 * (shingle >> _U64(63)).astype(np.int64)
        counters = np.bincount(doc * COUNTERS + (shingle % _U64(COUNTERS)).astype(np.int64), weights=sign,
                               minlength=n * COUNTERS).astype(np.int64)
    return lanes, (counters.reshape(n, COUNTERS) & 0xFFFFFFFF).astype(np.uint32)


def _starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~space
    start[1:] &= space[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    start[first] = ~space[first]
    return start


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of possibly empty spans."""
    out = np.zeros(len(starts), dtype=np.uint64)
    full = np.flatnonzero(ends > starts)
    sizes = (ends - starts)[full]
    out[full] = hash_pieces(data[gather(starts[full], sizes)], np.concatenate([[0], np.cumsum(sizes)]))
    return mix(out + _U64(1))


def to_text(lanes: np.ndarray, counters: np.ndarray) -> list[str]:
    """Hexadecimal form: lanes, then counters, little-endian."""
    return [a.astype("<u8").tobytes().hex() + b.astype("<u4").tobytes().hex() for a, b in zip(lanes, counters, strict=True)]


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[:8 * LANES], "<u8"), np.frombuffer(raw[8 * LANES:], "<u4")


def combine(one: str, other: str, sign: int = 1) -> str:
    """The fingerprint of the paragraphs of both (sign 1), or of one without the other's (-1)."""
    (a, c), (b, d) = from_text(one), from_text(other)
    with np.errstate(over="ignore"):
        lanes, counters = (a + b, c + d) if sign > 0 else (a - b, c - d)
    return to_text(lanes[None], counters[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal fingerprints, else the counters' cosine, at least 0."""
    equal = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(norm)), where=norm > 0)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(to_text(*vectors(part.column("text"))), pa.string())],
                    names=["doc_id", "fingerprint"])
    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id LONG, fingerprint STRING")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (part, doc_id, text, own), dealt by part and sorted by id within it:
    after a part's own rows comes the row that follows its last one."""
    spark = docs.sparkSession
    rows = id_and_text(docs, doc_id, text).withColumn("place", F.coalesce("doc_id", F.lit(_NO_ID)))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # cut points and first ids: a few numbers per range
    cuts = rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    part = F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>"),
                       F.lit(0), lambda a, c: a + (F.col("place") > c).cast("int"))
    parted = rows.withColumn("part", part)
    firsts = sorted((r["part"], r["place"]) for r in
                    parted.groupBy("part").agg(F.min("place").alias("place")).collect())
    if not firsts:
        return parted.select("part", "doc_id", "text", F.lit(True).alias("own"))
    # the part before each part, around the end
    follows = {p: firsts[k - 1][0] for k, (p, _) in enumerate(firsts)}
    heads = parted.join(F.broadcast(spark.createDataFrame(
        [(p, place, follows[p]) for p, place in firsts], "part INT, place LONG, to INT")), ["part", "place"])
    sent = parted.select("part", "doc_id", "text", F.lit(True).alias("own")).unionByName(
        heads.select(F.col("to").alias("part"), "doc_id", "text", F.lit(False).alias("own")))
    return sent.repartition(n, "part").sortWithinPartitions("part", F.col("own").desc(), "doc_id", "text")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last half
    replaced by the start of the next document) and the likenesses."""
    ship(docs.sparkSession)

    def flush(texts, ids, following) -> pa.RecordBatch:
        nexts = [*texts[1:], following]
        edited = [_edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        own, other = vectors(pa.array([*texts, following], pa.large_string())), vectors(pa.array(edited, pa.large_string()))
        mine = own[0][:-1], own[1][:-1]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(to_text(*mine), pa.string()), pa.array(to_text(*other), pa.string()),
            pa.array(likeness(mine, other)), pa.array(likeness(mine, (own[0][1:], own[1][1:])))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, size, part, done = [], [], 0, None, True
        for batch in batches:
            for p, i, t, own in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(),
                                    batch.column("text"), batch.column("own").to_pylist(), strict=True):
                t = t.as_py()
                if p != part:
                    part, done = p, False
                if done:  # rows that tie with the first of the next part
                    continue
                if not own or size > 4 << 20:
                    yield flush(texts, ids, t)
                    texts, ids, size = [], [], 0
                if own:
                    texts.append(t)
                    ids.append(i)
                    size += len(t)
                else:
                    done = True
    return with_next(docs, doc_id, text).mapInArrow(
        run, "doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
             "near_edited DOUBLE, near_next DOUBLE")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
