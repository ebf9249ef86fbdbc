"""Centroid clustering by bisector tournaments over integer vectors.

A vector is kept if it has exactly ``dims`` components, none of them null or
non-finite; component x becomes the integer floor(scale * x), x as double.
Two centroids a < b are told apart by their bisector: with the integer normal
2 * (b - a) and the threshold |b|^2 - |a|^2, a vector is nearer to b exactly if
its product with the normal exceeds the threshold; at zero difference a, the
smaller number, stays. Normals and thresholds of all pairs are made once a
round. A vector runs k - 1 such tests, each between the winner so far and the
next centroid, and only its winner's distance is computed, exactly.

The integer vectors are written once, packed, below ``spark.checkpoint.dir``;
every round reads them, sums per task and centroid, and adds up k * (dims + 1)
numbers per task, so a centroid that holds a third of all vectors is no larger
a group than another. Centroids (k * dims integers) go to the driver and back.

Results: repeated ids are rows of their own, a null id is kept as null (its
hash is that of the id's empty text), ties in the starting hash go by the
components; with fewer than k kept vectors there are as many centroids as
vectors; an empty table gives no rows. All arithmetic is in 64-bit integers:
a component beyond +-2**27 (|x| above 131,072 at scale 1024) raises an error
instead of a wrapped distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import table, written
from ._ship import ship

MOST = 1 << 27
ROWS = 4096


def packed_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id",
                   embedding: str = "embedding") -> DataFrame:
    """(vec_id, packed): the kept vectors, components as little-endian 32-bit integers."""
    x = F.col("v")
    whole = F.size(x) == dims
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(embedding).cast("array<double>").alias("v")).where(whole & finite)

    def run(batches):
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(values * scale)
            if len(whole) and np.abs(whole).max() > MOST:
                raise ValueError(f"a component times {scale} is beyond 2**27")
            data = whole.astype("<i4").tobytes()
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * dims)
            cells = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cells], names=["vec_id", "packed"])
    return rows.mapInArrow(run, "vec_id LONG, packed BINARY")


def unpack(cells: pa.Array, dims: int) -> np.ndarray:
    """The rows' integer vectors (n x dims, 64 bit)."""
    if len(cells) == 0:
        return np.zeros((0, dims), dtype=np.int64)
    at = np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset:cells.offset + len(cells) + 1]
    flat = np.frombuffer(cells.buffers()[2], dtype=np.uint8)[at[0]:at[-1]].view("<i4")
    return flat.astype(np.int64).reshape(len(cells), dims)


class Bisectors:
    """Normals and thresholds of all pairs of centroids, and the tournament over them."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=np.int64)
        c = self.centroids
        squares = (c * c).sum(axis=1)
        self.normals = {(a, b): 2 * (c[b] - c[a]) for b in range(len(c)) for a in range(b)}
        self.thresholds = {(a, b): squares[b] - squares[a] for b in range(len(c)) for a in range(b)}

    def winners(self, x: np.ndarray) -> np.ndarray:
        """Number of each vector's nearest centroid (ties: the smaller number)."""
        best = np.zeros(len(x), dtype=np.int32)
        for b in range(1, len(self.centroids)):
            leaders = best.copy()
            for a in np.unique(leaders):
                rows = np.flatnonzero(leaders == a)
                side = x[rows] @ self.normals[a, b] - self.thresholds[a, b]
                best[rows[side > 0]] = b
        return best

    def distances(self, x: np.ndarray, winners: np.ndarray) -> np.ndarray:
        d = x - self.centroids[winners]
        return (d * d).sum(axis=1)


def _totals(packed: DataFrame, bisectors: Bisectors, dims: int) -> dict[int, tuple[int, int, list[int]]]:
    """Per centroid with vectors: their number, summed distance and componentwise sums (k rows)."""
    k = len(bisectors.centroids)
    # a slot for each component, then the count and the summed distance
    def run(batches):
        sums, spare = np.zeros((k, dims + 2), dtype=np.int64), np.zeros((k, dims + 2), dtype=object)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = unpack(batch.column("packed").slice(lo, ROWS), dims)
                won = bisectors.winners(x)
                far = bisectors.distances(x, won)
                for c in np.unique(won):
                    mine = won == c
                    sums[c, :dims] = x[mine].sum(axis=0)
                    sums[c, dims], spare[c, dims + 1] = mine.sum(), spare[c, dims + 1] + sum(far[mine].tolist())
                    spare[c, :dims + 1] += sums[c, :dims + 1].astype(object)
        full = [(c, s, str(spare[c, s])) for c in range(k) if spare[c, dims] for s in range(dims + 2)]
        yield pa.RecordBatch.from_pylist([{"cluster": c, "slot": s, "total": t} for c, s, t in full],
                                         schema=pa.schema([("cluster", pa.int32()), ("slot", pa.int32()), ("total", pa.string())]))
    sums = (packed.mapInArrow(run, "cluster INT, slot INT, total STRING").groupBy("cluster", "slot")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    found: dict[int, list[int]] = {}
    for r in sums:
        found.setdefault(r["cluster"], [0] * (dims + 2))[r["slot"]] = int(r["total"])
    return {c: (t[dims], t[dims + 1], t[:dims]) for c, t in found.items()}


def _first_centroids(packed: DataFrame, k: int, salt: int, dims: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = packed.orderBy(order, "packed").limit(k).select("packed").collect()
    return [np.frombuffer(bytes(r["packed"]), dtype="<i4").tolist() for r in first]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    ship(vectors.sparkSession)
    packed = written(packed_vectors(vectors, dims, scale, vec_id, embedding), "vectors")
    centroids = _first_centroids(packed, k, salt, dims)
    for _ in range(rounds if centroids else 0):
        for c, (n, _, sums) in _totals(packed, Bisectors(centroids), dims).items():
            centroids[c] = [s // n for s in sums]
    bisectors = Bisectors(centroids or [[0] * dims])
    spread = {c: far for c, (_, far, _) in _totals(packed, bisectors, dims).items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = sum(spread.values())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = unpack(part.column("packed"), dims)
                won = bisectors.winners(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(won), pa.array(bisectors.distances(x, won)),
                     pa.array([spread[c] for c in won], pa.int64()), pa.array([inertia] * len(won), pa.int64()),
                     pa.array([digests[c] for c in won], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    return packed.mapInArrow(run, "vec_id LONG, cluster INT, distance LONG, cluster_inertia LONG, inertia LONG, "
                                  "centroid_sha256 STRING")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 8, rounds: int = 10, salt: int = 3) -> str:
    """DuckDB: plain distances to every centroid, one pair of CTEs a round."""
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x:
            CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v
        FROM (SELECT sha256({salt}::VARCHAR || ':' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, c AS cluster, d AS distance, v FROM (
            SELECT vec_id, v, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM (
                SELECT k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v),
                    lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, c{r} c)) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, v FROM c{r} WHERE c NOT IN (SELECT cluster FROM a{r})
        UNION ALL SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) FROM (
            SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} c ON cluster = c.c"""
