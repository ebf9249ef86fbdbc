from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from incident_analytics.llm import bisector_clusters

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, cluster STRING, distance STRING, packed STRING"


def brute(rows, k, rounds, dims, scale=1024, salt=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(),
                                        np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        won = [nearest(v)[1] for _, v in kept]
        for c in set(won):
            mine = [v for (_, v), w in zip(kept, won, strict=True) if w == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    return sorted(((i, c, d, sum(e for _, e, x in out if x == c), total,
                    hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in bisector_clusters.cluster(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_distances(spark, seed):
    r = random.Random(seed)
    # a few values only: many vectors at equal distance from two centroids
    rows = [(i, [r.choice([-1.0, -0.0005, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    assert run(spark, rows, k=5, rounds=4, dims=4) == brute(rows, 5, 4, 4)


def test_edge_rows(spark):
    v = [0.5, -0.25, 3.0, 1e-9]
    rows = [(1, None), (2, []), (3, v[:3]), (4, [*v, 1.0]), (5, [0.5, None, 1.0, 2.0]), (6, [float("nan"), 0.0, 0.0, 0.0]),
            (7, [float("inf"), 0.0, 0.0, 0.0]), (8, v), (8, v), (8, [0.0] * 4), (None, v), (None, [9.0] * 4)]
    got = run(spark, rows, k=8, rounds=3, dims=4)
    assert got == brute(rows, 8, 3, 4) and len(got) == 5
    assert run(spark, [], dims=4) == [] and run(spark, rows[:7], dims=4) == []


def test_partitions_do_not_matter(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)
    one, many = (sorted(map(tuple, bisector_clusters.cluster(df.repartition(n)).collect())) for n in (1, 13))
    assert one == many


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond 2"):
        run(spark, [(1, [1e6, 0.0])], dims=2)
    edge = [131071.0, -131072.0]
    assert run(spark, [(1, edge), (2, [-x for x in edge])], dims=2, k=1, rounds=0)[1][2] >= 2**53
