"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of label 1, unlabelled text is a sample of
all documents; negative labels are never used. A first classifier, positives
against unlabelled, gives the class prior: the least ratio of the unlabelled
to the positive tail over its scores. The second minimises the non-negative
risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` of Kiryo et al.
(2017) with the logistic loss over binned shape features of the text.

Training sees at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents
in seeded hash order (documented bound); scoring is one pass over all whole
texts. Defined results: null and empty texts get the score of the all-zero
shape; rows with equal ids are scored each on its own text; with fewer than
two positives every score is 0.5; labels of one id that disagree count as given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import Adam, hash_sample, sigmoid
from ._io import id_and_text, in_fold, table
from ._ship import ship
from ._text import hash_pieces, slices, utf8, words
from .quality_rules import STOP_WORDS

SAMPLE = 20_000
BINS = 16
SLICE_BYTES = 8 << 20
THRESHOLD = 0.3
FEATURES = 16


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over the runs [at[i], at[i + 1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _stop_hashes() -> np.ndarray:
    data, at = utf8(pa.array(list(dict.fromkeys(STOP_WORDS))))
    return np.sort(hash_pieces(data, at))


def shapes(texts: pa.Array) -> np.ndarray:
    """Shape features of the texts, (n, FEATURES)."""
    data, at = utf8(texts)
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    of = lambda mask: _per_text(mask, at) / size
    w = words(data, at, lower=True)
    first = w.first
    count = np.maximum(w.per_text, 1).astype(np.float64)
    hashes = w.hashes()
    doc = np.repeat(np.arange(n), w.per_text)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(hashes))
    if len(hashes):
        h, d = hashes[order], doc[order]
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    stops = _stop_hashes()
    place = np.minimum(np.searchsorted(stops, hashes), len(stops) - 1)
    line = (data == 10)
    lengths = np.diff(w.offsets).astype(np.float64)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    columns = [
        np.log1p(w.per_text), np.log1p(np.diff(at)), _per_text(lengths, first) / count,
        np.sqrt(np.maximum(_per_text(lengths**2, first) / count - (_per_text(lengths, first) / count) ** 2, 0)),
        of(np.isin(data, np.frombuffer(b"#*$%&<>@^~", np.uint8))), of(data == 124), of(upper), of(digit),
        of(data == 33), of((data == 46) | (data == 44)), of(data >= 0x80), _per_text(line, at) / count,
        _per_text(stops[place] == hashes, first) / count, _per_text(same, first) / count,
        np.bincount(doc[order], weights=new, minlength=n) / count if len(doc) else np.zeros(n),
        of(np.isin(data, np.frombuffer(b"{}[]()=;_\\/", np.uint8)))]
    return np.stack(columns, axis=1)


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Design matrix of one-hot bins."""
    out = np.zeros((len(x), FEATURES * (BINS + 1)))
    rows = np.arange(len(x))
    for k in range(FEATURES):
        out[rows, k * (BINS + 1) + np.searchsorted(edges[k], x[:, k], side="left")] = 1.0
    return out


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias: positives against unlabelled, or the non-negative risk at prior."""
    w, adam = np.zeros(p.shape[1] + 1), Adam(p.shape[1] + 1, 0.05)
    for _ in range(rounds):
        sp, su = sigmoid(p @ w[:-1] + w[-1]), sigmoid(u @ w[:-1] + w[-1])
        if prior is None:
            gp, gu = (sp - 1) / len(p), su / len(u)
        else:
            # losses of labels + and -: -log s and -log(1 - s); their slopes s - 1 and s
            negative = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1) / len(p) - prior * sp / len(p), su / len(u)
            else:  # the risk of negatives fell below zero: step back on that part alone
                gp, gu = prior * sp / len(p), -su / len(u)
        g = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
        g[:-1] += ridge * w[:-1]
        w = adam.step(w, g)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of tails P_u(score <= t) / P_p(score <= t) and above, over
    thresholds that leave at least three tenths of the positives (smaller tails
    make the least ratio a noisy one)."""
    t = np.quantile(positive, np.linspace(0.02, 0.95, 60))
    least = []
    for keep in (lambda s: s[:, None] >= t, lambda s: s[:, None] <= t):
        p, u = keep(positive).mean(axis=0), keep(unlabelled).mean(axis=0)
        least.append((u / np.maximum(p, 1e-9))[p >= 0.3].min())
    return float(np.clip(min(least), 0.05, 0.99))


def train(docs: DataFrame, trusted: DataFrame, sample: int = SAMPLE, seed: int = 11) -> dict | None:
    """Model from docs (doc_id, text) and the ids of trusted positives."""
    ship(docs.sparkSession)
    chosen = hash_sample(trusted.select("doc_id").distinct(), sample, seed).withColumn("kind", F.lit(1)).unionByName(
        hash_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), sample, seed + 1).withColumn("kind", F.lit(0)))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("kind", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [part.column("kind"), pa.array(list(shapes(part.column("text"))), pa.list_(pa.float64()))],
                    names=["kind", "x"])

    got = rows.mapInArrow(run, "kind INT, x ARRAY<DOUBLE>").toArrow()
    kind = got.column("kind").to_numpy()
    x = np.array(got.column("x").to_pylist()).reshape(-1, FEATURES)
    x = x[np.lexsort((*x.T, kind))]  # rows come in any order; sums should not depend on it
    kind = np.sort(kind)
    if (kind == 1).sum() < 2 or (kind == 0).sum() < 2:
        return None
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:], axis=0).T
    design = _bin(x, edges)
    p, u = design[kind == 1], design[kind == 0]
    # cross-fitted: scores of rows that the first classifier has not seen
    priors = []
    for half in (0, 1):
        first = _fit(p[half::2], u[half::2], None)
        priors.append(class_prior(p[1 - half::2] @ first[:-1], u[1 - half::2] @ first[:-1]))
    prior = float(np.mean(priors))
    return {"edges": edges, "weights": _fit(p, u, prior), "prior": prior}


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if model is None:
                    s = np.full(part.num_rows, 0.5)
                else:
                    s = sigmoid(_bin(shapes(part.column("text")), model["edges"]) @ model["weights"][:-1] + model["weights"][-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], names=["doc_id", "score"])
    return docs.mapInArrow(run, "doc_id LONG, score DOUBLE")


def query(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    held_out = in_fold("doc_id", 5, 0)
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~held_out)
    return scores(docs, train(docs, trusted)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
