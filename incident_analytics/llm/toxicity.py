"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Features of a text are its distinct words and word beginnings (4 and 5 bytes),
hashed. Voters are the terms of a lexicon, patterns (features that training
labels show to be far more frequent in toxic texts) and one voter for clean
texts (no term and no pattern). The label model is a two-class latent model of
the votes fitted by EM: per voter its rates under both classes, and the
correlations of voters given the class, by which votes that tend to come
together are discounted; labels that may be learnt from are one more voter. Its posteriors are the targets of a logistic
classifier over the features that tell the classes apart.

Training sees at most ``LABELLED`` labelled and ``UNLABELLED`` other documents
in seeded hash order (documented bounds) and at most ``KEPT`` features;
scoring is one pass over all whole texts. Defined results: null and empty
texts get the score of a text without features; rows with equal ids are scored
each on its own text; without labelled rows only the lexicon votes; with no
document at all the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fit import Adam, hash_sample, sigmoid
from ._io import id_and_text, in_fold, table, written
from ._ship import ship
from ._text import gather, hash_pieces, list_array, slices, utf8, words

LABELLED = 12_000
UNLABELLED = 4_000
KEPT = 1_500
PATTERNS = 64
ANNOTATOR = 0.995  # assumed accuracy of a label
THRESHOLD = 0.7
SLICE_BYTES = 8 << 20
_U64 = np.uint64

# fixed values: common insults, in English and some in German, French and Spanish
LEXICON = """
idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool jerk imbecile cretin garbage
vermin filth bastard asshole bitch fuck shit retard whore slut dickhead wanker
arschloch idioten scheisse schlampe hurensohn abschaum dummkopf
connard salope merde abruti crétin ordure
imbécil estúpido idiota basura cabrón puta mierda gilipollas
""".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the words (letters and digits only, lower case) and of
    their beginnings, with the text each belongs to."""
    data, at = utf8(texts)
    w = words(data, at, lower=True)
    keep = _LETTER[w.data]
    inside = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
    sizes = np.diff(inside)
    full = sizes > 0
    starts, sizes, letters = inside[:-1][full], sizes[full], w.data[keep]
    doc = np.repeat(np.arange(len(at) - 1), w.per_text)[full]
    found, owner = [], []
    for part, salt in ((None, 0), (4, 1), (5, 2)):
        chosen = np.ones(len(sizes), bool) if part is None else sizes > part
        n = sizes[chosen] if part is None else np.full(int(chosen.sum()), part)
        h = hash_pieces(letters[gather(starts[chosen], n)], np.concatenate([[0], np.cumsum(n)]))
        found.append((h >> _U64(4)) << _U64(2) | _U64(salt))
        owner.append(doc[chosen])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def _lexicon() -> np.ndarray:
    h, _ = hashed_features(pa.array(LEXICON))
    return h[h % 4 == 0]


def _sampled_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, doc = hashed_features(part.column("text"))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                n = np.bincount(doc[new], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), list_array(h[new], n, pa.int64())],
                    names=["doc_id", "toxic", "features"])
    return rows.mapInArrow(run, "doc_id LONG, toxic INT, features ARRAY<LONG>")


def label_model(votes: np.ndarray, start: np.ndarray, prior: float = 0.1, trusted: np.ndarray | float = 0.0,
                rounds: int = 40) -> dict:
    """EM over binary votes (n, voters) at a class prior: trusted is the log odds
    that an annotator's vote adds to a row (0: abstained). Gives rates under both classes,
    discounts from correlations given the class, and the posteriors."""
    q = start.astype(np.float64)
    discount = np.ones(votes.shape[1])
    for _ in range(rounds):
        on = np.clip((q @ votes + 0.5) / (q.sum() + 1.0), 1e-4, 1 - 1e-4)
        off = np.clip(((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1.0), 1e-5, 1 - 1e-4)
        # residuals given the class; a vote that others repeat counts as a share of itself
        left = votes - (q[:, None] * on + (1 - q)[:, None] * off)
        spread = left.T @ left
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        correlation = spread / np.outer(scale, scale)
        np.fill_diagonal(correlation, 0.0)
        discount = 1.0 / (1.0 + np.maximum(correlation - 0.1, 0.0).sum(axis=1))
        # a voter that does not fire abstains; the quiet voter speaks for clean texts
        new = sigmoid(np.log(prior / (1 - prior)) + trusted + votes @ (np.log(on / off) * discount))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return {"prior": prior, "on": on, "off": off, "discount": discount, "posterior": q}


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> dict:
    """Model from docs (doc_id, text) and labels (doc_id, toxic) that may be learnt from."""
    ship(docs.sparkSession)
    known = hash_sample(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL"), LABELLED, seed)
    other = hash_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), UNLABELLED, seed + 1).withColumn(
        "toxic", F.lit(None).cast("int"))
    chosen = known.unionByName(other.join(known, "doc_id", "left_anti"))
    rows = written(_sampled_features(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")), "toxic-sample")
    seen = rows.where("toxic IS NOT NULL").agg(
        F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    lexicon = np.sort(_lexicon())
    if not rows.count():
        return {"features": lexicon, "weights": np.ones(len(lexicon)), "bias": -2.0}
    # features that differ between the labelled classes, by a two-proportion z
    p, n = F.col("p") / max(seen["p"], 1), F.col("n") / max(seen["n"], 1)
    share = (F.col("p") + F.col("n")) / max(seen["p"] + seen["n"], 1)
    z = (p - n) / F.sqrt(share * (1 - share) * (1 / max(seen["p"], 1) + 1 / max(seen["n"], 1)) + 1e-12)
    told = (rows.where("toxic IS NOT NULL").select("toxic", F.explode("features").alias("f")).groupBy("f")
            .agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
            .where((F.col("p") + F.col("n") >= 5)).withColumn("z", z).where(F.abs("z") >= 4)
            .orderBy(F.abs("z").desc(), "f").limit(KEPT).select("f", "p", "n", "z").collect())
    strong = [r["f"] for r in told if r["z"] > 0 and r["p"] >= 20 * r["n"] and r["p"] >= 5][:PATTERNS]
    features = np.unique(np.concatenate([lexicon, np.array([r["f"] for r in told], np.int64)]))
    voters = np.unique(np.concatenate([lexicon, np.array(strong, np.int64)]))
    wanted = F.array(*[F.lit(int(f)) for f in features])
    got = rows.select("doc_id", "toxic", F.array_intersect("features", wanted).alias("f")).toArrow().sort_by("doc_id")
    lists = got.column("f").combine_chunks()
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    col = np.searchsorted(features, lists.flatten().to_numpy())
    place = np.full(len(features), -1)
    place[np.searchsorted(features, voters)] = np.arange(len(voters))
    votes = np.zeros((len(lists), len(voters)))
    votes[doc[place[col] >= 0], place[col][place[col] >= 0]] = 1.0
    quiet = votes.sum(axis=1) == 0
    votes = np.column_stack([votes, quiet])
    share = (seen["p"] + 1) / (seen["p"] + seen["n"] + 10)  # class balance of the labelled rows, about 0.1 without any
    # the labels that may be learnt from are one more voter, of a fixed accuracy
    toxic = np.array([np.nan if t is None else t for t in got.column("toxic").to_pylist()], dtype=np.float64)
    trusted = np.where(np.isnan(toxic), 0.0, np.where(toxic == 1, 1.0, -1.0) * np.log(ANNOTATOR / (1 - ANNOTATOR)))
    start = np.where(np.isnan(toxic), np.where(quiet, 0.01, 0.9), np.clip(toxic, 1 - ANNOTATOR, ANNOTATOR))
    model = label_model(votes, start, min(max(share, 0.005), 0.5), trusted)
    target = model["posterior"]
    w, bias, adam = np.zeros(len(features)), -2.0, Adam(len(features) + 1, 0.1)
    for _ in range(150):  # the design matrix stays sparse: (doc, col) of its ones
        off = sigmoid(np.bincount(doc, weights=w[col], minlength=len(target)) + bias) - target
        g = np.bincount(col, weights=off[doc], minlength=len(features)) / len(target) + 1e-4 * w
        step = adam.step(np.append(w, bias), np.append(g, off.mean()))
        w, bias = step[:-1], step[-1]
    return {"features": features, "weights": w, "bias": float(bias), "label_model": model}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    features, weights, bias = model["features"], model["weights"], model["bias"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, doc = hashed_features(part.column("text"))
                at = np.minimum(np.searchsorted(features, h), len(features) - 1)
                hit = features[at] == h
                key = np.unique(doc[hit] * len(features) + at[hit])  # a feature counts once in a text
                total = np.bincount(key // len(features), weights=weights[key % len(features)], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(total + bias))],
                                                 names=["doc_id", "score"])
    return docs.mapInArrow(run, "doc_id LONG, score DOUBLE")


def query(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    held_out = in_fold("doc_id", 3, 1)
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
