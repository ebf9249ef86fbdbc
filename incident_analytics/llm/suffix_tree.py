"""LM scoring by a probabilistic suffix tree over words.

Order 0 is add-one smoothed word counts of the training documents. A context
(the last 1 to ``DEPTH`` tokens, the end of the document before as boundary) is
a candidate if it occurs at least ``MIN_COUNT`` times, whatever its share of
the corpus or of its prefix's continuations. It is retained with a next token
when the two occur together at least ``MIN_COUNT`` times, the token has at
least ``GAMMA`` of the context's continuations and diverges from the suffix's
prediction: ``n * ln(P(next | context) / P(next | suffix)) >= DIVERGENCE``. The
smoothed distribution of a retained context gives its stored tokens
``n / (count + 1)`` and spreads the rest by the suffix's distribution, so it
sums to one. A token is scored in the longest retained suffix state.

Scale: the tree grows with the corpus and is on no single machine. Word counts
meet by hash bucket and return to the blocks that need them (``_blocks``). So do
the counts of a level's sequences (context and next token): each block sends
its distinct ones once, to ``GRAM_BUCKETS`` buckets a partition of the input,
and gets back those that occur often enough. A sequence is only counted if its
context and its suffix are, which loses none. What the contexts give to stored
tokens meets in the same way, in buckets of contexts; a stored sequence is sent
by one of its blocks, which the bucket named with its count. The messages of a level
are deleted when they are answered.

Defined results: null and empty texts are the end token alone; a null id
counts as training; without a training document every token has the same
probability; rows with equal ids are scored each on its own text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks
from ._io import id_and_text, in_fold, table, written
from ._ship import ship
from ._text import hash_pieces, mix, words
from .mixing import word_count

MIN_COUNT = 2
GAMMA = 0.02
DEPTH = 3
DIVERGENCE = 10.0
GRAM_BUCKETS = 4
_U64 = np.uint64
_END = mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0]


def _lower_words(data, at):
    return words(data, at, lower=True)


_VALUES = "block LONG, bucket INT, digest LONG, counts BINARY, hashes BINARY, known LONG"
_VALUE_SCHEMA = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()), ("counts", pa.binary()),
    ("hashes", pa.binary()), ("known", pa.int64())])


def _bucket_counts(key, group):
    """Training counts of a bucket's words for each message, with the hashes of
    those that can be in a sequence, and one row (block -1) with the number of
    known words."""
    codes, distinct, ns = _blocks.bucket_pieces(group)
    rows = group.select(["block", "bucket", "digest", "counts"]).to_pylist()
    seen = np.concatenate([_blocks.grow(r["counts"], np.uint32) for r in rows]).astype(np.float64)
    total = np.bincount(codes, weights=seen, minlength=len(distinct)).astype(np.int64)
    at = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[:len(distinct) + 1]
    hashes = hash_pieces(np.frombuffer(distinct.buffers()[2], dtype=np.uint8), at)
    often = total >= MIN_COUNT
    made, from_ = [{"block": -1, "bucket": rows[0]["bucket"], "digest": 0, "known": int((total > 0).sum())}], 0
    for row, n in zip(rows, ns, strict=True):
        mine = codes[from_:from_ + n]
        from_ += n
        made.append({"block": row["block"], "bucket": row["bucket"], "digest": row["digest"],
                     "counts": _blocks.shrink(total[mine].astype(np.uint64)),
                     "hashes": hashes[mine][often[mine]].tobytes()})
    return pa.Table.from_pylist(made, schema=_VALUE_SCHEMA)


# a block's texts: coded words, and the codes' counts in training. Words that can be in a sequence
# are coded in the order of their hashes, which are there too; the others by their counts behind them
_STATE = "block LONG, doc_ids ARRAY<LONG>, per_text BINARY, train BINARY, codes BINARY, hashes BINARY, counts BINARY"
_STATE_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                           *[(c, pa.binary()) for c in ("per_text", "train", "codes", "hashes", "counts")]])
# what a step makes of a block, by bucket: its sequences to be counted, its stored sequences, its contexts
_GRAMS, _STORED, _CONTEXTS = range(3)
_STEP = "kind INT, level INT, block LONG, bucket INT, keys BINARY, ns BINARY"
_STEP_SCHEMA = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()),
                          *[(c, pa.binary()) for c in ("keys", "ns")]])
# a bucket's answer: places among what the block sent of the kind, with twice the sequences' counts, plus one for
# the one block that sends the sequence on if it is stored, or what the contexts gave to stored tokens
_ANSWER = "kind INT, level INT, block LONG, bucket INT, at BINARY, ns BINARY"
_ANSWER_SCHEMA = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()),
                            ("at", pa.binary()), ("ns", pa.binary())])


def _after(values: np.ndarray, first: np.ndarray, at_first) -> np.ndarray:
    """Each place's value at the place before; at the first place of a text, at_first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first] = at_first
    return out


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets' parts of sorted hashes begin: a bucket is a range of hashes."""
    top = (np.arange(buckets, dtype=np.uint64) << _U64(32)) // _U64(buckets)
    return np.append(np.searchsorted(keys >> _U64(32), top), len(keys))


def _steps_of(sorted_keys: np.ndarray) -> bytes:
    """Sorted hashes as their steps, which have leading zeros."""
    return _blocks.shrink(np.diff(sorted_keys, prepend=_U64(0)))


def _keys_of(steps: bytes) -> np.ndarray:
    return np.cumsum(_blocks.grow(steps, np.uint64), dtype=np.uint64)


def _spread(answers: list[dict], sent: np.ndarray, buckets: int) -> np.ndarray:
    """The answers' numbers at their places among the hashes sent (others: 0)."""
    n, edges = np.zeros(len(sent), dtype=np.int64), _edges(sent, buckets)
    for a in answers:
        n[edges[a["bucket"]] + _blocks.grow(a["at"], np.uint32)] = _blocks.grow(a["ns"], np.uint64)
    return n


class _Levels:
    """A block's tokens level by level. Sequences that occur MIN_COUNT times in
    training are the ``keys`` of a level (sorted hashes) with their ``counts``;
    ``code`` is each token's place among them (-1: rarer), ``context`` that of
    the token before at the level below, ``p`` the token's probability so far."""

    def __init__(self, state: dict, sums: dict, buckets: int):
        n = _blocks.grow(state["per_text"], np.int64)
        codes, ends = _blocks.grow(state["codes"], np.uint32), np.cumsum(n)
        counts = _blocks.grow(state["counts"], np.uint64).astype(np.int64)
        words = _keys_of(state["hashes"])
        self.level, self.buckets = 0, buckets
        self.per_text = n + 1
        self.first = np.cumsum(self.per_text) - self.per_text
        seen = np.insert(counts[codes], ends, sums["docs"])
        self.p = self.zero = (seen + 1.0) / (sums["total"] + sums["known"] + 1)
        self.known = seen > 0
        end = int(np.searchsorted(words, _END))
        self.keys, self.counts = np.insert(words, end, _END), np.insert(counts[:len(words)], end, sums["docs"])
        of_word = np.arange(len(counts), dtype=np.int32)
        of_word[end:] += 1
        of_word[len(words):] = -1
        self.end = end if sums["docs"] >= MIN_COUNT else -1
        self.code = np.insert(of_word[codes], ends, self.end)
        self.words, self.word = self.keys, self.code

    def next_level(self) -> None:
        """Contexts one token longer, and the distinct sequences to be counted."""
        # in front of a text stands the end token
        self.context = _after(self.code, self.first, self.end if self.level == 0 else -1)
        self.level += 1
        self.contexts, self.sizes = self.keys, self.counts
        used = np.bincount(self.context[self.context >= 0], minlength=len(self.contexts)) > 0
        self.used = np.flatnonzero(used)
        # a sequence is no more frequent than its context and its suffix
        self.alive = np.flatnonzero((self.context >= 0) & (self.code >= 0))
        with np.errstate(over="ignore"):
            gram = mix(self.contexts[self.context[self.alive]] * _U64(0x9FB21C651E98DF25) + self.words[self.word[self.alive]])
        self.sent, self.of = np.unique(gram, return_inverse=True)

    def count(self, answers: list[dict]) -> None:
        """The sequences' counts in training from the buckets' answers (less than MIN_COUNT: none)."""
        n = _spread(answers, self.sent, self.buckets)
        n, mine = n >> 1, n & 1
        often = n >= MIN_COUNT
        self.keys, self.counts, self.mine = self.sent[often], n[often], mine[often]
        place = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.code = np.full(len(self.p), -1, dtype=np.int32)
        self.code[self.alive] = place[self.of]
        at = np.flatnonzero(self.code >= 0)
        m, size = self.counts[self.code[at]], self.sizes[self.context[at]]
        at, m, size = (x[m >= GAMMA * size] for x in (at, m, size))
        self.stored = at[m * np.log(m / size / self.p[at]) >= DIVERGENCE]

    def predict(self, answers: list[dict]) -> None:
        """Probabilities of this level from what its contexts gave to stored tokens."""
        given = np.zeros(len(self.contexts), dtype=np.int64)
        given[self.used] = _spread(answers, self.contexts[self.used], self.buckets)
        rest = (self.sizes - given + 1.0) / (self.sizes + 1.0)
        self.p = np.where(self.context >= 0, self.p * rest[self.context], self.p) if len(rest) else self.p.copy()
        at = self.stored
        self.p[at] += self.counts[self.code[at]] / (self.sizes[self.context[at]] + 1.0)

    def _by_bucket(self, kind: int, block: int, keys: np.ndarray, **columns) -> list[dict]:
        edges, made = _edges(keys, self.buckets), []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[k], edges[k + 1]
            made.append({"kind": kind, "level": self.level, "block": block, "bucket": k, "keys": _steps_of(keys[lo:hi]),
                         **{c: _blocks.shrink(v[lo:hi]) for c, v in columns.items()}})
        return made

    def sequences(self, block: int, train: np.ndarray) -> list[dict]:
        """The block's distinct sequences with their counts in its training texts."""
        times = np.repeat(train, self.per_text)[self.alive]
        n = np.bincount(self.of, weights=times, minlength=len(self.sent)).astype(np.uint32)
        return self._by_bucket(_GRAMS, block, self.sent, ns=n)

    def retained(self, block: int) -> list[dict]:
        """The block's contexts, and what contexts gave to the stored sequences that it sends on."""
        context = np.full(len(self.keys), -1, dtype=np.int64)
        context[self.code[self.stored]] = self.context[self.stored]
        one = np.flatnonzero((context >= 0) & (self.mine > 0))
        given = np.zeros(len(self.contexts), dtype=np.uint64)
        np.add.at(given, context[one], self.counts[one].astype(np.uint64))
        some = np.flatnonzero(given)
        stored = self._by_bucket(_STORED, block, self.contexts[some], ns=given[some])
        return stored + self._by_bucket(_CONTEXTS, block, self.contexts[self.used])


def _answers(rows: list[dict], places: list[np.ndarray], ns: list[np.ndarray]) -> pa.Table:
    return pa.Table.from_pylist([
        {**{c: r[c] for c in ("kind", "level", "block", "bucket")}, "at": _blocks.shrink(at.astype(np.uint32)),
         "ns": _blocks.shrink(n.astype(np.uint64))}
        for r, at, n in zip(rows, places, ns, strict=True) if len(at)], schema=_ANSWER_SCHEMA)


def _counted(rows: list[dict]) -> pa.Table:
    """Counts of a bucket's sequences, for each message those that reach MIN_COUNT."""
    sent = [_keys_of(r["keys"]) for r in rows]
    keys, of = np.unique(np.concatenate(sent), return_inverse=True)
    total = 2 * np.bincount(of, weights=np.concatenate([_blocks.grow(r["ns"], np.uint32) for r in rows]),
                            minlength=len(keys)).astype(np.int64)[of]
    # a sequence is in a message once: any one of its messages
    one = np.empty(len(keys), dtype=np.int64)
    one[of] = np.arange(len(of))
    total[one] += 1
    parts = np.split(total, np.cumsum([len(s) for s in sent])[:-1])
    at = [np.flatnonzero(n >= 2 * MIN_COUNT) for n in parts]
    return _answers(rows, at, [n[i] for n, i in zip(parts, at, strict=True)])


def _given(rows: list[dict]) -> pa.Table:
    """What a bucket's contexts gave to stored tokens, for each message of contexts those that gave any."""
    stored, wanted = [r for r in rows if r["kind"] == _STORED], [r for r in rows if r["kind"] == _CONTEXTS]
    if not stored:
        return _ANSWER_SCHEMA.empty_table()
    keys, of = np.unique(np.concatenate([_keys_of(r["keys"]) for r in stored]), return_inverse=True)
    given = np.bincount(of, weights=np.concatenate([_blocks.grow(r["ns"], np.uint64) for r in stored]))
    places, ns = [], []
    for r in wanted:
        mine = _keys_of(r["keys"])
        hit = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        at = np.flatnonzero(keys[hit] == mine)
        places.append(at)
        ns.append(given[hit[at]])
    return _answers(wanted, places, ns)


def _meet(steps: DataFrame) -> DataFrame:
    """The buckets' answers to what the blocks sent."""
    def run(group):
        rows = group.to_pylist()
        return _counted(rows) if rows[0]["kind"] == _GRAMS else _given(rows)
    return steps.groupBy("level", F.col("kind") == _GRAMS, "bucket").applyInArrow(run, _ANSWER)


def _by_block(state: DataFrame, answers: list[DataFrame], upto: int, sums: dict, buckets: int, schema: str, made,
              answered: bool) -> DataFrame:
    """made(block's row, its levels down to upto) for every block; answered:
    upto's contexts have their kept shares too."""
    def run(left, right):
        got = {}
        for a in right.to_pylist():
            got.setdefault((a["level"], a["kind"]), []).append(a)
        out = []
        for row in left.to_pylist():
            levels = _Levels(row, sums, buckets)
            for k in range(1, upto + 1):
                levels.next_level()
                levels.count(got.get((k, _GRAMS), []))
                if k < upto or answered:
                    levels.predict(got.get((k, _CONTEXTS), []))
            out.append(made(row, levels))
        return pa.concat_tables(out)
    every = reduce(DataFrame.unionByName, answers)
    return state.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, schema)


def suffix_tree_scores(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents by a tree learnt from those where held_out (a
    condition on doc_id) is false: doc_id, n_tokens, n_known, train_tokens,
    base_score (order 0) and score."""
    ship(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text)
    size = rows.where(~held_out).agg(F.sum(word_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("docs")).first()
    n_words, n_docs = size["words"] or 0, size["docs"]
    buckets = _blocks.bucket_count(rows)
    gram_buckets = max(8, GRAM_BUCKETS * rows.rdd.getNumPartitions())
    marked = rows.withColumn("train", (~held_out).cast("int"))
    cut = written(_blocks.rows_and_messages(marked, _lower_words, buckets, "train"), "suffix-cut")
    messages = cut.where("bucket IS NOT NULL").select("block", "bucket", "n", "digest", "pieces", "sizes", "counts")
    values = written(messages.groupBy("bucket").applyInArrow(_bucket_counts, _VALUES), "suffix-words")
    known = values.where("block = -1").agg(F.sum("known")).first()[0] or 0
    sums = {"total": n_words + n_docs, "docs": n_docs, "known": known + (n_docs > 0)}

    def begin(row, parts):
        none = np.zeros(0, np.uint64)
        counts = np.concatenate([none, *[_blocks.grow(p["counts"], np.uint64) for p in parts]])
        hashes = np.concatenate([none, *[np.frombuffer(p["hashes"], dtype=np.uint64) for p in parts]])
        often, order = np.flatnonzero(counts >= MIN_COUNT), np.argsort(hashes)
        number = (len(often) + counts).astype(np.uint32)
        number[often[order]] = np.arange(len(often))
        yield pa.RecordBatch.from_pylist([{
            "block": row["block"], "doc_ids": row["doc_ids"], "hashes": _steps_of(hashes[order]),
            "codes": _blocks.shrink(number[_blocks.grow(row["codes"], np.uint32)]),
            "per_text": _blocks.shrink(np.array(row["per_text"], dtype=np.int64)),
            "train": np.array(row["weights"], dtype=np.uint8).tobytes(),
            "counts": _blocks.shrink(np.append(counts[often[order]], np.arange(MIN_COUNT, dtype=np.uint64)))}], schema=_STATE_SCHEMA)

    def pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = _Levels(row, sums, gram_buckets)
                levels.next_level()
                yield from pa.Table.from_pylist(levels.sequences(row["block"], np.frombuffer(row["train"], dtype=np.uint8)),
                                                schema=_STEP_SCHEMA).to_batches()

    def step(row, levels):
        made = levels.retained(row["block"])
        if levels.level < DEPTH:
            levels.next_level()
            made += levels.sequences(row["block"], np.frombuffer(row["train"], dtype=np.uint8))
        return pa.Table.from_pylist(made, schema=_STEP_SCHEMA)

    def score(row, levels):
        n = len(levels.per_text)
        doc = np.repeat(np.arange(n), levels.per_text)
        total = lambda x: np.bincount(doc, weights=x, minlength=n)
        return pa.table([
            pa.array(row["doc_ids"], pa.int64()), pa.array(levels.per_text), pa.array(total(levels.known).astype(np.int64)),
            pa.array(np.full(n, sums["total"], dtype=np.int64)), pa.array(total(np.log10(levels.zero))),
            pa.array(total(np.log10(levels.p)))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    blocks = cut.where("bucket IS NULL").select("block", "digest", "doc_ids", "per_text", "codes", "weights")
    state = written(_blocks.joined(blocks, values.where("block >= 0").select("block", "bucket", "digest", "counts", "hashes"),
                                   begin, _STATE), "suffix-blocks", drop=[values, cut])
    answers = [written(_meet(state.mapInArrow(pairs, _STEP)), "suffix-answers")]  # pairs wait for no answers
    for level in range(1, DEPTH + 1):
        steps = written(_by_block(state, answers, level, sums, gram_buckets, _STEP, step, False), "suffix-steps")
        # one after the other: the shuffle files of the first are gone when the second writes its own
        if level < DEPTH:
            answers.append(written(_meet(steps.where(F.col("kind") == _GRAMS)), "suffix-answers"))
        answers.append(written(_meet(steps.where(F.col("kind") != _GRAMS)), "suffix-answers", drop=[steps]))
    return _by_block(state, answers, DEPTH, sums, gram_buckets,
                     "doc_id LONG, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, score DOUBLE", score, True)


def query(spark, sf_dir: str) -> DataFrame:
    held_out = in_fold("doc_id", 7, 2)
    return suffix_tree_scores(table(spark, sf_dir, "documents"), held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
