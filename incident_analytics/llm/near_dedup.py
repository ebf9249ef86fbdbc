"""Near-duplicates by MinHash with tensored banding, links confirmed on full sets.

A document's set is its distinct w-word shingles (64-bit hashes). Two
collections of ``SIDE`` keys are computed, each key from ``BAND`` minimum
hashes; table (i, j) is keyed by key i of the first and key j of the second
collection. So ``SIDE**2`` tables of ``2 * BAND`` hashes each need only
``2 * SIDE * BAND`` minimum hashes. With the defaults a pair at similarity 0.8
meets in some table with probability 0.9985 and one at 0.85 with 0.9998.

Documents with equal sets are collapsed first, by a 128-bit digest of the set.
In each table's bucket all members are compared with one member, the hub;
candidates pass a sketch of one bit per minimum hash and a size bound, then
the full sets decide. Verified links contract into components. Of the buckets
that still hold several components, those of at most ``SMALL`` members are
compared by pairs across components (at most SMALL / 2 rows a member); members
of larger ones are compared in tiles that return links which join all that the
tile's links join. So a group of thousands of near copies is never expanded
into rows of pairs, and yet no link that shares a bucket is left out.

Components are found by rounds of contraction to the neighbour of least id or
of least seeded hash, in turn, each round written to the shared folder; nothing
but counts reaches the driver. Defined results: null and empty texts, and texts without a
word, have the empty set, are linked with nothing and are kept; a null id is
kept, unlinked, with a null component; rows with an equal id count as one
document if their texts have equal sets, else as several: each has its own
links, and one goes if it is a near copy of another; an empty table gives an
empty result. The nodes of all links are classes of equal sets: the least id
and the set's digest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import id_and_text, table, written
from ._ship import ship
from ._text import list_array, mix, slices, utf8, words

SIDE = 10
BAND = 3
PERCENT = 80
SEED = 20240229
SMALL = 32   # members of a bucket that is compared by pairs; larger ones go by tiles
CHUNK = 256  # members of a cluster in half a tile
# a pair at the threshold differs in about 6 of 60 sketch bits; more than 20 has a chance near 1e-6
SKETCH_BITS = 2 * SIDE * BAND
SKETCH_MOST = 20
SLICE_BYTES = 8 << 20
_U64 = np.uint64

_KEYS = mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15) + _U64(SEED))
_FACTORS = mix(_KEYS) | _U64(1)


def shingle_hashes(h: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' w-word shingles (with fewer words, of the whole
    sequence) and their number per text, repeats included."""
    n = np.where(per_text >= width, per_text - width + 1, (per_text > 0).astype(np.int64))
    first = np.cumsum(per_text) - per_text
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for k in range(1, width):
            step = _U64(2 * k + 1) * _U64(0x9FB21C651E98DF25)
            rolled[:len(h) - k] = mix(rolled[:len(h) - k] * _U64(0xD6E8FEB86659FD93) + h[k:] * step)
    starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = rolled[starts]
    short = np.flatnonzero((per_text > 0) & (per_text < width))
    at = np.cumsum(n) - n
    for t in short:  # a text of fewer words: its own words and their number
        with np.errstate(over="ignore"):
            total = _U64(per_text[t])
            for x in h[first[t]:first[t] + per_text[t]]:
                total = mix(np.array([total * _U64(0xD6E8FEB86659FD93) + x]))[0]
        out[at[t]] = total
    return out, n


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    cut = words(*utf8(texts), lower=True)
    hashes, n = shingle_hashes(cut.hashes(), cut.per_text.astype(np.int64), width)
    ends = np.cumsum(n)
    return [np.unique(hashes[e - k:e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


_FEATURES = ("doc_id LONG, text_key LONG, n_shingles LONG, digest_a LONG, digest_b LONG, sketch LONG, "
             "first ARRAY<LONG>, second ARRAY<LONG>")


_NODE = "STRUCT<doc_id: LONG, digest_a: LONG, digest_b: LONG>"


def _node(doc_id: str = "doc_id"):
    """The class of a row's set, ordered by id."""
    return F.struct(F.col(doc_id).alias("doc_id"), "digest_a", "digest_b")


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set, not an empty one."""
    with np.errstate(over="ignore"):
        return (mix(s + _U64(3)).sum(dtype=np.uint64) + _U64(len(s)),
                mix(s ^ _U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _features(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n = part.num_rows
                sizes, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                least = np.zeros((n, SKETCH_BITS), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for t, s in enumerate(sets_of(part.column("text"), width)):
                        if len(s):
                            sizes[t] = len(s)
                            a[t], b[t] = _digest(s)
                            least[t] = _least(s)
                    bits = (mix(least) & _U64(1)) << np.arange(SKETCH_BITS, dtype=np.uint64)
                    keys = least.reshape(n, 2 * SIDE, BAND)
                    key = reduce(lambda x, k: mix(x * _U64(0xD6E8FEB86659FD93) + keys[:, :, k]), range(BAND),
                                 np.zeros((n, 2 * SIDE), np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                    pa.array(np.bitwise_or.reduce(bits, axis=1).view(np.int64)),
                    list_array(key[:, :SIDE].ravel(), np.full(n, SIDE), pa.int64()),
                    list_array(key[:, SIDE:].ravel(), np.full(n, SIDE), pa.int64())],
                    names=["doc_id", "text_key", "n_shingles", "digest_a", "digest_b", "sketch", "first", "second"])
    return run


def _least(s: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set, some elements at a time."""
    out = np.full(SKETCH_BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 4096):
        x = (s[None, lo:lo + 4096] ^ _KEYS[:, None]) * _FACTORS[:, None]
        out = np.minimum(out, (x ^ (x >> _U64(29))).min(axis=1))
    return out


def features(docs: DataFrame, width: int) -> DataFrame:
    """Per row: set size, set digest, sketch and the two key collections."""
    ship(docs.sparkSession)
    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_features(width), _FEATURES)


def contract(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in links (a, b): roots name the components.

    Each round maps every node to the least of itself and its neighbours and
    replaces links by those between the images. Even rounds take the least id,
    which folds a star around its hub (a bucket's least member) at once; odd
    rounds take the least hash of the round, which shrinks chains by a constant
    factor whatever their order. Images are composed from the last round, the
    smallest, back to the first."""
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                                        .alias("e")).select("e.*")
    links, images = written(both.distinct(), name), []
    while not links.isEmpty():
        round_ = len(images)
        rank = (lambda c: c) if round_ % 2 == 0 else (lambda c, r=round_: F.xxhash64(F.lit(r), c))
        draw = lambda c, rank=rank: F.struct(rank(c).alias("h"), c.alias("n"))
        image = written(links.groupBy("a").agg(F.least(F.min(draw(F.col("b"))), draw(F.col("a"))).alias("m"))
                        .select(F.col("a").alias("node"), F.col("m.n").alias("root")), name)
        links = written(
            links.join(image.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(image.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        images.append(image)
    if not images:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = images.pop()
    while images:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = images.pop().join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(roots, name)


def _relabel(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their component (``root``) after new links between components."""
    return members.join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select(
        *[c for c in members.columns if c != "root"], F.coalesce("next", "root").alias("root"))


def _may_link(percent: int):
    """Size bound and sketch of a pair with columns n, sketch and o_n, o_sketch."""
    return ((100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n"))
            & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("o_sketch"))) <= SKETCH_MOST))


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    return written(pairs.where(_may_link(percent)).select(
        F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct(), "dedup-pairs")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, elements): full shingle sets of all texts of the wanted nodes' ids,
    computed again from the texts, so sets of documents without a candidate are
    never moved."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                s = sets_of(part.column("text"), width)
                digests = np.array([_digest(x) for x in s], dtype=np.uint64).reshape(len(s), 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    list_array(np.concatenate(s).view(np.int64), np.array([len(x) for x in s]), pa.int64())],
                    names=["doc_id", "digest_a", "digest_b", "elements"])

    # the ids wanted grow with the corpus: never a broadcast, at any size
    ids = wanted.select(F.col("rep.doc_id").alias("doc_id")).distinct().hint("merge")
    texts = docs.join(ids, "doc_id", "left_semi")
    made = texts.mapInArrow(run, "doc_id LONG, digest_a LONG, digest_b LONG, elements ARRAY<LONG>")
    return written(made.dropDuplicates(["doc_id", "digest_a", "digest_b"]).select(_node().alias("rep"), "elements"), "dedup-sets")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    sets = _sets(docs, wanted, width)
    one = sets.select(F.col("rep").alias("a"), F.col("elements").alias("x"))
    other = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return written(pairs.join(one, "a").join(other, "b").where(
        100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "dedup-links")


def _tiled(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the members of large mixed buckets. Members that share such a
    bucket form a cluster; a cluster is dealt into chunks of about CHUNK, and a
    task compares two chunks' full sets by a product of incidence matrices and
    returns, for every member with a link, one link to the least member it
    reaches inside the tile, so rows grow with members and not with their
    pairs. A member goes to one task per chunk."""
    hubs = members.groupBy("key").agg(F.min("rep").alias("b"))
    clusters = contract(members.join(hubs, "key").select(F.col("rep").alias("a"), "b").distinct(), "dedup-clusters")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    placed = clusters.join(sizes, "root").select(
        F.col("node").alias("rep"), "root", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("c"))
    dealt = placed.join(_sets(docs, placed.select("rep"), width), "rep").select(
        "root", "c", "rep", "elements", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(
        "root", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "elements")

    def compare(key, group):
        ids = group.column("rep").combine_chunks()
        chunk = group.column("c").to_numpy()
        lists = group.column("elements").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        values, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), n)
        # elements of one set only cannot be shared
        common = np.flatnonzero(np.bincount(at, minlength=len(values)) > 1)
        place = np.full(len(values), -1)
        place[common] = np.arange(len(common))
        column = place[at]
        shared = np.zeros((len(ids), len(ids)), dtype=np.float32)
        for lo in range(0, len(common), 4096):
            inside = (column >= lo) & (column < lo + 4096)
            incidence = np.zeros((len(ids), 4096), dtype=np.float32)
            incidence[owner[inside], column[inside] - lo] = 1.0
            shared += incidence @ incidence.T
        both = np.rint(shared).astype(np.int64)
        near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        if key[1].as_py() != key[2].as_py():  # pairs inside a chunk belong to its own tile
            near &= chunk[:, None] != chunk[None, :]
        near |= np.eye(len(ids), dtype=bool)
        # least row reachable inside the tile: links to it join what the tile's links join
        least, before = np.arange(len(ids)), None
        while before is None or (least != before).any():
            before = least
            least = np.where(near, least[None, :], len(ids)).min(axis=1)
        of = np.flatnonzero(least != np.arange(len(ids)))
        return pa.table({"a": ids.take(pa.array(least[of])), "b": ids.take(pa.array(of))})

    return written(dealt.groupBy("root", "i", "j").applyInArrow(compare, f"a {_NODE}, b {_NODE}"), "dedup-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row; kept is
    true on the row whose id is its component's least (of several texts of that
    id in the component, on those of one set)."""
    return _labelled(docs, doc_id, text, width, percent).drop("text_key")


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    rows = id_and_text(docs, doc_id, text)
    found = written(features(rows, width), "dedup-features")
    full = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # one representative for equal sets
    classes = written(full.groupBy("digest_a", "digest_b").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.first("first").alias("first"), F.first("second").alias("second")).withColumn(
        "rep", _node("least_id")), "dedup-classes")
    tables = classes.select("rep", "n", "sketch", F.posexplode("first").alias("i", "one"), "second").select(
        "rep", "n", "sketch", "i", "one", F.posexplode("second").alias("j", "two")).select(
        F.xxhash64("i", "j", "one", "two").alias("key"), "rep", "n", "sketch")
    shared = tables.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    # so do the shared keys
    members = written(tables.join(shared.hint("merge"), "key").withColumn("root", F.col("rep")), "dedup-members")
    # every member against its bucket's hub
    hubs = members.groupBy("key").agg(F.min_by(F.struct("rep", "n", "sketch"), "rep").alias("hub")).select(
        "key", F.col("hub.rep").alias("o_rep"), F.col("hub.n").alias("o_n"), F.col("hub.sketch").alias("o_sketch"))
    links = _verify(_candidates(members.join(hubs, "key").where("rep <> o_rep"), percent), rows, width, percent)
    roots = contract(links, "dedup-components")
    # buckets of several components: small ones by pairs, large ones by tiles
    members = _relabel(members, roots)
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                       F.count(F.lit(1)).alias("size")).where("lo < hi").select("key", "size")
    members = written(members.join(mixed, "key"), "dedup-members")
    small = members.where(F.col("size") <= SMALL)
    others = small.select("key", *[F.col(c).alias("o_" + c) for c in ("rep", "n", "sketch", "root")])
    pairs = _candidates(small.join(others, "key").where("root < o_root"), percent)
    links = links.unionByName(_verify(pairs, rows, width, percent))
    large = members.where(F.col("size") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_tiled(large, rows, width, percent))
    roots = contract(links, "dedup-components")
    least = roots.join(roots.groupBy("root").agg(F.min("node").alias("least")), "root").select(
        F.col("node").alias("rep"), "least")
    labels = classes.join(least, "rep", "left").select(
        "digest_a", "digest_b", F.coalesce("least", "rep").alias("component"))
    linked = full.select("doc_id", "text_key", "n_shingles", "digest_a", "digest_b").join(labels, ["digest_a", "digest_b"]).select(
        "doc_id", "text_key", "n_shingles", F.col("component.doc_id").alias("component_id"),
        (F.col("component") == _node()).alias("kept"))
    alone = found.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(
        "doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
              percent: int = PERCENT) -> DataFrame:
    """docs' rows without those in a component with a smaller id or set of that
    id; of rows with an equal id and text one stays."""
    gone = written(_labelled(docs, doc_id, text, width, percent).groupBy("doc_id", "text_key").agg(
        F.bool_and("kept").alias("all_kept"), F.count(F.lit(1)).alias("rows")).where(
        F.col("doc_id").isNotNull() & (~F.col("all_kept") | (F.col("rows") > 1))), "dedup-gone").select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_text"), "all_kept")
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    marked = packed.join(gone, (F.col("i") == F.col("gone_id")) & (
        F.xxhash64(F.coalesce(F.col("t").cast("string"), F.lit(""))) == F.col("gone_text")), "left")
    single = marked.where("gone_id IS NULL")
    repeated = marked.where("all_kept").dropDuplicates(["i", "t"])
    return single.unionByName(repeated).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
