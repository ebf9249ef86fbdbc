"""Mixing sources to target weights by capped water-filling.

A document's size is its number of words. Sources in code-point order (null
last) take the weights in turn. Each source's target is
``min(cap * size, level * weight)``; the level at which the targets add up to
all sizes is found in closed form: sources sorted by ``cap * size / weight``
are clamped while their ratio is at most the level the rest would get. The
targets become repetitions: every document is taken ``floor(target / size)``
times, and documents in seeded hash order are taken once more until the source
has reached its target, so a source misses it by less than one document.

Scale: sizes are counted in one pass and written to the shared folder; sources
are pre-aggregated by (source, hash bucket). Only documents of a source's one
edge bucket are ordered by a window, 1 / 4,096 of the source, so a source with a
third of all rows never meets in one task. What is decided is one row per
source: whole repetitions and the last draw that is taken once more.

Defined results: null text is empty (size 0, taken 0); a null source is a
source of its own; an empty table gives an empty result; rows with equal ids
have one draw, so they are taken equally often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import table, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
HEX_DIGITS = 3  # of a document's hash: 4,096 buckets


def word_count(text):
    return F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("at"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights)).cast("int") + 1)
    ranked = ranked.select("source", "source_size", weight.alias("weight"),
                           (F.col("source_size") * float(cap)).alias("most"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, rest = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    filled = ranked.select(
        "*", ((total - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
              / (rest - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"))
    # clamped sources are a prefix of the order; the first source that is not clamped sets the level of all the rest
    level = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"),
                         F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("level").alias("level")))
                  ).over(everything)["level"]
    return filled.select("source", "source_size", F.when(level.isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), level * F.col("weight"))).alias("target"))


def draws(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, size, draw): a document's words and its place in the seeded order."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.coalesce(F.col(text), F.lit(""))).alias("size"), _draw(F.col(doc_id), seed).alias("draw"))


def _draw(doc_id, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_plan(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``draws`` to one row per source: source, source_size, target, ``whole``
    repetitions of every document, and ``cutoff``: documents with a draw up to
    it are taken once more."""
    bucket = F.substring("draw", 1, HEX_DIGITS)
    buckets = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    goals = targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.floor(F.col("target") / F.col("source_size"))).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("extra", F.col("target") - whole * F.col("source_size"))
    ahead = F.coalesce(F.sum("in_bucket").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first bucket that does not fit as a whole; no draw is as large as "g"
    edges = (buckets.withColumn("ahead", ahead).join(_named(goals, "g_"), F.col("source").eqNullSafe(F.col("g_source")))
             .where(F.col("ahead") + F.col("in_bucket") > F.col("g_extra"))
             .groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("g_extra") - F.col("ahead")).alias("room")),
                                             "bucket").alias("edge"))
             .select(F.col("source").alias("e_source"), F.col("edge.bucket").alias("e_bucket"),
                     F.col("edge.room").alias("e_room")))
    in_edge = sized.join(edges, F.col("source").eqNullSafe(F.col("e_source")) & (bucket == F.col("e_bucket")))
    tied = in_edge.groupBy("source", "draw").agg(F.sum("size").alias("size"), F.first("e_room").alias("room"))
    passed = F.coalesce(F.sum("size").over(
        Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document is taken once more while at least half of it still fits
    last = (tied.withColumn("passed", passed).where(F.col("passed") + F.col("size") / 2 <= F.col("room"))
            .groupBy("source").agg(F.max("draw").alias("last")))
    return (goals.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left")
            .join(_named(last, "l_"), F.col("source").eqNullSafe(F.col("l_source")), "left")
            .select("source", "source_size", "target", "whole",
                    F.coalesce("l_last", "e_bucket", F.lit("g")).alias("cutoff")))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _times(draw):
    return F.col("p_whole") + (draw <= F.col("p_cutoff")).cast("long")


def plan_repetitions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                     weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target and
    ``times``, how often the mix takes the document."""
    sized = written(draws(docs, doc_id, text, source, seed), "mix-sizes")
    plan = _named(source_plan(sized, weights, cap), "p_")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "source", "size", F.col("p_source_size").alias("source_size"),
        F.col("p_target").alias("target"), _times(F.col("draw")).alias("times"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: docs' columns, each row as often as the
    mix takes it. Texts are joined with one row per source only."""
    sized = written(draws(docs, doc_id, text, source, seed), "mix-sizes")
    plan = written(_named(source_plan(sized, weights, cap), "p_"), "mix-plan")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("s"), _draw(F.col(doc_id), seed).alias("draw"))
    joined = rows.join(plan, F.col("s").eqNullSafe(F.col("p_source")))
    return joined.select("row", _times(F.col("draw")).cast("int").alias("times")).where("times > 0").select(
        F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    plan = plan_repetitions(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
