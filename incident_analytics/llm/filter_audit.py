"""Filter interaction audit with relations of failing ids.

Five filters over a documents table; a row fails

* A with fewer than 100 words (maximal ``[^\\x20\\x09-\\x0D]+``);
* B if its distinct words (case-sensitive) are under 80 % of its words;
* C if more than 10 % of its code points are ``[A-Z]``;
* D if it holds any of ``[#$%&*|]``;
* E if its text is that of a row with a smaller id, removed or not.

The texts are read once. What stays is one table of row keys per filter, the
rows that fail it. Everything else is joins of these tables:

* label flags: left-semi and left-anti joins with the labelled ids;
* after a set of filters: survivors are what is left of the failing rows by
  one left-anti join per filter (rows that fail nothing survive every set and
  are counted once);
* removed by filter f after a set: f's table, left-anti the set's tables; the
  rest of f's table is redundant there, and what is left after the four others
  fails f only.

A set's relation is made from the set without its last filter by one left-anti
join, so a level of sets is one union of five joins, written before the next.
An order's step looks up the set of filters in front of it. A failing row is in
at most 16 + 16 of these relations, whatever its copies: no join fans out, and
counts are pre-aggregated, so a hot text, language or id is no larger a group
than its rows.

A row's key is the digest of its id and text; equal rows share it and count
once each. Null text is empty: it fails A only (0 distinct words of 0, 0 of 0
code points) and E as any text does. A null id is neither smaller nor larger
than another; null and empty ``lang`` are one part, ''. An id counts as good
(toxic) if any of its labels is 1. An empty table has no parts and no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import table, written

FILTERS = "ABCDE"
SALTS = 16
_SYMBOLS = "[#$%&*|]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def failing_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, digest, doc_id, part, A, B, C, D): one pass over the texts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    rows = rows.select("doc_id", "part", _words(t).alias("words"), F.length(t).alias("chars"),
                       F.length(F.regexp_replace(t, "[^A-Z]+", "")).alias("capitals"),
                       t.rlike(_SYMBOLS).alias("D"), F.substring(F.unhex(F.sha2(t, 256)), 1, 16).alias("digest"))
    rows = rows.withColumns({"n": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    whose = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.hex("digest"))
    return rows.select(F.substring(F.unhex(F.sha2(whose, 256)), 1, 16).alias("key"), "digest", "doc_id", "part",
                       (F.col("n") < 100).alias("A"), (100 * F.col("n_distinct") < 80 * F.col("n")).alias("B"),
                       (100 * F.col("capitals") > 10 * F.col("chars")).alias("C"), "D")


def copies_of_smaller(rows: DataFrame) -> DataFrame:
    """Keys of rows whose text a row of a smaller id has. The digests of more
    than one id are few rows; they go to every salt of their digest, so the
    copies of one text are dealt over SALTS tasks."""
    least = (rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").select("digest", "least",
                                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    dealt = rows.select("key", "digest", "doc_id", F.pmod(F.hash("key"), F.lit(SALTS)).alias("salt"))
    return dealt.join(least, ["digest", "salt"]).where("doc_id > least").select("key")


def _flagged(rows: DataFrame, ids: DataFrame, on: str, flag: str) -> DataFrame:
    """rows with flag 1 if their id is in ids, else 0."""
    return (rows.join(ids, on, "left_semi").withColumn(flag, F.lit(1))
            .unionByName(rows.join(ids, on, "left_anti").withColumn(flag, F.lit(0))))


def _without(rows: DataFrame, fails: dict[str, DataFrame], names: str) -> DataFrame:
    """The next level: each set of ``done`` filters with one more, later filter."""
    last = F.substring("done", -1, 1)
    more = [rows.where((last < name) & (F.col("f") != name)).join(fails[name], "key", "left_anti")
            .withColumn("done", F.concat("done", F.lit(name))) for name in names]
    return reduce(DataFrame.unionByName, more)


def relation_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Counts of every relation, (part, f, done, n, good, toxic): with f, f's
    failing rows that pass all of done; with f = '', the rows of the part that
    pass all of done. Second: the parts. rows: (key, doc_id, part) and a
    boolean column per filter."""
    names = [c for c in rows.columns if len(c) == 1]
    labelled = {flag: labels.where(F.col(column) == 1).select(F.col(doc_id).cast("long").alias("doc_id"))
                for flag, column in (("good", "quality"), ("toxic", "toxic"))}
    any_fails = reduce(Column.__or__, [F.col(c) for c in names])
    ids = rows.select("key", "doc_id", "part", *names)
    for flag, known in labelled.items():
        ids = _flagged(ids, known, "doc_id", flag)
    ids = written(ids, "audit-ids")
    keep = ["key", "part", "good", "toxic"]
    fails = {c: written(ids.where(c).select(*keep), f"audit-fails-{c}") for c in names}
    known = {c: fails[c].select("key") for c in names}
    level = ids.where(any_fails).select(*keep, F.lit("").alias("f"))
    for c in names:
        level = level.unionByName(fails[c].withColumn("f", F.lit(c)))
    level = level.withColumn("done", F.lit(""))
    tally = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    counts = []
    for depth in range(len(names) + 1):
        level = level if depth == 0 else written(_without(level, known, "".join(names)), f"audit-level-{depth}")
        counts.append(level.groupBy("part", "f", "done").agg(*tally))
    clean = ids.where(~any_fails).groupBy("part").agg(*tally)
    sets = ["".join(s) for r in range(len(names) + 1) for s in combinations(names, r)]
    counts.append(clean.select("part", F.lit("").alias("f"), F.explode(F.lit(sets)).alias("done"), "n", "good", "toxic"))
    counts = reduce(DataFrame.unionByName, counts).groupBy("part", "f", "done").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return written(counts, "audit-counts"), ids.select("part").distinct()


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step."""
    rows = written(failing_rows(docs, doc_id, text, lang), "audit-rows")
    copies = written(copies_of_smaller(rows), "audit-copies")
    marked = (rows.join(copies, "key", "left_semi").withColumn("E", F.lit(True))
              .unionByName(rows.join(copies, "key", "left_anti").withColumn("E", F.lit(False))))
    counts, parts = relation_counts(marked, labels, doc_id)
    steps = [F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("f"),
                      F.lit("".join(sorted(order[:k]))).alias("before"), F.lit("".join(sorted(order[:k + 1]))).alias("after"),
                      F.lit("".join(c for c in FILTERS if c != f)).alias("others"))
             for order in permutations(FILTERS) for k, f in enumerate(order)]
    plan = parts.select("part", F.explode(F.array(*steps)).alias("s")).select("part", "s.*")

    def look(df, f, done, **columns):
        found = counts.select("part", F.col("f").alias(f if isinstance(f, str) else "_f"), F.col("done").alias(done),
                              *[F.col(c).alias(name) for name, c in columns.items()])
        if not isinstance(f, str):
            found = found.where(F.col("_f") == "").drop("_f")
        df = df.join(found, ["part", f, done] if isinstance(f, str) else ["part", done], "left")
        return df.fillna(0, list(columns))

    plan = look(plan, None, "after", kept="n")
    plan = look(plan, "f", "before", removed="n", good_lost="good", toxic_lost="toxic")
    plan = look(plan, "f", "others", unique_fails="n")
    failing = counts.where((F.col("f") != "") & (F.col("done") == "")).select("part", "f", F.col("n").alias("failing"))
    plan = plan.join(failing, ["part", "f"], "left").fillna(0, ["failing"])
    worth = plan.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return plan.join(worth, ["part", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    """DuckDB: the bits of the filters a row fails, counted for every order and step."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
    return f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
    least AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
    f AS (SELECT t.part, coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = t.doc_id), 0) = 1 AS good,
            coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = t.doc_id), 0) = 1 AS toxic,
            CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN t.doc_id > least.least THEN 'E' ELSE '' END AS fails
        FROM t JOIN least USING (text)),
    g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    steps AS (SELECT o AS filter_order, s AS step, o[s] AS letter, o[1:s - 1] AS before FROM (VALUES {orders}) v(o),
        (SELECT unnest(range(1, 6)) AS s)),
    x AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS fails_it,
            translate(fails, before, '') <> fails AS gone, fails = letter AS only_it
        FROM g, steps),
    y AS (SELECT part, filter_order, step, any_value(letter) AS letter,
            sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN NOT gone AND fails_it AND good THEN n ELSE 0 END) AS good_lost,
            sum(CASE WHEN NOT gone AND fails_it AND toxic THEN n ELSE 0 END) AS toxic_lost
        FROM x GROUP BY part, filter_order, step)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
        CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y"""
