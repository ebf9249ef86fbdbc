"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built from Spark's own functions. ``measures`` gives the counts
of a text, ``RULES`` compares them, ``verdict`` compiles the table into one
boolean expression; there are no user functions. Higher-order functions would
evaluate an outer expression again for every element, so values used inside a
lambda are bound first with ``_let``.

Defined results: a null text counts as empty, has zero words and fails
``n_words < 10``; rows with equal ids are judged on their own; an empty table
gives an empty result; other columns are never read. Repeated five-word windows
are found by 64-bit hashes compared within one text only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# fixed values: frequent function words of English, German, Spanish and French
STOP_WORDS = """
the of and to in a is that for it was on are as with be by this from an at or have not they you his had but
der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya este
le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur par les des la une est avec plus
""".split()

# a text is rejected when 100 * measure > bound * per holds ("most") or 100 * measure < bound * per ("least"),
# for texts of at least min_words words
RULES = [
    # name, measure, kind, bound, per, min_words
    ("symbols", "n_symbols", "most", 5, "word_chars", 0),
    ("upper_case", "n_upper", "most", 40, "word_chars", 10),
    ("stop_words", "n_stop", "least", 4, "n_words", 30),
    ("duplicate_lines", "n_dup_lines", "most", 50, "n_lines", 0),
    ("short_words", "word_chars", "least", 200, "n_words", 0),
    ("long_words", "word_chars", "most", 2000, "n_words", 0),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_upper"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, the first included."""
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

    def covered(w):
        marked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(marked, lambda m: F.transform(
            F.filter(m, lambda s, j: (F.coalesce(s["h"] == F.get(m, j - 1)["h"], F.lit(False)))
                     | (F.coalesce(s["h"] == F.get(m, j + 1)["h"], F.lit(False)))),
            lambda s: s["i"]))
        return _let(F.array_sort(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))),
            F.lit(0), lambda a, x: a + x))

    counted = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(
        windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(counted)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(text: Column) -> Column:
    """Struct of all MEASURES (long) of a text."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))

    def of_words(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
            _is_stop(w).cast("long").alias("n_stop"))

    def _is_stop(w):
        return F.size(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS)))))

    def of_lines(lines):
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(_let(F.array_remove(F.split(spaced, " ", -1), ""), of_words), lambda a: _let(
        _let(with_word, of_lines), lambda b: F.struct(
            a["n_words"].alias("n_words"), a["word_chars"].alias("word_chars"),
            _count_of(text, SYMBOLS).cast("long").alias("n_symbols"), b["n_dup_lines"].alias("n_dup_lines"),
            a["n_repeat_words"].alias("n_repeat_words"), b["n_lines"].alias("n_lines"),
            a["n_stop"].alias("n_stop"), _count_of(text, UPPER).cast("long").alias("n_upper"))))


def base_failed(m: Callable[[str], Column]) -> Column:
    return (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))


def broken(rule: tuple, m: Callable[[str], Column]) -> Column:
    _, measure, kind, bound, per, min_words = rule
    left, right = 100 * m(measure), bound * m(per)
    return (m("n_words") >= min_words) & ((left > right) if kind == "most" else (left < right))


def verdict(m: Callable[[str], Column], rules: list[tuple] = RULES) -> Column:
    """True if the text breaks neither the base rule nor any rule of the table."""
    return ~reduce(lambda a, b: a | b, [broken(r, m) for r in rules], base_failed(m))


def quality_rules(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """docs' columns, with the struct ``quality``: the measures, ``base_failed``,
    ``broken`` (names of broken rules) and ``kept``. An input column of the name
    ``quality`` is replaced."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    judged = _let(measures(clean), lambda m: F.struct(
        *[m[c].alias(c) for c in MEASURES],
        base_failed(lambda c: m[c]).alias("base_failed"),
        F.array_compact(F.array(*[F.when(broken(r, lambda c: m[c]), F.lit(r[0])) for r in rules])).alias("broken"),
        verdict(lambda c: m[c], rules).alias("kept")))
    return docs.withColumn("quality", judged)


def kept_rows(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """The rows of docs that pass, with docs' own columns."""
    judged = quality_rules(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", rules)
    return judged.where(F.col("quality.kept")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from ._io import table
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in MEASURES],
                         F.col("quality.base_failed").alias("base_failed"), F.col("quality.kept").alias("kept"))


def oracle() -> str:
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    fails = " OR ".join(
        f"(n_words >= {least} AND 100 * {m} {'>' if kind == 'most' else '<'} {bound} * {per})"
        for _, m, kind, bound, per, least in RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
             generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM t),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e
      FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, b, c, d, e) AS k FROM g WHERE e IS NOT NULL)
        WHERE k > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
ws AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
              count(*) FILTER (lower(w) IN ({stop})) AS n_stop FROM w GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stop, 0) AS n_stop,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM t LEFT JOIN ws USING (r) LEFT JOIN ls USING (r) LEFT JOIN cov USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT ((n_words < 10 OR 100 * n_repeat_words > 20 * n_words) OR {fails}) AS kept
FROM m"""
