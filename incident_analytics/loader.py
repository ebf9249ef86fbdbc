"""Export → gold table (E11): read CSV, clean, write Parquet, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators.clean import clean, clean_observed
from .operators.summary import write_summary
from .sources import batches
from .sources.gold import gold_table, read_gold, write_gold
from .sources.raw import read_raw_csv


def add_batch(rows: DataFrame, gold_path: str, batch: str, replace: bool = False, summary: bool = False,
              **layout) -> bool:
    """Write clean rows as a batch of the table and publish it; False (and nothing
    written) if readers see a batch of this id already.

    With ``summary`` the batch's part of the daily summary is published with it,
    and so are the parts of earlier batches that have none; later batches of a
    table with a summary always bring theirs."""
    spark = rows.sparkSession
    if not replace:
        batches.check_appendable(spark, gold_path)
    folder = batches.folder_of(spark, gold_path, batch, replace)
    listed = batches.live(spark, gold_path) or []
    if folder in listed:
        return False
    write_gold(rows, f"{gold_path}/{folder}", **layout)
    done = batches.summary_folders(spark, gold_path)
    if summary or (done & set(listed) and not replace):
        for name in [folder, *([] if replace else [b for b in listed if b not in done])]:
            write_summary(gold_table(spark, gold_path, [name]), f"{gold_path}/{batches.SUMMARY}/{name}")
    return batches.publish(spark, gold_path, folder, replace)


def _cleaned_once(raw: DataFrame, gold_path: str, folder: str) -> DataFrame:
    """The clean rows of an export that is read once: rows are cleaned and
    written aside, kept and rejected ones apart, while the audit's counts are
    observed; the clean rows are read back. The write has no shuffle, so a
    partition that is run again after a lost executor is counted once."""
    spark = raw.sparkSession
    observation = Observation("cleaning")
    aside = f"{gold_path}/{batches.REJECTS}/{folder}"
    rows = clean_observed(raw, observation)
    rows.write.mode("overwrite").partitionBy("rejected").parquet(aside)
    counts = [(name, int(n)) for name, n in observation.get.items()]  # one number a rule
    audit = spark.createDataFrame(counts, "rule STRING, rows LONG").coalesce(1)
    audit.write.mode("overwrite").parquet(f"{gold_path}/{batches.AUDIT}/{folder}")
    gold = [f for f in rows.schema.fields if f.name not in ("failed", "raw", "rejected")]
    stored = spark.read.schema(rows.schema).parquet(aside)  # the partition column keeps its type
    return stored.where(~F.col("rejected")).select(*[f.name for f in gold])


def load_export(spark: SparkSession, csv_path: str, gold_path: str, mode: str = "overwrite",
                summary: bool = False, batch_id: str | None = None, audit: bool = False, **layout) -> DataFrame:
    """Clean every row of the export at ``csv_path`` into the gold table at
    ``gold_path`` (``overwrite`` replaces, ``append`` adds); returns the table,
    read back through the standard scan. ``layout``: as for ``write_gold``.

    The load is one batch, by default named after the export's files, and can be
    run again at any point: rows and summary appear together at its end, and an
    export that is in the table already is not appended twice.

    With ``audit`` the same scan of the export also gathers the cleaning's counts
    and the rejected rows with the rules that they fail: ``read_audit``,
    ``read_rejects``. The clean rows are written once more for it, aside."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', not {mode!r}")
    raw, replace = read_raw_csv(spark, csv_path), mode == "overwrite"
    batch = batch_id or batches.export_id(spark, csv_path)
    if not audit:
        add_batch(clean(raw), gold_path, batch, replace=replace, summary=summary, **layout)
        return read_gold(spark, gold_path)
    folder = batches.folder_of(spark, gold_path, batch, replace)
    if folder not in (batches.live(spark, gold_path) or []):
        if not replace:
            batches.check_appendable(spark, gold_path)
        add_batch(_cleaned_once(raw, gold_path, folder), gold_path, batch, replace=replace, summary=summary, **layout)
        # what is left aside are the rejected rows
        batches.remove(spark, f"{gold_path}/{batches.REJECTS}/{folder}/rejected=false")
    return read_gold(spark, gold_path)


def read_audit(spark: SparkSession, gold_path: str) -> DataFrame:
    """(rule, rows): the cleaning's counts over the table's batches that were
    loaded with ``audit``, as ``clean_audit`` gives them over their exports."""
    found = batches.parts_of(spark, gold_path, batches.AUDIT)
    schema = "rule STRING, rows LONG"
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    return rows.groupBy("rule").agg(F.sum("rows").alias("rows"))


def read_rejects(spark: SparkSession, gold_path: str) -> DataFrame:
    """(failed, raw): every row that the cleaning of those batches rejected, with
    the names of the rules it fails and a map of the export's columns as read."""
    schema = "failed ARRAY<STRING>, raw MAP<STRING, STRING>, rejected BOOLEAN"
    found = batches.parts_of(spark, gold_path, batches.REJECTS)
    rows = (spark.read.schema(schema).option("basePath", f"{gold_path}/{batches.REJECTS}").parquet(*found)
            if found else spark.createDataFrame([], schema))
    return rows.where("rejected").select("failed", "raw")


def compact(spark: SparkSession, gold_path: str, **layout) -> DataFrame:
    """Rewrite all batches of a table as one (many small nightly batches make many
    small files); readers see the old ones until it is done. Ids of the merged
    batches are forgotten, so they could be appended again."""
    listed = batches.live(spark, gold_path)
    if listed is None:
        raise ValueError(f"{gold_path} was not written in batches")
    rows = gold_table(spark, gold_path)
    merged = "merged-" + batches.name_digest(listed)
    add_batch(rows.drop("year", "batch"), gold_path, merged, replace=True,
              summary=bool(batches.summary_folders(spark, gold_path) & set(listed)), **layout)
    return read_gold(spark, gold_path)
