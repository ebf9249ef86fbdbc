"""Tables of the registered queries and intermediates in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# removes a query's shuffle files when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, drop: Iterable[DataFrame] = ()) -> DataFrame:
    """df written as Parquet below ``spark.checkpoint.dir`` and read back: cuts
    lineage, and a lost executor does not re-run what made it. The shuffle files
    of the write go when it ends, and so do the written tables named in ``drop``,
    which nothing but df may still read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_path = path
    for old in drop:
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old.written_path)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return made


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns most operators read, under fixed names; null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def in_fold(doc_id: str, divisor: int, remainder: int):
    """crc32 of the id as text, modulo divisor, equals remainder (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))
