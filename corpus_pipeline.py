"""Corpus pipeline: five stages over the documents table, each one of the
training-data operators. A stage's result is written as Parquet and read again
as the next stage's documents, so a lost executor repeats one stage at most.

1. quality rules: rows that a rule rejects go;
2. near-duplicates (five-word shingles, similarity 0.8): the document of least
   id of each group stays, and one of rows with an equal id and text;
3. personal data: spans in the text become their kind in brackets, ``n_chars``
   is the new text's length in code points;
4. mixing: each row is repeated as often as its source's target asks;
5. BPE: a row per document of the mix with its token ids and decoded text.

Stages 1 to 4 return the columns of ``documents``. Null texts count as empty
and fail the quality rules; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incident_analytics.llm import bpe_table, mixing, near_dedup, pii, quality_rules
from incident_analytics.llm._io import id_and_text, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = pii.redact(docs, pii.train(id_and_text(docs)))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids in order joined by commas, and the decoded text."""
    # written in between: a task with two Python steps has two Python workers, and idle ones stay with the executor
    ids = written(bpe_table.encode_documents(docs), "pipeline-ids")
    return bpe_table.decode_documents(ids, digests=True)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("pii", redact), ("mixing", mix), ("bpe", tokens)]

# MinHash, boosted trees and a tokenizer are beyond SQL: tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
