"""Incremental ingest with Structured Streaming.

The batch loader appends the export chunk by chunk; the streaming form
appends each newly landed CSV file as a micro-batch: read by the names of the
landed files' header, clean (stateless, per row), append to the year-partitioned gold
table. The checkpoint folder records which files are done, so a restarted or
partly failed run neither loses nor duplicates files.

Each micro-batch is a batch of the gold table as a load's export is (see
``sources.batches``): named after the stream and the batch's number, written
aside and published in one step, with its part of the daily summary if asked
for. A batch that is replayed after a failure finds itself published, or
overwrites what it left. Loads and streams can fill the same table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..loader import add_batch
from ..operators.clean import clean
from ..sources import batches
from ..sources.raw import CSV_OPTIONS, header_schema, named_rows, raw_schema


def _add(gold_dir: str, summary: bool):
    def write(batch, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        add_batch(batch, gold_dir, f"stream-{stream}-{number}", summary=summary)
    return write


def start_ingest(spark: SparkSession, landing_dir: str, gold_dir: str, checkpoint_dir: str,
                 files_per_batch: int | None = None, available_now: bool = True,
                 summary: bool = False, columns: list[str] | None = None) -> StreamingQuery:
    """Start the ingest stream; with ``available_now`` it processes every file
    present at start (in batches of ``files_per_batch``) and then stops.

    ``columns``: the files' header names, to start before the first has
    landed. A file with another header fails its batch; a gold folder that was
    not written in batches raises."""
    batches.check_appendable(spark, gold_dir)
    schema = raw_schema(columns) if columns else header_schema(spark, landing_dir)
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = named_rows(reader.csv(landing_dir))
    writer = (clean(raw).writeStream.foreachBatch(_add(gold_dir, summary))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
