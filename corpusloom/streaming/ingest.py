"""Incremental ingestion with Structured Streaming: each batch of new files is merged into the corpus exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.api import Engine
from corpusloom.operators.corpus import SCHEMA


def merge_batch(engine: Engine, batch: DataFrame, batch_id: int) -> None:
    """Merges a batch and brings the index up to date; a batch that is delivered again changes nothing.

    The stream's batch number is stored with the documents' version, in the same commit.
    """
    if batch_id >= engine.processed():
        engine.add_documents(batch, processed=batch_id + 1)
    engine.index()  # also if the last run failed between the two


def ingest_folder(spark: SparkSession, folder: str, engine: Engine, checkpoint: str, files_per_batch: int = 100, archive: str | None = None):
    """Reads all JSON files of documents that came since the last call (trigger availableNow) and waits for the end.

    The checkpoint's file log says which files are done. Rows need pmid and any of the fields; order within a batch is by
    seq, else by the fields. Files that were merged are moved to the archive folder if there is one.
    """
    reader = spark.readStream.schema(SCHEMA + ", seq long").option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    stream = reader.json(folder)
    ordered = stream.withColumn("seq", F.coalesce("seq", F.lit(0)))
    query = ordered.writeStream.foreachBatch(lambda b, i: merge_batch(engine, b, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
