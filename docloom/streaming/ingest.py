"""Incremental ingestion: a folder is watched and each micro-batch goes through the idempotent insert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import insert, with_ids


def watch(spark: SparkSession, folder: str, fmt: str = "parquet", schema=None, pattern: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream; binaryFile for documents, any other file format for rows."""
    r = spark.readStream.format(fmt).option("maxFilesPerTrigger", per_trigger)
    if schema is not None:
        r = r.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.load(folder)


def ingest(stream: DataFrame, to_elements: Callable[[DataFrame], DataFrame], doc_path: str, vector_path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Write what each micro-batch brings that is not stored yet.  A batch that is run again inserts nothing twice, so the stores are exactly once."""

    def batch(df: DataFrame, _: int) -> None:
        insert(df.sparkSession, with_ids(to_elements(df)), doc_path, vector_path, order)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
