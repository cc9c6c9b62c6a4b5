"""Continuous processing: paragraphs of lectures as their segment files arrive.

A file holds whole lectures, so a micro-batch is folded like a table; the stream's checkpoint makes each file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.paragraphs import paragraphs

SEGMENTS = "lecture_id string, seq int, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double"


def paragraph_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Folds segment files (Parquet) that appear under source and appends paragraphs to sink, a folder for each batch, so
    that a repeated batch overwrites itself."""

    def fold(batch: DataFrame, number: int) -> None:
        paragraphs(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
