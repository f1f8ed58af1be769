"""Incremental scoring with Structured Streaming (an extension: batches of new records)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_events(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """C05 on a stream: one row a key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window of time and key; rows later than the watermark are left out."""
    over = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(over.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def append_scores(stream: DataFrame, score, target: str, checkpoint: str, doc: str = "doc_id"):
    """Scores each batch's new documents and appends them; a document that the target has is not scored again."""

    def run(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            fresh = batch.join(batch.sparkSession.read.parquet(target).select(doc).distinct(), doc, "left_anti")
        except AnalysisException:  # nothing written yet
            fresh = batch
        score(fresh).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
