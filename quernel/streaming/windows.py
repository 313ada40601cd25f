"""Streaming extensions: windowed metrics with a watermark, and live summaries of logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.hooks import answer_lines
from quernel.streaming.state import log_snapshots


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean value of events by window and type; rows later than ``late`` are dropped on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def follow_log(spark: SparkSession, folder: str, checkpoint: str, report: Callable[[dict], None]):
    """Hand ``report`` a summary of all lines of the logs in ``folder`` so far, anew with each batch that brings losses.

    The folder is one log; its lines are in the order of batches, then files, then places. What is kept of it is a row
    of state (``state.log_snapshots``), so that a batch costs what it brings.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        for row in batch.collect():  # one row: the folder's
            report(row.asDict() | {"epoch": epoch})

    snapshots = log_snapshots(spark, folder, F.lit("")).drop("log")
    return snapshots.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve_requests(spark: SparkSession, folder: str, out: str, checkpoint: str, factory: Callable):
    """Answer request lines that arrive in ``folder`` (``hooks.answer_lines``) as lines of text files in ``out``."""
    answers = answer_lines(spark.readStream.text(folder), factory).select("response")
    return answers.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
