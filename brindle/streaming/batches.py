"""Structured Streaming: resumable batches of files (parity), windows over event time (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_batches(spark: SparkSession, source: str, schema: str, checkpoint: str, process: Callable[[DataFrame, int], None], batch_size: int = 1000, fmt: str = "parquet") -> int:
    """Takes the files that no earlier run has finished, ``batch_size`` at a time, and returns how many batches ran.

    Progress is kept only after ``process`` returned; a batch that failed is given again, with the same number, by
    the next run, so ``process`` should overwrite by batch number.
    """
    done = []

    def one(df: DataFrame, number: int) -> None:
        process(df, number)
        done.append(number)

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", batch_size).load(source)
    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` behind the newest are left out by a stream."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(time, late) if events.isStreaming else events
    return out.groupBy(F.session_window(F.col(time), gap).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def first_only(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of the same keys within the watermark dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
