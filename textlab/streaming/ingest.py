"""Structured Streaming over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _files(spark: SparkSession, path: str, schema: str, fmt: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def land_new_files(
    spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, fmt: str = "json", files_per_batch: int | None = None
) -> int:
    """Append the files that were not ingested before and stop; returns the rows added.

    The checkpoint remembers the files, so a rerun resumes and a crash repeats nothing.
    """
    stream = _files(spark, path, schema, fmt, files_per_batch)
    added = spark.sparkContext.accumulator(0)

    def append(batch: DataFrame, number: int) -> None:
        # One folder per batch: a batch that is repeated after a crash replaces itself.
        folder = f"{out.rstrip('/')}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        added.add(spark.read.parquet(folder).count())

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return added.value


def activity_stream(events: DataFrame, when: str, group: str, period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts per (period, group) on a stream; late rows beyond the watermark are left out."""
    return (
        events.withWatermark(when, lateness)
        .groupBy(F.window(when, period).alias("w"), group)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("period"), group, "n")
    )


def land_activity(
    spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, when: str, group: str, period: str = "1 day", lateness: str = "1 hour",
    fmt: str = "parquet", files_per_batch: int | None = None,
) -> None:
    """Count the files not read before per (period, group), append the periods that are over, and stop.

    A period is over when the latest time read, less ``lateness``, has passed its end; open
    periods wait as state in the checkpoint for the next run, and rows that come after their
    period was written are left out. Each batch is a folder of its own, which replaces itself if
    the batch is repeated after a crash.
    """
    counted = activity_stream(_files(spark, path, schema, fmt, files_per_batch), when, group, period, lateness)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    query = counted.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
