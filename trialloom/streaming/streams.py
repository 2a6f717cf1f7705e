"""Streams: windowed counts with late data, idempotent upserts, the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.operators.relational import latest_wins


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    # A pattern that only this path matches: the source takes folders and patterns, no single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Number of events per window and key, for an append or update sink.

    The state of a window ends once the newest event of the batches before is
    ``late`` behind its end; events of a window that ended are dropped. In complete mode the
    watermark would act on nothing and the state would never end.
    """
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "n")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything there is, written to a Parquet folder; what was written before isn't written again."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(sink)


def counted_windows(events: DataFrame, sink: str, checkpoint: str, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, keys, n) of all windows so far: each batch appends the counts it changed, the last one of a window holds.

    Every batch's changed counts go to files, under the batch's number, so a batch
    that runs twice changes nothing. Nothing is gathered on the driver.
    """
    counts = windowed_counts(events, time, keys, window, late)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stored = events.sparkSession.read.parquet(sink)
    return latest_wins(stored, ["window_start", *keys], [F.col("batch")]).drop("batch", "n_duplicates")


def upsert_stream(stream: DataFrame, sink: str, checkpoint: str, key: str, order: list[str]) -> DataFrame:
    """The last row per key, kept by batches.

    Each batch is compacted and written under its own number, replacing what an
    interrupted attempt left there; reading takes the last row per key over all
    batches. So a batch that runs twice changes nothing, and none reads the whole
    store.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = latest_wins(batch, [key], [F.col(c) for c in order]).drop("n_duplicates")
        last.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    stored = stream.sparkSession.read.parquet(sink).drop("batch")
    return latest_wins(stored, [key], [F.col(c) for c in order]).drop("n_duplicates")
