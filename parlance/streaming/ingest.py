"""Incremental ingestion with Structured Streaming: new files, folds that grow, activity sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): new, changed, removed or kept files, by size and time of their last write."""
    both = found.alias("f").join(known.alias("k"), "path", "full_outer")
    state = (
        F.when(F.col("k.size").isNull(), "new").when(F.col("f.size").isNull(), "removed")
        .when((F.col("f.size") != F.col("k.size")) | (F.col("f.modified") != F.col("k.modified")), "changed").otherwise("kept")
    )
    return both.select("path", state.alias("state"))


def stream_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)


def running_counts(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts of a stream or table that grow with it: messages, assistant messages and characters."""
    return messages.groupBy(key).agg(F.count("*").alias("message_count"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.sum(F.length("text")).alias("chars"))


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: event-time sessions of each user, closed after a gap, late data up to a bound."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def write_sessions(stream: DataFrame, folder: str, checkpoint: str):
    """Writes each micro-batch's conversations under their batch number, so a retried batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The fold over all batches: sums of what each of them counted."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("conv_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("message_count", "assistant_messages", "chars")))
