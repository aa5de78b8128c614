"""Incremental ingest: a file stream whose batches are upserted once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.versions import Store
from tracemill.streaming.keyed import KeyedTable


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], buckets: int = 64):
    """Start a stream of JSON files into the keyed table rows of a store at target; read it by KeyedTable.

    A batch rewrites the buckets of its own keys; one that is run again after a failure changes nothing. Rows of a key follow each other by batch, then by
    time and name of their file, then by place in it.
    """
    table = KeyedTable(Store(spark, target), "rows", keys, buckets)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")

    def commit(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch.withColumn("seq", F.struct(F.lit(batch_id).alias("batch"), F.col("_place").alias("place"), F.monotonically_increasing_id().alias("row"))).drop("_place"), batch_id)

    rows = spark.readStream.schema(schema).json(source).select("*", place.alias("_place"))
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; on a stream, rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
