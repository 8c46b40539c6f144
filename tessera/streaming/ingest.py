"""Streaming ingestion into partition sets, with the batch routing expressions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.manager import PartitionManager
from ..sources.store import Store, work_dir


def take(manager: PartitionManager, parent: str, batch: DataFrame, query: str, number: int, maintain: bool = True) -> bool:
    """Route one micro-batch into a set, once: a batch of the same query and number is known by its mark in the job log and skipped."""
    if batch.isEmpty() or not manager.insert(parent, batch, f"stream-{parent}-{query}-{number}"):
        return False
    if maintain:
        manager.run_maintenance(parent)
    return True


def ingest(manager: PartitionManager, parent: str, stream: DataFrame, checkpoint: str, maintain: bool = True, **trigger):
    """Start a query that routes each micro-batch into a set; maintenance follows, so children stay ahead of the data.

    A batch that is run again after a failure is skipped. Batches are told apart by
    the id that Spark keeps in the checkpoint, so streams with checkpoints of their own don't meet.
    """
    store = Store(manager.spark, checkpoint)

    def run(batch: DataFrame, number: int) -> None:
        take(manager, parent, batch, json.loads(store.read("metadata"))["id"], number, maintain)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def ingest_files(manager: PartitionManager, parent: str, folder: str, pattern: str, schema: T.StructType) -> None:
    """Ingest the files that are there and stop."""
    checkpoint = f"{manager.root}/checkpoints/{uuid.uuid4().hex}"
    ingest(manager, parent, file_stream(manager.spark, folder, pattern, schema), checkpoint, maintain=False).awaitTermination()


def windowed_counts(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, interval: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows of each tumbling window of a file stream, whole once the stream has ended; written to the shared folder."""
    path = f"{work_dir(spark)}/windows-{uuid.uuid4().hex}"
    stream = file_stream(spark, folder, pattern, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"))

    def take(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("child_start_time"), "n_rows", F.lit(number).alias("batch")).write.mode("append").parquet(f"{path}/out")

    counts.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # A window's last update holds.
    return spark.read.parquet(f"{path}/out").groupBy("child_start_time").agg(F.max_by("n_rows", "batch").alias("n_rows"))
