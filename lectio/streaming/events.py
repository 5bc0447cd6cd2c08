"""Event streams: deduplication, the latest state of each source, and counts by window.

Each stream is read from files as they arrive; availableNow drains what is there and ends. State and offsets are checkpointed
in a folder that the caller names, so a query that is started again goes on where it was; without a name it is a run of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def deduplicated(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """The keys of events, once each within the time that late ones may take; older state is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def states(events: DataFrame) -> DataFrame:
    """The latest event of each source."""
    latest = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(latest.alias("last"), F.count(F.lit(1)).alias("n")).select(F.col("user_id").alias("source_id"), F.col("last.event_type").alias("event_type"), F.col("last.event_id").alias("event_id"), "n")


def windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type and window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return out.select(F.unix_micros("window.start").alias("begins"), "event_type", "n", "mean_value")


def drain(stream: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """What a stream yields until its sources are at their end: appended rows, or the complete result of the last batch. State, offsets and rows lie in `base`: a later call with the same folder reads on from the last one's end."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/rows")
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
