"""Polling for new messages as a stream: whatever has arrived is processed once, then the query ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.operators.correspondents import capped


def poll(spark: SparkSession, path: str, schema: StructType, checkpoint: str, sink: Callable[[DataFrame, int], None], fmt: str = "json") -> None:
    """Hand each batch of unseen files under ``path`` to ``sink``; where it left off is kept in ``checkpoint``."""
    rows = spark.readStream.schema(schema).format(fmt).load(path)
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_last(current: DataFrame, update: DataFrame, key: str, seq: str) -> DataFrame:
    """A table after a batch: the row with the greatest seq of each key."""
    every = current.unionByName(update)
    return every.groupBy(key).agg(F.max_by(F.struct(*every.columns), seq).alias("v")).select("v.*")


def upsert_events(current: DataFrame, update: DataFrame, cap: int = 500) -> DataFrame:
    """The graph's events after a batch: of each address and direction the last ``cap``; a line that comes again counts once."""
    return capped(current.unionByName(update).dropDuplicates(["email", "direction", "seq"]), cap)


def daily_counts(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Messages of each sender and day, on a stream with a watermark or on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 day").alias("w"), "email").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "email", "n")
