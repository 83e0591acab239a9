"""The log queries as streams: trailing usage, last state of each session, a spend guard."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketlake.plans.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; event time as a timestamp with zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, late: str = "2 hours", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """(window, event_type, requests, units) over sliding windows; events later than `late` are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type")
        .agg(F.count("*").alias("requests"), F.sum("value").alias("units"))
        .select(F.col("window.start").alias("window_start"), "event_type", "requests", "units")
    )


def session_states(events: DataFrame) -> DataFrame:
    """(user_id, n_events, last_kind, last_ts), updated as events come: the last write wins."""
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"), F.max("ts").alias("last_ts"))


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events once each, although a log is read again from its start: state is kept as long as an event can be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has given once it has read all there is: the rows of its last state, in a table of that name.

    The sink keeps results on the driver, so this is for results that are small, such as counts by hour.
    """
    ensure_checkpoint_dir(stream.sparkSession)
    run = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{stream.sparkSession.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def guard(events: DataFrame, prices: dict[str, float], cap: float, stop: Callable[[float], None], checkpoint: str) -> StreamingQuery:
    """Adds up spend batch by batch and calls `stop` once the cap is passed. Totals are one row a batch."""
    total = {"spent": 0.0}

    def batch(df: DataFrame, _: int) -> None:
        price = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
        got = df.agg(F.sum(F.col("value") * F.coalesce(F.try_element_at(price, F.col("event_type")), F.lit(0.0))).alias("s")).first().s
        total["spent"] += got or 0.0
        if total["spent"] > cap:
            stop(total["spent"])

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
