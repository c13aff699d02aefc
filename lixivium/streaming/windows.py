"""Streams: event-time windows, sessions, duplicates, joins and custom state, each run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lixivium.session import new_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, late: str = "1 hour", marker: str | None = None) -> DataFrame:
    """The events as a stream with event time and a watermark; a marker row of completed may end it."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    if marker is not None:
        rows = rows.unionByName(spark.readStream.schema(EVENTS).parquet(marker))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drained(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """What the stream gives until its sources are exhausted, added to what it gave before.

    base is the folder of its output and checkpoint: called again with the same base, it goes on where it stopped. Without one
    a new folder of the shared folder is taken. In append mode windows and sessions that end after the last watermark stay
    open in the checkpoint, as the stream might go on; completed closes them.
    """
    spark = stream.sparkSession
    base = base or new_path(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def completed(spark: SparkSession, build: Callable[[str], DataFrame], name: str, base: str | None = None) -> DataFrame:
    """All that a finite stream gives, its last windows and sessions included.

    build makes the stream from a marker folder (see events). The stream is drained; then a row far in the future is put into
    the folder and the stream goes on from its checkpoint, so that the watermark passes all that is still open. Events that
    come after that are too late.
    """
    base = base or new_path(spark, f"stream-{name}")
    marker = f"{base}/marker"
    empty = spark.createDataFrame([], EVENTS)
    empty.write.mode("ignore").parquet(marker)
    drained(build(marker), name, base=base)
    spark.sql("select null as event_id, timestamp_ntz'9999-01-01 00:00:00' as ts, null as user_id, null as event_type, null as value, null as props").select(*[F.col(f.name).cast(f.dataType) for f in empty.schema]).coalesce(1).write.mode("append").parquet(marker)
    return drained(build(marker), name, base=base)


def counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows: events and their total per type; a window comes out when the watermark has passed it."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def purchases_after_views(stream: DataFrame, other: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join: purchases of a user at most so long after a view; both sides' state is bounded by the watermark."""
    v = stream.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    p = other.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), "ts")
    return v.join(p, F.expr(f"u = user_id and ts > view_ts and ts <= view_ts + interval {within}")).select("user_id", "view_id", "purchase_id")


def running_best(stream: DataFrame) -> DataFrame:
    """user_id, n, best of each user after each batch of its events, with state of two numbers a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, float("-inf"))
        for batch in batches:
            n, best = n + len(batch), max(best, float(batch["value"].max()))
        state.update((n, best))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, best double", "n bigint, best double", "append", GroupStateTimeout.NoTimeout)
