"""Streams of run events: loop detection with keyed state, deduplication within a watermark, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.plans.tables import shared_folder

LOOP_SCHEMA = "user_id long, event_id long, streak long, level string"


def detect_loops(events: DataFrame, warn: int = 3, stop: int = 5) -> DataFrame:
    """(user_id, event_id, streak, level): equal event types in a row for each user; the state is the last type and its streak.

    Within a batch events are taken in order of (ts, event_id); a later batch goes on from the state.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        streaks = []
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == last else 1
            last = kind
            streaks.append(streak)
        state.update((last, streak))
        level = ["stop" if s >= stop else "warn" if s >= warn else "ok" for s in streaks]
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "streak": streaks, "level": level})

    return events.groupBy("user_id").applyInPandasWithState(work, LOOP_SCHEMA, "last string, streak long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once for each id, the state bounded by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) of tumbling or sliding windows."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = e.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that a pause ends."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def counters(events: DataFrame) -> DataFrame:
    """Running successes and attempts of each user, for weights that follow the stream."""
    return events.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "purchase").alias("successes"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream over present data gives, as a Parquet table beside its checkpoint in the shared folder."""
    spark = stream.sparkSession
    base = shared_folder(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    else:  # each batch holds the whole result
        spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows")
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
