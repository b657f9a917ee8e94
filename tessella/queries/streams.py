"""Queries of the streams, run to the end over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.queries import query, table
from tessella.queries.ranking import LOOP
from tessella.streaming import runs as S


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of one file."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def ended(df: DataFrame, mode: str = "append") -> DataFrame:
    return S.run_to_end(df, f"s_{uuid.uuid4().hex}", mode)


@query(LOOP)
def st1_loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(S.detect_loops(stream(spark, sf_dir))).select("event_id", "streak", "level")


@query("SELECT event_id, event_type FROM events")
def st2_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(S.deduplicated(stream(spark, sf_dir))).select("event_id", "event_type")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def st3_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(S.windowed(stream(spark, sf_dir), "1 hour"), "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(S.sessions(stream(spark, sf_dir), "30 minutes"), "complete").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'purchase') AS successes FROM events GROUP BY 1")
def st5_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended(S.counters(stream(spark, sf_dir)), "complete")
