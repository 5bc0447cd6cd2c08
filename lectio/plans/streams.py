"""Streaming queries, with the batch SQL that they have to agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectio.plans.registry import ORACLE_SQL, rows_only
from lectio.streaming import events


@rows_only
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.deduplicated(events.read(spark, sf_dir), ["user_id", "event_type"]), "append")


@rows_only
def stream_due_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.states(events.read(spark, sf_dir)), "complete")


@rows_only
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.windows(events.read(spark, sf_dir)), "complete")


ORACLE_SQL["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"
ORACLE_SQL["stream_due_state"] = "SELECT user_id AS source_id, event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place = 1"
ORACLE_SQL["stream_event_windows"] = "SELECT epoch_us(date_trunc('hour', ts)) AS begins, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2"
