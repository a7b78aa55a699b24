"""Queries of the streaming extension: the folder of events as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as st
from .registry import ORACLES, QUERIES


def _stream(spark, sf_dir: str):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return st.read_events(spark, f"{sf_dir}/events.parquet*", schema)


def stream_window_counts(spark, sf_dir):
    table = st.run_to_table(st.window_counts(_stream(spark, sf_dir)))
    return table.select(F.to_date("start").alias("day"), "event_type", "n", "total")


def stream_session_funnel(spark, sf_dir):
    return st.run_to_table(st.session_funnel(_stream(spark, sf_dir)))


QUERIES["ext_stream_window_counts"] = stream_window_counts
ORACLES["ext_stream_window_counts"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"
QUERIES["ext_stream_session_funnel"] = stream_session_funnel
ORACLES["ext_stream_session_funnel"] = """SELECT user_id, count(*) AS n_events, max(CAST(event_type = 'view' AS INT)) AS viewed, max(CAST(event_type = 'click' AS INT)) AS clicked,
max(CAST(event_type = 'purchase' AS INT)) AS bought FROM events GROUP BY 1"""
