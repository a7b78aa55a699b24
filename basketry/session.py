"""Session factory with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "basketry", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; a cluster's own settings win where none are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.maxPlanStringLength": "8192",
    }
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
