"""Structured Streaming over the session log: an extension beyond the batch operators.

The same aggregations run over an append-only folder of event files: tumbling windows with a
watermark, and the funnel of each session as its events arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, or of the files that a pattern matches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` of event-time windows; events later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_funnel(events: DataFrame) -> DataFrame:
    """``user_id, n_events, viewed, clicked, bought`` as state by user: counts only, whatever the length of the stream."""
    did = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), did("view").alias("viewed"), did("click").alias("clicked"), did("purchase").alias("bought"))


def run_to_table(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Process what is there and stop; the full result as a written table, replaced batch by batch."""
    spark = stream.sparkSession
    out = out or shared_dir(spark)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    job = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")
