"""Event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.shared_storage import scratch_path
from plumbline.sources.tables import table


def issue_rates(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream ``events`` in order of time until none is left; windows are written when the watermark passes them."""
    source, out = scratch_path(spark, "event-log"), scratch_path(spark, "issue-rates")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    rows.repartitionByRange(4, "at").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = issue_rates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "issue-progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(out)
