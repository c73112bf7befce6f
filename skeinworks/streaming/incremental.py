"""Streaming extension: new parquet files profiled and counted as they arrive.

The batch operators need no stream; this shows the same tables kept up to
date. Late rows are handled by a watermark, results go to a table per run.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, table


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = table(spark, sf_dir, name).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until what is there now is read; its rows as a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows and value sums per tumbling window and kind; a window is final when the watermark has passed it."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of events by type that the stream has closed."""
    return drained(windowed_counts(arriving(spark, sf_dir, "events"), "ts", "event_type")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-name parts of arriving images: a stateless projection."""
    from ..functions.text import name_parts

    return drained(arriving(spark, sf_dir, "sted_images").select("relative_path", name_parts(F.col("relative_path")).getField("parse_status").alias("parse_status"))).groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"stream_window_counts": stream_window_counts, "stream_names": stream_names}
SQL = {
    "stream_window_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL",
    "stream_names": r"SELECT CASE WHEN regexp_matches(relative_path, '(?i)^(.*/)?[^/]+? \(Series \d+\) \[\d+\]\.tif$') THEN 'parsed' ELSE 'unparsed' END AS parse_status, count(*) AS n FROM sted_images GROUP BY 1",
}
