"""Keeps running summaries of the execution log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessela.sources.catalogs import LOG_SCHEMA


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).parquet(path)


def runtime_by_plan(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs, average runtime and average error of the cost per plan type and window; later rows than ``late`` are dropped."""
    timed = stream.withColumn("at", F.col("executed_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "plan_type").agg(F.count(F.lit(1)).alias("runs"), F.avg("actual_runtime_ms").alias("avg_runtime_ms"), F.avg("estimated_cost").alias("avg_cost"))


def start(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a Parquet table; runs over what is there and stops."""
    return summary.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
