"""Registry of vector indexes, statistics of indexes, and the execution log that feeds learned estimates."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What an index definition leaves open.
DEFAULTS = {"hnsw": {"m": 16, "ef_construction": 64}, "ivfflat": {"lists": 100}}
LOG_SCHEMA = "query_hash string, query_text string, plan_type string, estimated_cost decimal(12,3), actual_runtime_ms decimal(10,3), rows_returned int, executed_at timestamp_ntz"
STATISTICS_SCHEMA = "table_name string, index_name string, index_type string, num_rows int, num_distinct_values int, avg_row_size int, index_size_bytes long, avg_search_time_ms decimal(10,3), updated_at timestamp_ntz"


class IndexRegistry:
    """Vector indexes by table and column, kept as JSON."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.entries: dict[str, dict] = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}

    def register(self, table: str, column: str, kind: str, definition: str = "", **parameters: int) -> dict:
        """definition may hold ``name = number`` settings, as index definitions write them."""
        if kind not in DEFAULTS:
            raise ValueError(f"unknown index type: {kind}")
        written = {k: int(v) for k, v in re.findall(r"(\w+)\s*=\s*'?(\d+)'?", definition)}
        entry = {"index_type": kind, **{k: written.get(k, parameters.get(k, v)) for k, v in DEFAULTS[kind].items()}}
        self.entries[f"{table}.{column}"] = entry
        if self.path:
            Path(self.path).write_text(json.dumps(self.entries, indent=1))
        return entry

    def stats(self, table: str, column: str) -> dict:
        """The entry of a column's index; empty where it has none."""
        return dict(self.entries.get(f"{table}.{column}", {}))


def append_log(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    if rows:
        spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def append_statistics(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    if rows:
        spark.createDataFrame(rows, STATISTICS_SCHEMA).write.mode("append").parquet(path)


def latest_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every index."""
    log = spark.read.schema(STATISTICS_SCHEMA).parquet(path)
    others = [c for c in log.columns if c not in ("table_name", "index_name")]
    return log.groupBy("table_name", "index_name").agg(F.max_by(F.struct(*others), "updated_at").alias("x")).select("table_name", "index_name", "x.*")


def observed_selectivities(log: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_hash, table_row_count, ...), one row a query -> the same with ``actual``, the mean share of the table's rows that its logged runs
    returned; queries that never ran are left out."""
    seen = log.groupBy("query_hash").agg(F.avg("rows_returned").alias("returned"))
    return queries.join(seen, "query_hash").withColumn("actual", F.col("returned") / F.greatest(F.col("table_row_count"), F.lit(1))).drop("returned")
