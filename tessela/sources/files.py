"""Tables from and to files, and configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import fields, replace
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessela.plans.cost import CostConfig
from tessela.plans.planner import PlannerConfig

READABLE = ("parquet", "orc", "json", "csv")


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table by its path's suffix; a path without one is a folder of Parquet files. Pickles are refused: they run code."""
    kind = Path(path).suffix.lstrip(".") or "parquet"
    if kind not in READABLE:
        raise ValueError(f"unsupported file type: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def insert_rows(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType | str, path: str) -> int:
    """Append rows (dicts; arrays of numpy become lists) to a Parquet table. No rows: nothing is written. Returns their number."""
    if not rows:
        return 0
    plain = [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows]
    spark.createDataFrame(plain, schema).write.mode("append").parquet(path)
    return len(plain)


def export(df: DataFrame, folder: str, embedding: str | None = "embedding") -> None:
    """The table as Parquet, and as CSV without its vectors."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    flat = df.drop(embedding) if embedding else df
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_report(results: Sequence[Mapping], folder: str, name: str = "benchmark") -> tuple[str, str]:
    """Benchmark results as one JSON and one CSV file with the time in their names."""
    import csv

    at = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    Path(folder).mkdir(parents=True, exist_ok=True)
    as_json, as_csv = f"{folder}/{name}_{at}.json", f"{folder}/{name}_{at}.csv"
    Path(as_json).write_text(json.dumps(list(results), indent=1, default=str))
    columns = list(dict.fromkeys(k for r in results for k in r))
    with open(as_csv, "w", newline="") as f:
        writer = csv.DictWriter(f, columns)
        writer.writeheader()
        writer.writerows(results)
    return as_json, as_csv


def planner_config(settings: Mapping | str | None = None) -> PlannerConfig:
    """A planner's configuration from a mapping or a JSON file with sections ``cost_model`` and ``optimizer``; unknown
    keys are ignored and missing ones keep their defaults."""
    given = json.loads(Path(settings).read_text()) if isinstance(settings, str) else dict(settings or {})
    names = {f.name for f in fields(CostConfig)}
    cost = replace(CostConfig(), **{k: float(v) for k, v in given.get("cost_model", {}).items() if k in names})
    names = {f.name for f in fields(PlannerConfig)} - {"cost"}
    return replace(PlannerConfig(cost=cost), **{k: v for k, v in given.get("optimizer", {}).items() if k in names})


def partition_by_year(df: DataFrame, timestamp: str, path: str) -> None:
    """Laid out by year, so that a range of dates reads its years only."""
    from pyspark.sql import functions as F

    df.withColumn("year", F.year(timestamp)).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)
