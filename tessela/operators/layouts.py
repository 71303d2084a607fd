"""Layouts that stand in for indexes: buckets for joins without a shuffle, sorted files for ranges, posting lists for array members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table under the name, bucketed and sorted by the key; tables of equal buckets join on it without an exchange."""
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_sorted(df: DataFrame, path: str, columns: Sequence[str], files: int = 8) -> None:
    """Files sorted by the columns, as a composite index orders them: a predicate on the first ones skips files and row groups by their
    least and greatest values."""
    df.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def write_postings(df: DataFrame, path: str, id_column: str, array_column: str, files: int = 8) -> None:
    """(value, id) for every different member of an array column, sorted by value: finding the rows that hold a value reads that value's
    stretch of the files, as an inverted index does."""
    rows = df.select(F.explode(F.array_distinct(array_column)).alias("value"), F.col(id_column).alias("id")).where("value IS NOT NULL AND id IS NOT NULL").distinct()
    write_sorted(rows, path, ["value", "id"], files)


def holding(spark: SparkSession, path: str, values: Sequence, every: bool = True) -> DataFrame:
    """(id): the rows whose array holds every one of the values, or any of them."""
    wanted = list(dict.fromkeys(values))
    found = spark.read.parquet(path).where(F.col("value").isin(wanted))
    if not every:
        return found.select("id").distinct()
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")
