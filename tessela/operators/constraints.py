"""Declared constraints as queries that return the rows which break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, n) of values that stand more than once; nulls differ from each other, as in SQL."""
    known = df.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def broken_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def broken_check(df: DataFrame, check: Column | str) -> DataFrame:
    """Rows for which the check is false; an unknown one passes, as in SQL."""
    condition = F.expr(check) if isinstance(check, str) else check
    return df.where(~F.coalesce(condition, F.lit(True)))


def broken_reference(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference isn't null and not among the parent's keys."""
    keys = parent.select(F.col(key).alias("__key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")


def cascade_delete(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that stay when the given parents go."""
    keys = deleted.select(F.col(key).alias("__key")).distinct()
    return child.join(keys, F.col(column) == F.col("__key"), "left_anti")
