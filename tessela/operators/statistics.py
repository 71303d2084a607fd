"""Table statistics for the planner, in one aggregate job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.plans.ir import TableStats


def _countable(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))]


def column_statistics(df: DataFrame, columns: Iterable[str] | None = None, approximate: bool = True, error: float = 0.02) -> DataFrame:
    """(column, n_rows, n_distinct, null_frac), one row a column, from a single scan."""
    names = [c for c in (columns or _countable(df)) if c in df.columns]
    distinct = (lambda c: F.approx_count_distinct(c, error)) if approximate else F.count_distinct
    out = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        out += [distinct(F.col(f"`{c}`")).alias(f"d{i}"), F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("double")), F.lit(0.0)).alias(f"z{i}")]
    one = df.agg(*out)
    stacked = [F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"z{i}").alias("null_frac")) for i, c in enumerate(names)]
    return one.select(F.explode(F.array(*stacked)).alias("s")).select("s.*")


def table_statistics(df: DataFrame, columns: Iterable[str] | None = None, size_bytes: int | None = None, indexed: Iterable[str] = (), approximate: bool = True) -> TableStats:
    """Statistics as the planner takes them; at most one row a column reaches the driver. size_bytes: the files' size, else the
    optimizer's estimate. A composite index, named "a, b", counts for each of its columns."""
    rows = column_statistics(df, columns, approximate).collect()
    n = rows[0]["n_rows"] if rows else df.count()
    size = size_bytes if size_bytes is not None else int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    single = frozenset(part.strip() for name in indexed for part in name.split(","))
    return TableStats(
        n_tuples=n,
        avg_tuple_size=max(1, size // n) if n else 200,
        table_size_bytes=size,
        distinct={r["column"]: r["n_distinct"] for r in rows if r["n_distinct"] > 0},
        null_frac={r["column"]: r["null_frac"] for r in rows},
        indexed_columns=single,
    )


def verification_counts(df: DataFrame, embedding: str) -> DataFrame:
    """(total, embedded): rows, and rows with an embedding."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(embedding).isNotNull(), 1)).alias("embedded"))
