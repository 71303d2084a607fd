"""Partitions of tables over nodes: ids, pruning, scatter and gather, joins by placement, and cluster status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.functions.partition_ids import literal_id, partition_id
from tessela.operators.relational import hash_join

#: A side with fewer rows is broadcast.
BROADCAST_BELOW = 1000
#: A side of more rows is never broadcast, not even on demand.
BROADCAST_BOUND = 1_000_000
NODE_SCHEMA = "node_id string, host string, port int, is_active boolean, load_factor double"
PARTITION_SCHEMA = "partition_id string, table_name string, partition_key string, row_count long, size_mb double, node_id string"


@dataclass(frozen=True)
class Partitioning:
    key: str
    partitions: int = 4
    strategy: str = "hash"

    def assign(self, df: DataFrame, name: str = "partition") -> DataFrame:
        return df.withColumn(name, partition_id(F.col(self.key), self.partitions, self.strategy))

    def targets(self, predicate: Mapping[str, tuple[str, object]] | None = None) -> list[int]:
        """Ids that can hold matching rows: one for an equality on the key of a hash partitioning, else all."""
        operator, value = (predicate or {}).get(self.key, (None, None))
        if self.strategy == "hash" and operator == "=":
            return [literal_id(value, self.partitions, self.strategy)]
        return list(range(self.partitions))

    def scan(self, df: DataFrame, predicate: Mapping[str, tuple[str, object]] | None = None, condition: Column | str | None = None, name: str = "partition") -> DataFrame:
        """Rows of the target partitions only. Over a table that is laid out by the id column, Spark reads their folders only; over any other
        the ids are computed for the rows that are read. The condition itself, if given, reaches the files in both cases."""
        kept = df if condition is None else df.where(condition)
        laid_out = kept if name in df.columns else self.assign(kept, name)
        return laid_out.where(F.col(name).isin(self.targets(predicate)))

    def read(self, spark: SparkSession, path: str, predicate: Mapping[str, tuple[str, object]] | None = None, condition: Column | str | None = None, name: str = "partition") -> DataFrame:
        """Rows of the target partitions of a table that write() laid out."""
        return self.scan(spark.read.parquet(path), predicate, condition, name)

    def write(self, df: DataFrame, path: str, name: str = "partition") -> None:
        self.assign(df, name).repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)


@dataclass
class Cluster:
    """Metadata of nodes and partitions: small tables that never hold rows of data."""

    spark: SparkSession
    nodes: list[tuple] = field(default_factory=list)
    partitions: list[tuple] = field(default_factory=list)

    def add_node(self, node_id: str, host: str = "localhost", port: int = 5432, is_active: bool = True, load_factor: float = 0.0) -> None:
        self.nodes.append((node_id, host, port, is_active, load_factor))

    def register(self, partition: str, table: str, key: str, rows: int, size_mb: float, node_id: str) -> None:
        self.partitions.append((partition, table, key, rows, size_mb, node_id))

    def node_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def partition_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.partitions, PARTITION_SCHEMA)

    def target_partitions(self, table: str, ids: Sequence[int] | None = None) -> list[tuple]:
        """Registered partitions of a table whose names end in one of the ids; all where none does."""
        own = [p for p in self.partitions if p[1] == table]
        hit = [p for p in own if ids is not None and any(p[0].endswith(f"_{i}") for i in ids)]
        return hit or own

    def by_node(self, partitions: Sequence[tuple]) -> dict[str, list[str]]:
        """Partition names by active owner."""
        active = {n[0] for n in self.nodes if n[3]}
        out: dict[str, list[str]] = {}
        for p in partitions:
            if p[5] in active:
                out.setdefault(p[5], []).append(p[0])
        return out

    def colocated(self, left: str, right: str, key: str) -> bool:
        """Whether the first registered partitions of both tables are laid out by the key."""
        first = [next((p[2] for p in self.partitions if p[1] == t), None) for t in (left, right)]
        return first == [key, key]


def cluster_status(nodes: DataFrame, partitions: DataFrame) -> DataFrame:
    """Per node: whether it is active, its partitions, rows and megabytes; nodes without partitions have zeros."""
    held = partitions.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_partitions"), F.sum("row_count").alias("total_rows"), F.sum("size_mb").alias("total_mb"))
    return nodes.join(held, "node_id", "left").select(
        "node_id", "is_active",
        F.coalesce("n_partitions", F.lit(0)).alias("n_partitions"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"), F.coalesce("total_mb", F.lit(0.0)).alias("total_mb"),
    )


def table_rows(partitions: DataFrame, table: str) -> DataFrame:
    return partitions.where(F.col("table_name") == table).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"))


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts. A failing part fails the job; there are no partial results."""
    return reduce(DataFrame.unionByName, parts)


def colocated_join(left: DataFrame, right: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Equi-join of sides that share a layout; null keys don't match. Both sides are laid out by the key once, and tables that
    are bucketed by it are not shuffled at all."""
    if partitions:
        left, right = left.repartition(partitions, key), right.repartition(partitions, key)
    return hash_join(left, right, key, key, null_safe=False)


def broadcast_join(left: DataFrame, right: DataFrame, key: str, left_rows: int | None = None, right_rows: int | None = None, bound: int = BROADCAST_BOUND) -> DataFrame:
    """The smaller side is sent to all tasks; of equal sides it is the right one. A side without a given count is counted, up to the
    bound; if both sides are larger than that, ValueError."""
    left_rows = left.limit(bound + 1).count() if left_rows is None else left_rows
    right_rows = right.limit(bound + 1).count() if right_rows is None else right_rows
    if min(left_rows, right_rows) > bound:
        raise ValueError(f"both sides have more than {bound} rows")
    if left_rows < right_rows:
        return hash_join(left.hint("broadcast"), right, key, key, null_safe=True)
    return hash_join(left, right, key, key, null_safe=True, hint="broadcast")


def shuffle_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides are redistributed by the key's hash; null keys match."""
    return hash_join(left, right, key, key, null_safe=True, hint="shuffle_hash")


def distributed_join(
    left: DataFrame, right: DataFrame, key: str, join_type: str = "inner", colocated: bool = False, left_rows: int | None = None, right_rows: int | None = None, below: int = BROADCAST_BELOW
) -> tuple[DataFrame, str]:
    """The join and the strategy taken: colocated, broadcast (a side of fewer than ``below`` rows, counted up to that bound
    only where no count is given) or shuffle. Other join types raise ValueError."""
    if join_type != "inner":
        raise ValueError(f"only inner joins are distributed, not {join_type}")
    if colocated:
        return colocated_join(left, right, key), "colocated"
    left_rows = left.limit(below).count() if left_rows is None else left_rows
    right_rows = right.limit(below).count() if right_rows is None else right_rows
    if min(left_rows, right_rows) < below:
        return broadcast_join(left, right, key, left_rows, right_rows), "broadcast"
    return shuffle_join(left, right, key), "shuffle"
