"""Session-level helpers shared by all operators: checkpoints, table reading, bounds on broadcasts."""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

_SCHEMAS: dict[tuple, StructType] = {}
#: A side is broadcast by hand only when it has at most this many rows.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is looked up in its files once a session."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder that the session names in spark.checkpoint.dir. Where none is named, a local session gets a temporary one; on a
    cluster, whose machines share no such folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessela-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The table written to the shared checkpoint folder and read from there, for the steps of an iteration.

    A checkpointed table keeps the optimizer's estimate of its size, which joins multiply: from step to step it squares until
    planning stands still. A written table has the size of its files. ``instead_of`` is an earlier written table that
    nothing refers to any more; its files are removed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if instead_of is not None:
        discard(instead_of)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Removes the files of a written table that nothing refers to any more."""
    _delete(table.sparkSession, table.written_path)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files whose tables are no longer referred to, after a large step; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean_up(spark: SparkSession) -> None:
    """Removes this session's checkpoints and written tables, once its results have been read or stored."""
    if spark.sparkContext.getCheckpointDir():
        _delete(spark, spark.sparkContext.getCheckpointDir())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for a layout or an index of this session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, build: Callable[[], T]) -> T:
    """What build() gives, made once a session: layouts, indexes and statistics are made when data are loaded, not when they are queried."""
    full = (spark.sparkContext.applicationId, spark.sparkContext.getCheckpointDir(), *key)
    if full not in _KEPT:
        _KEPT[full] = build()
    return _KEPT[full]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a counted bound proves the side small; else leave the choice to the shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value of bounded size, its classes by value; unpack() opens it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpack(shipped: Broadcast) -> object:
    return pickle.loads(shipped.value)
