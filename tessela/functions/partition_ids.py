"""Partition ids of keys: hash, range and list."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("hash", "range", "list")


def hash_id(key: Column, partitions: int) -> Column:
    """md5 of the key's text as a 128-bit number, modulo partitions. A null key has null."""
    digest = F.md5(key.cast("string").cast("binary"))
    base = (1 << 32) % partitions
    chunks = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % partitions for i in range(4)]
    return reduce(lambda high, low: (high * base + low) % partitions, chunks).cast("int")


def range_id(key: Column, partitions: int) -> Column:
    return F.pmod(key.cast("long"), F.lit(partitions)).cast("int")


def partition_id(key: Column, partitions: int = 4, strategy: str = "hash") -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown partition strategy: {strategy}")
    return {"hash": hash_id, "range": range_id, "list": lambda *_: F.lit(0)}[strategy](key, partitions)


def literal_id(key: object, partitions: int = 4, strategy: str = "hash") -> int:
    """The id of one key on the driver, for pruning; equal to partition_id of an int or string column."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown partition strategy: {strategy}")
    if strategy == "hash":
        return int(hashlib.md5(str(key).encode()).hexdigest(), 16) % partitions
    return int(key) % partitions if strategy == "range" else 0
