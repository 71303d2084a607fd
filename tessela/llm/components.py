"""Guarded connected components: things joined by shared keys, cut apart again where what they state contradicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.runtime import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges(node, key), nodes that share a key are joined -> (node, component), component being the smallest node of it.

    Each round takes the smallest label over every key and then follows labels to their labels, so labels travel twice as far from round
    to round. A key of very many nodes is two aggregates, never a list of pairs. Superseded tables are removed."""
    edges = written(edges.select("node", "key").distinct())
    label = written(edges.select("node", F.col("node").alias("component")).distinct())
    while True:
        least = edges.join(label, "node").groupBy("key").agg(F.min("component").alias("least"))
        near = edges.join(least, "key").groupBy("node").agg(F.min("least").alias("near"))
        hop = label.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = label.join(near, "node").join(hop, "near").select("node", F.least("component", "near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved"))
        label = written(after, label)
        if not label.where("moved").limit(1).count():
            discard(edges)
            return label.select("node", "component")


def guarded_components(edges: DataFrame, stated: DataFrame) -> DataFrame:
    """edges(node, key, support), stated(node, kind, value) -> (node, component) of the nodes whose component holds no contradiction.

    A component in which one kind has two values is cut at its weakest edges: those with a support of at most 1, then 2, 4, ..., until
    nothing in it contradicts. The number of rounds is the logarithm of the greatest support."""
    left, bar = written(edges.groupBy("node", "key").agg(F.sum("support").alias("support"))), 1
    while True:
        found = written(components(left))
        clash = found.join(stated, "node").groupBy("component", "kind").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low != high")
        bad = written(clash.select("component").distinct().join(found, "component").select("node"))
        if not bad.limit(1).count():
            return found
        weak = left.join(bad.withColumn("bad", F.lit(True)), "node", "left")
        kept = weak.where(F.col("bad").isNull() | (F.col("support") > bar)).select("node", "key", "support")
        discard(found)
        left, bar = written(kept, left), bar * 2
