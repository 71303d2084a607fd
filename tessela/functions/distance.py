"""Vector distances as JVM-side column expressions, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")


def vector(values: Sequence[float]) -> Column:
    """A query vector as a literal array<double>, made in one call."""
    texts = ["double('NaN')" if v != v else f"double('{v}')" if math.isinf(v) else f"{v!r}D" for v in map(float, values)]
    return F.expr(f"array({', '.join(texts)})" if texts else "cast(array() AS array<double>)")


def checked(embedding: Column, dimension: int) -> Column:
    """The embedding as doubles; null stays null, another length raises (zip_with would pad it silently)."""
    fits = F.assert_true(F.size(embedding) == dimension, F.concat(F.lit(f"vector of length {dimension} expected, found "), F.size(embedding).cast("string")))
    return F.when(embedding.isNull(), F.lit(None)).when(fits.isNull(), embedding.cast("array<double>"))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(embedding: Column, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance to a fixed vector; smaller is nearer.

    cosine: 1 - cos, NaN where either vector is all zero. l2: Euclidean. inner_product: the negative product.
    A null embedding gives null; another metric raises ValueError.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric: {metric}")
    a, q = checked(embedding, len(query)), vector(query)
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(a, q, lambda x, y: (x - y) * (x - y))))
    if metric == "inner_product":
        return -dot(a, q)
    length = math.sqrt(sum(float(v) * float(v) for v in query))
    # One pass for the product and the norm: a pair of sums is carried along.
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
    both = F.aggregate(
        F.zip_with(a, q, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        start,
        lambda s, v: F.struct((s["p"] + v["x"] * v["y"]).alias("p"), (s["n"] + v["x"] * v["x"]).alias("n")),
        lambda s: F.when((s["n"] == 0) | F.lit(length == 0), F.lit(float("nan"))).otherwise(1 - s["p"] / (F.sqrt(F.greatest(s["n"], F.lit(5e-324))) * F.lit(length or 1.0))),
    )
    return both


def between(a: Column, b: Column, metric: str = "cosine") -> Column:
    """The same distances between two columns of equally long arrays of doubles."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric: {metric}")
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "inner_product":
        return -_sum(F.zip_with(a, b, lambda x, y: x * y))
    lengths = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(1 - _sum(F.zip_with(a, b, lambda x, y: x * y)) / F.greatest(lengths, F.lit(5e-324)))
