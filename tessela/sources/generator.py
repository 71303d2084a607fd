"""Synthetic products for tests and demonstrations: the same rows for the same seed, in any number and any partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRANDS = ("Alderon", "Brightmoor", "Cindral", "Dovetree", "Eskine", "Fernhall", "Glasswick", "Harrowby", "Inverlea", "Juniper Row", "Kestrelle", "Lowmarsh", "Merriden")
CATEGORIES = ("Lamps", "Kettles", "Backpacks", "Projectors", "Desks", "Bicycles", "Clocks", "Radios", "Blenders")


def uniform(key: Column | str, salt: Column | str, seed: int) -> Column:
    """A number in (0, 1) from the first eight hexadecimal digits of the md5 of seed, key and salt."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string") if isinstance(key, Column) else F.col(key).cast("string"), salt if isinstance(salt, Column) else F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def _normal(key: Column | str, salt: Column | str, seed: int) -> Column:
    more = F.concat(salt if isinstance(salt, Column) else F.lit(salt), F.lit("'"))
    return F.sqrt(-2 * F.log(uniform(key, salt, seed))) * F.cos(uniform(key, more, seed) * F.lit(2 * math.pi))


def products(spark: SparkSession, n: int = 5_000, dimension: int = 384, seed: int = 42) -> DataFrame:
    """id, name, brand, category, price (log-normal), rating (beta, of 5), num_reviews, in_stock (9 of 10), description, embedding (of length 1).

    Everything is a column expression over the id and the seed. The rating's beta(8, 2) is the second largest of nine uniform numbers."""

    def pick(values: tuple[str, ...], salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform("id", salt, seed) * len(values)) + 1).cast("int"))

    drawn = F.array_sort(F.array(*[uniform("id", f"rating{i}", seed) for i in range(9)]))
    base = spark.range(n).select(F.col("id").cast("int").alias("id"))
    told = base.select(
        "id", pick(BRANDS, "brand").alias("brand"), pick(CATEGORIES, "category").alias("category"), F.round(F.exp(6 + _normal("id", "price", seed)), 2).alias("price"),
        F.floor(uniform("id", "reviews", seed) * 5000).cast("int").alias("num_reviews"), (uniform("id", "stock", seed) < 0.9).alias("in_stock"), F.round(drawn[7] * 5, 2).alias("rating"),
        F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda i: _normal(F.col("id"), F.concat(F.lit("v"), i.cast("string")), seed)).alias("raw"),
    )
    named = told.withColumn("name", F.concat_ws(" ", "brand", F.expr("substring(category, 1, length(category) - 1)"), F.col("id").cast("string")))
    described = named.withColumn("description", F.concat(F.col("name"), F.lit(" of our "), F.lower("category"), F.lit(" for "), F.col("price").cast("string")))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return described.withColumn("length", length).withColumn("embedding", F.transform("raw", lambda x: (x / F.col("length")).cast("float"))).drop("raw", "length")
