"""Summaries of products and customers over a chain of outer joins whose fan-out is part of the result.

Each side is reduced before it is joined: the chain's rows are a product of the matches of either side, so its sums
are sums of one side times the number of matches of the other, and nothing multiplies in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_stats(products: DataFrame, reviews: DataFrame, items: DataFrame, key: str, review_id: str, rating: str, order_id: str, quantity: str) -> DataFrame:
    """Per product of products left join reviews left join items: review_count and order_count (distinct), avg_rating, and
    total_sold, in which an item counts once for each review (once where there is none).

    The average over the product of both sides is the average over the reviews. Columns of products come along, vectors without a
    shuffle of their own where the side is small.
    """
    r = reviews.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__m"), F.count_distinct(review_id).alias("review_count"), F.avg(rating).alias("avg_rating"))
    i = items.groupBy(F.col(key).alias("__k")).agg(F.count_distinct(order_id).alias("order_count"), F.sum(quantity).alias("__sold"))
    out = products.join(r.withColumnRenamed("__k", "__rk"), F.col(key) == F.col("__rk"), "left").join(i.withColumnRenamed("__k", "__ik"), F.col(key) == F.col("__ik"), "left")
    return out.select(
        *products.columns,
        F.coalesce("review_count", F.lit(0)).cast("long").alias("review_count"),
        "avg_rating",
        F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"),
        (F.col("__sold") * F.coalesce("__m", F.lit(1))).alias("total_sold"),
    )


def customer_summary(customers: DataFrame, orders: DataFrame, items: DataFrame, key: str, customer: str, order: str, amount: str, date: str, product: str) -> DataFrame:
    """Per customer of customers left join orders left join items: order_count (distinct), total_spent and avg_order_value, in
    which an order counts once for each of its items (once where it has none), last_order_date and unique_products_bought.

    key names the customer in customers, customer in orders. The items' shuffle serves both the count per order and, joined to the orders, the distinct products.
    """
    lines = items.select(F.col(order).alias("__o"), F.col(product).alias("__p"))
    spread = orders.select(F.col(customer).alias("__c"), F.col(order).alias("__o"), F.col(amount).alias("__a"), F.col(date).alias("__d")).join(lines, "__o", "left")
    per = spread.groupBy("__c").agg(
        F.count_distinct("__o").alias("order_count"), F.sum("__a").alias("total_spent"), F.count("__a").alias("__n"), F.max("__d").alias("last_order_date"), F.count_distinct("__p").alias("unique_products_bought")
    )
    out = customers.join(per, F.col(key) == F.col("__c"), "left")
    return out.select(
        *customers.columns,
        F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"),
        "total_spent",
        (F.col("total_spent").cast("double") / F.col("__n")).alias("avg_order_value"),
        "last_order_date",
        F.coalesce("unique_products_bought", F.lit(0)).cast("long").alias("unique_products_bought"),
    )


def refresh(view: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a view and return it as a table read from there."""
    writer = view.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return view.sparkSession.read.parquet(path)
