"""Items that appear together more often than chance, with large baskets split into chunk pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.runtime import broadcast_if_small, checkpoint

#: Items of a basket that one task holds at a time; a larger basket becomes pairs of chunks of about this size.
CHUNK = 128
#: Rows of an item from which it isn't joined by its key but by a broadcast; so many items are as few as all rows divided by it.
HOT = 100_000
#: Keys of large baskets or of hot items that are broadcast at most.
FEW = 200_000


def _pairs_within(items: Column) -> Column:
    """All a < b of a sorted array, as an array of structs."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def basket_pairs(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """baskets(basket, item), distinct -> (a, b), a < b, a row for each basket that holds both.

    A basket of up to ``chunk`` items is expanded in one row. A larger one is cut into hashed chunks, and each pair of
    chunks is a group of its own, so the size of a task's group is bounded while the baskets' sizes aren't.
    """
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    large = broadcast_if_small(checkpoint(sizes), FEW)
    plain = baskets.join(large.select("basket"), "basket", "left_anti").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = plain.where(F.size("items") > 1).select(F.explode(_pairs_within(F.col("items"))).alias("p")).select("p.a", "p.b")
    big = baskets.join(large, "basket").withColumn("parts", F.ceil(F.col("n") / F.lit(chunk)).cast("int")).withColumn("own", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    # Chunk own meets every chunk: key (low, high); the side says which of the two the item came from.
    spread = big.select("basket", "item", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keyed = spread.groupBy("basket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("item"))).alias("left"),
        F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("item"))).alias("right"),
    )
    crossed = keyed.select("low", "high", F.explode("left").alias("x"), "right").select("low", "high", "x", F.explode("right").alias("y"))
    crossed = crossed.where((F.col("low") < F.col("high")) | (F.col("x") < F.col("y")))
    return pairs.unionByName(crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def frequent_pairs(df: DataFrame, basket_col: str, item_col: str, min_count: int = 6, min_lift: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items with their joint count and association scores.

    Result: item_a < item_b, n (baskets with both), n_a, n_b, n_baskets (N), lift = n * N / (n_a * n_b),
    pmi (natural log of lift) and jaccard. Kept are pairs with n >= min_count and lift >= min_lift.

    Items that no kept pair can hold are left out before pairs are formed: n <= min(n_a, n_b), so n_a >= min_count is
    needed, and n * N / (n_a * n_b) <= N / max(n_a, n_b), so n_a * min_lift <= N is. Both bounds lose nothing.

    Defined cases: rows with a null basket or item are dropped; repeats of an item in a basket count once; an empty
    table gives no rows.
    """
    rows = checkpoint(df.select(F.col(basket_col).alias("basket"), F.col(item_col).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL").distinct())
    total = rows.select("basket").distinct().count()
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    able = checkpoint(counts.where((F.col("c") >= min_count) & (F.col("c") * F.lit(float(min_lift)) <= F.lit(total))))
    hot = broadcast_if_small(checkpoint(counts.where(F.col("c") >= HOT).select("item")), FEW)
    often, seldom = able.where(F.col("c") >= HOT).select("item"), able.where(F.col("c") < HOT).select("item")
    kept = rows.join(broadcast_if_small(often, FEW), "item", "left_semi").unionByName(rows.join(hot, "item", "left_anti").join(seldom, "item", "left_semi"))
    joint = basket_pairs(kept, chunk).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    joint = joint.join(able.select(F.col("item").alias("a"), F.col("c").alias("n_a")), "a").join(able.select(F.col("item").alias("b"), F.col("c").alias("n_b")), "b")
    lift = F.col("n") * F.lit(total).cast("double") / (F.col("n_a") * F.col("n_b"))
    return (
        joint.withColumn("n_baskets", F.lit(total).cast("long"))
        .withColumn("lift", lift)
        .where(F.col("lift") >= min_lift)
        .select(
            F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n", "n_a", "n_b", "n_baskets", "lift",
            F.log("lift").alias("pmi"), (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"),
        )
    )
