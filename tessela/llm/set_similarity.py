"""All pairs of set-valued records above a Jaccard threshold: a prefix-filtered join over rarity-ordered tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.llm.cooccurrence import basket_pairs
from tessela.runtime import broadcast_if_small, checkpoint, shuffle_partitions

#: Postings of one token that are joined within one group; a longer list is split into pairs of blocks of this size.
BLOCK = 2_048
#: Members of a class that meet those of another one in one group.
MEMBERS = 512
#: Different tokens up to which their numbers are broadcast.
VOCABULARY = 200_000


def normalised_sets(df: DataFrame, id_col: str, values_col: str, min_size: int) -> DataFrame:
    """(id, tokens): values trimmed and lower-cased, nulls and empties dropped, distinct, sorted; sets under min_size left out."""
    blank = r"^[\s ]+|[\s ]+$"
    cleaned = F.transform(F.col(values_col), lambda v: F.lower(F.regexp_replace(v, blank, "")))
    tokens = F.array_sort(F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull() & (v != ""))))
    return df.select(F.col(id_col).alias("id"), tokens.alias("tokens")).where(F.col("id").isNotNull() & (F.size("tokens") >= min_size)).distinct()


def _least_overlap(threshold: float):
    """Smallest overlap that a pair of sizes n, m needs; the small term guards against a float quotient just above an integer."""
    return lambda n, m: F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """The table with ``number``: different for every row and growing in the given order, without bringing the rows into one task."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return checkpoint(ranged.withColumn("number", F.monotonically_increasing_id()))


def similar_sets(records: DataFrame, threshold: float = 0.6, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """records(table, id, tokens) -> (classes(set_id, table, id), pairs(set_a, set_b, shared, similarity)), both checkpointed.

    Equal sets form one class. Pairs are between different classes only, so copies cost nothing; every class is in itself
    a set of pairs with similarity 1. Tokens are numbered by rarity over all classes; a set of n tokens is indexed under its
    first n - ceil(threshold * n) + 1 only. Two sets that meet under a token pass the length and the positional filter, then their overlap is
    counted exactly, and they count under the rarest token that they share only. Lists of frequent tokens are joined as pairs of blocks.
    """
    text = F.array_join("tokens", "\x1f")
    keyed = checkpoint(records.select("table", "id", "tokens", F.sha2(text, 256).alias("text")))
    sets = _numbered(keyed.groupBy("text").agg(F.first("tokens").alias("tokens")), ["text"]).withColumnRenamed("number", "set_id")
    classes = checkpoint(keyed.select("table", "id", "text").join(sets.select("text", "set_id"), "text").select("set_id", "table", "id"))
    flat = sets.select("set_id", F.explode("tokens").alias("token"))
    words = _numbered(flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")), ["df", "token"]).withColumnRenamed("number", "rank")
    ranked = flat.join(broadcast_if_small(words, VOCABULARY), "token").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("rank", "df"))).alias("r"))
    ranked = ranked.select("set_id", F.transform("r", lambda x: x["rank"]).alias("ranks"), F.transform("r", lambda x: x["df"]).alias("dfs"), F.size("r").alias("n"))
    # A token that no other set holds leads to no pair.
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    prefix = F.slice(F.arrays_zip(F.col("ranks").alias("rank"), F.col("dfs").alias("df")), F.lit(1), length)
    posts = ranked.select("set_id", "ranks", "n", F.posexplode(prefix).alias("pos", "t")).where("t.df > 1").select("set_id", "ranks", "n", "pos", F.col("t.rank").alias("rank"))
    posts = checkpoint(posts)
    long = posts.groupBy("rank").agg(F.count(F.lit(1)).alias("posts")).where(F.col("posts") > block)
    long = broadcast_if_small(checkpoint(long.select("rank", F.ceil(F.col("posts") / F.lit(block)).cast("int").alias("blocks"))), VOCABULARY)
    placed = posts.join(long, "rank", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("rank", F.col("own").alias("block_l"), every.alias("block_r"), F.col("set_id").alias("set_a"), F.col("ranks").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    right = placed.select("rank", every.alias("block_l"), F.col("own").alias("block_r"), F.col("set_id").alias("set_b"), F.col("ranks").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    need = _least_overlap(threshold)(F.col("n_a"), F.col("n_b"))
    met = (
        left.join(right, ["rank", "block_l", "block_r"])
        .where("set_a < set_b")
        .where((F.col("n_a") >= F.col("n_b") * F.lit(threshold) - 1e-9) & (F.col("n_b") >= F.col("n_a") * F.lit(threshold) - 1e-9))
        .where(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need - F.least("pos_a", "pos_b"))
        .withColumn("both", F.array_intersect("a", "b"))
        .where(F.element_at("both", 1) == F.col("rank"))
        .select("set_a", "set_b", F.size("both").alias("shared"), (F.col("n_a") + F.col("n_b") - F.size("both")).alias("united"))
        .where(F.col("shared") >= F.col("united") * F.lit(threshold) - F.lit(1e-9))
    )
    pairs = checkpoint(met.select("set_a", "set_b", "shared", (F.col("shared") / F.col("united")).alias("similarity")))
    return classes, pairs


def similar_records(records: DataFrame, threshold: float = 0.6, members: int = MEMBERS) -> DataFrame:
    """(table_a, id_a, table_b, id_b): every pair of records, classes expanded; (table_a, id_a) < (table_b, id_b).

    Large classes are expanded in chunks. Defined cases: null ids are dropped; a null, empty or too small set is no record; an id that stands
    under several sets matches by any of them and never with itself; repeated rows count once; empty tables give no rows.
    """
    classes, pairs = similar_sets(records, threshold)
    member = classes.select("set_id", F.struct("table", "id").alias("m"))
    within = basket_pairs(member.select(F.col("set_id").alias("basket"), F.col("m").alias("item"))).select("a", "b")
    sizes = classes.groupBy("set_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > members)
    sizes = broadcast_if_small(checkpoint(sizes.select("set_id", F.ceil(F.col("c") / F.lit(members)).cast("int").alias("chunks"))), VOCABULARY)
    chunked = member.join(sizes, "set_id", "left").select("set_id", F.pmod(F.xxhash64("m"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"), "m")
    side = lambda s: sizes.select(F.col("set_id").alias(f"set_{s}"), F.col("chunks").alias(f"chunks_{s}"))
    spread = pairs.select("set_a", "set_b").join(side("a"), "set_a", "left").join(side("b"), "set_b", "left")
    spread = spread.withColumn("chunk_a", F.explode(F.sequence(F.lit(0), F.coalesce("chunks_a", F.lit(1)) - 1))).withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.coalesce("chunks_b", F.lit(1)) - 1)))
    ends = lambda s: chunked.select(F.col("set_id").alias(f"set_{s}"), F.col("chunk").alias(f"chunk_{s}"), F.col("m").alias(s))
    across = spread.join(ends("a"), ["set_a", "chunk_a"]).join(ends("b"), ["set_b", "chunk_b"]).where("a != b")
    both = within.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # Only where a record stands under several sets can a pair come out twice.
    several = classes.groupBy("table", "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    both = both.distinct() if several else both
    return both.select(F.col("a.table").alias("table_a"), F.col("a.id").alias("id_a"), F.col("b.table").alias("table_b"), F.col("b.id").alias("id_b"))


def similarity_degrees(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row for each record: its class and its number of links, copies of its set included; nothing is expanded."""
    classes, pairs = similar_sets(records, threshold)
    sizes = checkpoint(classes.groupBy("set_id").agg(F.count(F.lit(1)).alias("size")))
    ends = pairs.select(F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(pairs.select(F.col("set_b").alias("set_id"), F.col("set_a").alias("other")))
    far = ends.join(sizes.select(F.col("set_id").alias("other"), F.col("size").alias("far")), "other").groupBy("set_id").agg(F.sum("far").alias("far"))
    return classes.join(sizes, "set_id").join(far, "set_id", "left").select("table", "id", F.col("set_id").alias("class_id"), (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
