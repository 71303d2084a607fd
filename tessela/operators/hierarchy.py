"""Parent-child links to full hierarchies.

Every step moves a constant number of small rows per node, in a number of rounds logarithmic in the depth:

1. ``_climb`` doubles each node's jump to its ancestor and adds up, on the way, its depth, its root and its subtree
   size. Nodes whose jump has ended are set aside, so a round joins and writes the open ones only; parents of very many nodes meet them
   by a broadcast. The rounds end as soon as one of them finishes no further node: depths have no gaps, so what is left
   runs in circles.
2. ``_circles`` shrinks the unfinished nodes to the circles themselves (the image of their jumps) and takes the smallest id of
   each; their links are cut and the unfinished nodes climb once more.
3. Heavy paths: each node's largest child continues its chain. A path crosses at most log2(n) chains, so paths are
   put together from chain segments, and the descendants of a node are one interval of the chain-first order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.runtime import checkpoint, shuffle_partitions, written

DESCENDANT_INTERVALS = ("interval_start", "interval_end")


#: Rows under one key from which the key is joined by a broadcast of its single row; so many keys are as few as all rows divided by it.
HOT = 100_000
#: Rows of a file that a round writes, about.
PACKED = 250_000


def _meet(left: DataFrame, rows: int, right: DataFrame, key: str) -> DataFrame:
    """Inner join of so many rows with a table that has one row a key. Keys that stand very often on the left are joined by a broadcast of their rows."""
    if rows < HOT:
        return left.join(right, key)
    often = checkpoint(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= HOT).select(key))
    if not often.limit(1).count():
        return left.join(right, key)
    few = F.broadcast(right.join(F.broadcast(often), key, "left_semi"))
    return left.join(few, key).unionByName(left.join(F.broadcast(often), key, "left_anti").join(right, key))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """The table written in files of a useful size, so that the many rounds of a small table don't leave many small files."""
    return written(df.coalesce(rows // PACKED + 1))


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """nodes(id, parent) -> (finished(id, depth, top, size), unfinished(id, anc, low), their number, steps per jump).

    size counts the node itself. anc is where a jump leads, and low the smallest id on its way, the start included. Each round writes the nodes
    that were open before it; what they are then is found in this or an earlier round's table."""
    nothing = F.lit(None).cast("long")
    rounds = [
        written(
            nodes.select(
                "id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.when(F.col("parent").isNull(), F.col("id")).alias("top"),
                F.lit(1).cast("long").alias("size"), F.col("id").alias("low"),
            )
        )
    ]
    gains: list[DataFrame] = []
    still, steps = rounds[0].where("anc IS NOT NULL"), 1
    count = still.count()
    while count:
        steps *= 2
        gain = still.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("gain"))
        gains.append(gain)
        ended = [r.where("anc IS NULL").select(F.col("id").alias("anc"), nothing.alias("anc2"), F.col("depth").alias("depth2"), "top", nothing.alias("low2")) for r in rounds]
        going = still.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), nothing.alias("top"), F.col("low").alias("low2"))
        moved = _packed(
            _meet(still.drop("top"), count, reduce(DataFrame.unionByName, [*ended, going]), "anc")
            .join(gain, "id", "left")
            .select("id", F.col("anc2").alias("anc"), (F.col("depth") + F.col("depth2")).alias("depth"), "top", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), F.least("low", "low2").alias("low")),
            count,
        )
        rounds.append(moved)
        still = moved.where("anc IS NOT NULL")
        left = still.count()
        if left == count:
            break
        count = left
    done = reduce(DataFrame.unionByName, [r.where("anc IS NULL").select("id", "depth", "top") for r in rounds])
    # What a node took over in any round adds up to its descendants.
    below = reduce(DataFrame.unionByName, gains).groupBy("id").agg(F.sum("gain").alias("below")) if gains else None
    sized = done.withColumn("size", F.lit(1).cast("long")) if below is None else done.join(below, "id", "left").select("id", "depth", "top", (F.coalesce("below", F.lit(0)) + 1).alias("size"))
    return sized, still.select("id", "anc", "low"), count, steps


def _follow(links: DataFrame, key: str, up: str, summed: dict) -> DataFrame:
    """links(key, up, ...) -> the same for every key at the end of its chain of links, by doubling. summed: column -> how a link's value and that of
    the one above it join. Columns that aren't summed come from the end."""
    ends = [c for c in links.columns if c not in (key, up, *summed)]
    rounds = [written(links)]
    still = rounds[0].where(F.col(up).isNotNull())
    count = still.count()
    while count:
        over = lambda r: r.select(F.col(key).alias(up), F.col(up).alias("__up"), *[F.col(c).alias(f"__{c}") for c in (*summed, *ends)])
        above = reduce(DataFrame.unionByName, [*[over(r.where(F.col(up).isNull())) for r in rounds], over(still)])
        moved = _packed(
            _meet(still.drop(*ends), count, above, up).select(
                key, F.col("__up").alias(up), *[join(F.col(c), F.col(f"__{c}")).alias(c) for c, join in summed.items()], *[F.col(f"__{c}").alias(c) for c in ends]
            ),
            count,
        )
        rounds.append(moved)
        still = moved.where(F.col(up).isNotNull())
        count = still.count()
    return reduce(DataFrame.unionByName, [r.where(F.col(up).isNull()).drop(up) for r in rounds])


def _circles(jump: DataFrame, count: int, steps: int) -> DataFrame:
    """jump(id, anc, low) of nodes whose walks all end in circles -> members(id, smallest).

    Jumps lead into the circles once they are as long as the longest way there, which is so when there are as many steps as nodes, or
    when doubling them reaches no fewer nodes. Then low is a circle's smallest id if a jump also goes all round."""
    reached = -1
    while True:
        image = written(jump.select(F.col("anc").alias("id")).distinct())
        now = image.count()
        if steps >= count or (now == reached and steps >= now):
            return jump.join(image, "id", "left_semi").select("id", F.col("low").alias("smallest"))
        reached, steps = now, steps * 2
        up = jump.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        jump = written(jump.join(up, "anc").select("id", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low")))


def _ordered_offsets(df: DataFrame, key: str, order: list, weight: str) -> DataFrame:
    """Exclusive running sum of weight within key, in order. Hot keys are split: ranges, their totals, then a running sum
    within each range, so no task holds more than one range."""
    n = shuffle_partitions(df.sparkSession)
    ranged = checkpoint(df.repartitionByRange(n, F.col(key), *order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(key, "__part").agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "__part", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(parts, [key, "__part"])
        .withColumn("offset", F.col("__base") + F.col("__in"))
        .drop("__part", "__in", "__base")
    )


def _heavy_paths(forest: DataFrame) -> DataFrame:
    """forest(id, parent, depth, top, size) without circles -> the same with path, interval_start, interval_end."""
    child = forest.where("parent IS NOT NULL")
    heavy = child.groupBy("parent").agg(F.max_by("id", F.struct("size", (-F.col("id").cast("long")).alias("x"))).alias("heavy"))
    marked = forest.join(heavy.select(F.col("heavy").alias("id"), F.lit(True).alias("is_heavy")), "id", "left").withColumn(
        "is_heavy", F.coalesce("is_heavy", F.lit(False))
    )
    # A chain's head, by doubling along heavy links only.
    is_heavy = F.col("is_heavy")
    chain = _follow(marked.select("id", F.when(is_heavy, F.col("parent")).alias("anc"), is_heavy.cast("int").alias("pos"), F.when(~is_heavy, F.col("id")).alias("head")), "id", "anc", {"pos": lambda a, b: a + b})
    placed = written(marked.join(chain.select("id", "head", "pos"), "id"))
    # A chain's ids are the end of one output path, so this array is no longer than a value of the result.
    members = placed.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"].cast("string")).alias("ids"))
    spot = placed.select(F.col("id").alias("above"), F.col("head").alias("up"), F.col("pos").alias("up_pos"))
    heads = placed.where("id = head").select("head", F.col("parent").alias("above"), "size").join(spot, "above", "left")
    # Offsets of light children behind the heavy one, then chain starts and path prefixes by doubling over chains.
    heavy_size = placed.where("is_heavy").select(F.col("parent").alias("above"), F.col("size").alias("heavy_size"))
    light = _ordered_offsets(heads.where("above IS NOT NULL").select("head", "above", "size"), "above", [F.col("head")], "size")
    light = light.join(heavy_size, "above").select("head", (F.col("offset") + F.col("heavy_size") + 1).alias("offset"))
    above_ids = members.select(F.col("head").alias("up"), "ids")
    links = heads.join(light, "head", "left").join(above_ids, "up", "left").select(
        "head",
        "up",
        F.when(F.col("up").isNull(), F.lit("")).otherwise(F.concat(F.array_join(F.slice("ids", F.lit(1), F.col("up_pos") + 1), "/"), F.lit("/"))).alias("prefix"),
        F.when(F.col("up").isNull(), F.lit(0).cast("long")).otherwise(F.col("up_pos") + F.col("offset")).alias("start"),
    )
    links = _follow(links, "head", "up", {"prefix": lambda own, above: F.concat(above, own), "start": lambda own, above: own + above})
    return (
        placed.join(members, "head")
        .join(links.select("head", "prefix", "start"), "head")
        .select(
            "id", "parent", "depth", "top", "size",
            F.concat("prefix", F.array_join(F.slice("ids", F.lit(1), F.col("pos") + 1), "/")).alias("path"),
            (F.col("start") + F.col("pos")).alias("interval_start"),
            (F.col("start") + F.col("pos") + F.col("size")).alias("interval_end"),
        )
    )


def expand_hierarchy(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Root, depth, path, descendants and circle mark of every id of a table of parent-child rows.

    Result: id, root_id, depth, path, n_descendants, in_loop (1 if the walk upwards never ends), and the interval
    [interval_start, interval_end): within the same ``tree``, the descendants of a node are the nodes whose
    interval_start lies inside its interval, itself excluded. ``tree`` is the root, or the circle's member that is entered.

    Defined cases: a null id is dropped; repeated rows count once; an id with several parents keeps the smallest
    one that exists in the table; a null or absent parent makes a root; an id that is its own parent is a circle of one; an empty
    table gives an empty result. Further columns are ignored, whatever their names.
    """
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent")).where("id IS NOT NULL").distinct()
    known = raw.select(F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    total = raw.count()
    nodes = _packed(raw.join(known, "parent", "left").groupBy("id").agg(F.min(F.when(F.col("known"), F.col("parent"))).alias("parent")), total)
    done, unfinished, n_unfinished, steps = _climb(nodes)
    if not n_unfinished:
        forest = nodes.join(done, "id")
        rings = None
    else:
        looped = nodes.join(unfinished, "id", "left_semi")
        rings = written(_circles(unfinished, n_unfinished, steps))
        cut = written(
            looped.join(rings.select("id", F.lit(True).alias("ring")), "id", "left").select("id", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent"))
        )
        hung, *_ = _climb(cut)
        straight = nodes.join(unfinished, "id", "left_anti").join(done, "id")
        forest = straight.unionByName(cut.join(hung, "id"))
    forest = _packed(forest, total)
    full = _heavy_paths(forest)
    if rings is None:
        return full.select(
            "id", F.col("top").alias("root_id"), "depth", "path", (F.col("size") - 1).alias("n_descendants"), F.lit(0).alias("in_loop"),
            F.col("top").alias("tree"), *DESCENDANT_INTERVALS,
        )
    sizes = forest.join(rings, "id").groupBy("smallest").agg(F.sum("size").alias("ring_size"))
    tops = rings.join(sizes, "smallest").select(F.col("id").alias("top"), "smallest", "ring_size")
    return full.join(tops, "top", "left").select(
        "id",
        F.coalesce("smallest", "top").alias("root_id"),
        "depth",
        "path",
        (F.when(F.col("ring_size").isNotNull() & (F.col("id") == F.col("top")), F.col("ring_size")).otherwise(F.col("size")) - 1).alias("n_descendants"),
        F.col("smallest").isNotNull().cast("int").alias("in_loop"),
        F.col("top").alias("tree"),
        *DESCENDANT_INTERVALS,
    )


def descendants(full: DataFrame, wanted: DataFrame, stretch: int = 4_096) -> DataFrame:
    """(id, descendant) for the ids in wanted(id); a circle's member has the other members and all that hangs on them, as n_descendants counts.

    The nodes of a tree stand at the places 0, 1, 2, ... of its chain-first order, and a node's descendants are the places of its interval; a circle's
    member also has all places of the other members' trees. So the intervals are unrolled into places, long ones in stretches, and each place
    meets its one node: no row is looked at that isn't in the result."""
    asked = full.join(wanted.select("id").distinct(), "id", "left_semi")
    below = asked.select("id", "tree", (F.col("interval_start") + 1).alias("first"), "interval_end").where("interval_end > first")
    member = (F.col("in_loop") == 1) & (F.col("id") == F.col("tree"))
    others = full.where(member).select("root_id", "tree", F.col("interval_start").alias("first"), "interval_end")
    around = asked.where(member).select("id", "root_id").join(others, "root_id").where("id != tree").select("id", "tree", "first", "interval_end")
    cut = below.unionByName(around).select("id", "tree", "interval_end", F.explode(F.sequence(F.col("first"), F.col("interval_end") - 1, F.lit(stretch).cast("long"))).alias("lo"))
    places = cut.select("id", "tree", F.explode(F.sequence("lo", F.least(F.col("lo") + stretch, "interval_end") - 1)).alias("at"))
    nodes = full.select(F.col("id").alias("descendant"), "tree", F.col("interval_start").alias("at"))
    return places.join(nodes, ["tree", "at"]).select("id", "descendant")
