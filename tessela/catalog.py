"""The core's registered queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela import catalog_estimates, catalog_storage  # noqa: F401  they register their queries
from tessela.functions.partition_ids import hash_id, partition_id, range_id
from tessela.operators import constraints, distributed, layouts, relational, statistics, views
from tessela.operators.hierarchy import descendants, expand_hierarchy
from tessela.operators.relational import Operator
from tessela.operators.vector_search import InvertedLists, build_inverted_lists, vector_search
from tessela.plans import cost, learned
from tessela.plans.hybrid import execute_hybrid
from tessela.plans.ir import HybridQuery, Predicate, TableStats, VectorOp
from tessela.plans.planner import Planner, PlannerConfig
from tessela.registry import QUERIES, SQL, registered
from tessela.runtime import once, read, scratch, written
from tessela.sources import files, generator

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").join(read(spark, sf_dir, "embeddings"), F.col("p_partkey") == F.col("vec_id"))


def _query_vector(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    """The vector that the searches ask for, fetched once a session."""
    return once(spark, ("query vector", sf_dir), lambda: tuple(map(float, read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])))


def _ranked(df: DataFrame, *columns: str) -> DataFrame:
    """At most k rows: their ranks make the order part of the result."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), "vec_id"))
    return df.select(rank.alias("rank"), F.col("vec_id"), *columns, F.round("distance", 6).alias("distance"))


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_ITEMS = "part JOIN embeddings ON p_partkey = vec_id"

# Scans, projection, filters


@registered("SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem")
def scan_project(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("tessela_lineitem")
    return relational.execute(spark, Operator("project", {"columns": ["l_suppkey", "l_orderkey", "no_such_column", "l_quantity", "l_suppkey"]}, (Operator("scan", {"table": "tessela_lineitem"}),)))


@registered("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'ECONOMY' AND p_size < 25")
def index_scan_filter(spark, sf_dir):
    return relational.index_scan(read(spark, sf_dir, "part"), "p_type = 'ECONOMY' AND p_size < 25", ["p_partkey", "p_name", "p_size"])


@registered("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_name LIKE '%a%' AND p_size > 3 AND p_size <= 40 AND p_retailprice >= 901 AND p_brand = 'Brand#2'")
def filter_ops_eq_range_in_like(spark, sf_dir):
    from tessela.plans.ir import conjunction

    wanted = [("p_type", "IN", ("ECONOMY", "PROMO")), ("p_name", "LIKE", "%a%"), ("p_size", ">", 3), ("p_size", "<=", 40), ("p_retailprice", ">=", 901), ("p_brand", "=", "Brand#2")]
    return read(spark, sf_dir, "part").where(conjunction([Predicate(*w) for w in wanted])).select("p_partkey")


@registered("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice < 50000 AND o_orderstatus = 'F'")
def parameterised_sql(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("tessela_orders")
    return relational.sql(spark, "SELECT o_orderkey, o_orderpriority FROM tessela_orders WHERE o_totalprice < %s AND o_orderstatus = %s", [50000, "F"])


@registered("SELECT c_custkey FROM customer WHERE c_acctbal % 2 < 1 AND c_mktsegment = 'BUILDING'")
def filter_callable(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    import math

    return relational.filter_rows(rows, lambda r: math.fmod(r["c_acctbal"], 2) < 1 and r["c_mktsegment"] == "BUILDING").select("c_custkey")


@registered("SELECT count(*) AS total, count(embedding) AS embedded FROM embeddings")
def verify_counts(spark, sf_dir):
    return statistics.verification_counts(read(spark, sf_dir, "embeddings"), "embedding")


# Vector search


def _topk(metric: str):
    return lambda spark, sf_dir: _ranked(vector_search(read(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 10, metric, tie="vec_id"))


for _name, _metric, _function in (("cosine", "cosine", "list_cosine_distance"), ("l2", "l2", "list_distance"), ("ip", "inner_product", "list_negative_inner_product")):
    QUERIES[f"vector_topk_{_name}"] = _topk(_metric)
    SQL[f"vector_topk_{_name}"] = f"""SELECT row_number() OVER (ORDER BY d, vec_id)::INTEGER AS rank, vec_id, round(d, 6) AS distance
FROM (SELECT vec_id, {_function}(embedding::DOUBLE[], {_Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10)"""

_PREDICATES = (Predicate("p_type", "=", "ECONOMY"), Predicate("p_size", "<", 25))


def _hybrid(spark, sf_dir, plan_type, predicates=_PREDICATES, stats=None, config=None):
    vector = VectorOp("embedding", _query_vector(spark, sf_dir), 10)
    result = execute_hybrid(_items(spark, sf_dir), vector, predicates, plan_type, stats, "vec_id", config=config)
    return _ranked(result.rows, "p_partkey")


def _hybrid_sql(inner: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY d, vec_id)::INTEGER AS rank, vec_id, p_partkey, round(d, 6) AS distance FROM ({inner})"


_DISTANCE = f"list_cosine_distance(embedding::DOUBLE[], {_Q}) AS d"


@registered(_hybrid_sql(f"SELECT *, {_DISTANCE} FROM {_ITEMS} WHERE p_type = 'ECONOMY' AND p_size < 25 ORDER BY d, vec_id LIMIT 10"))
def hybrid_filter_first(spark, sf_dir):
    return _hybrid(spark, sf_dir, "filter_first")


@registered(_hybrid_sql(f"SELECT * FROM (SELECT *, {_DISTANCE} FROM {_ITEMS} ORDER BY d, vec_id LIMIT 100) WHERE p_type = 'ECONOMY' AND p_size < 25 ORDER BY d, vec_id LIMIT 10"))
def hybrid_vector_first(spark, sf_dir):
    return _hybrid(spark, sf_dir, "vector_first")


@registered(_hybrid_sql(f"SELECT *, {_DISTANCE} FROM {_ITEMS} WHERE p_type = 'ECONOMY' AND p_size < 25 ORDER BY d, vec_id LIMIT 10"))
def hybrid_sequential(spark, sf_dir):
    return _hybrid(spark, sf_dir, "sequential")


@registered(_hybrid_sql(f"SELECT * FROM (SELECT *, {_DISTANCE} FROM {_ITEMS} WHERE p_type = 'ECONOMY' ORDER BY d, vec_id LIMIT 10) WHERE p_size < 25"))
def hybrid_split(spark, sf_dir):
    predicates = (Predicate("p_size", "<", 25, selectivity=0.48), Predicate("p_type", "=", "ECONOMY", selectivity=0.17))
    return _hybrid(spark, sf_dir, "hybrid", predicates, TableStats(100_000))


@registered(_hybrid_sql(f"SELECT *, {_DISTANCE} FROM {_ITEMS} WHERE p_brand = 'Brand#2' AND p_size < 25 ORDER BY d, vec_id LIMIT 10"))
def hybrid_auto(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    stats = once(spark, ("part statistics", sf_dir), lambda: statistics.table_statistics(part, ["p_brand", "p_size"], indexed=["p_brand", "p_size"]))
    return _hybrid(spark, sf_dir, "auto", (Predicate("p_brand", "=", "Brand#2"), Predicate("p_size", "<", 25)), stats)


def _lists(spark, sf_dir) -> InvertedLists:
    """The items' inverted lists, built and written once a session and read from their folders."""

    def build():
        path = scratch(spark)
        build_inverted_lists(_items(spark, sf_dir).select("vec_id", "p_partkey", "p_type", "embedding"), "embedding", 16).write(path)
        return InvertedLists.open(spark, path, "embedding")

    return once(spark, ("inverted lists", sf_dir), build)


@registered(_hybrid_sql(f"SELECT *, {_DISTANCE} FROM {_ITEMS} WHERE p_type = 'ECONOMY' ORDER BY d, vec_id LIMIT 10"))
def ivf_full_probe(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return _ranked(lists.search(_query_vector(spark, sf_dir), 10, len(lists.centroids), where="p_type = 'ECONOMY'", tie="vec_id"), "p_partkey")


#: Lists of sixteen that a search probes; the vectors of the test tables have no clusters, so few lists hold few of the nearest.
PROBES = 12


@registered()
def ivf_probe(spark, sf_dir):
    return _ranked(_lists(spark, sf_dir).search(_query_vector(spark, sf_dir), 10, PROBES, tie="vec_id"))


@registered("SELECT count(*) AS queries, true AS recall_is_enough FROM part JOIN embeddings ON p_partkey = vec_id WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf_dir):
    """Every vector whose id is divisible by 100 is asked for, over the probed lists and over all of them."""
    lists = _lists(spark, sf_dir)
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("vec_id"), "left_semi")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    probed = lists.search_many(asked, "vec_id", 10, PROBES).select("query_id", "id", F.lit(1).alias("hit"))
    exact = lists.search_many(asked, "vec_id", 10, len(lists.centroids)).select("query_id", "id")
    both = exact.join(probed, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)) >= 0.9).alias("recall_is_enough"))


@registered(_hybrid_sql(f"SELECT * FROM (SELECT *, {_DISTANCE} FROM {_ITEMS} ORDER BY d, vec_id LIMIT 20) WHERE p_size < 25"))
def operator_tree_search(spark, sf_dir):
    """The vector search as a leaf of an operator tree, below a filter and a projection."""
    _items(spark, sf_dir).createOrReplaceTempView("tessela_items")
    leaf = Operator("vector_search", {"table": "tessela_items", "vector_column": "embedding", "query_vector": _query_vector(spark, sf_dir), "k": 20, "columns": ["vec_id", "p_partkey", "p_size"], "tie": "vec_id"})
    tree = Operator("project", {"columns": ["vec_id", "p_partkey", "distance"]}, (Operator("filter", {"predicate": "p_size < 25"}, (leaf,)),))
    return _ranked(relational.execute(spark, tree), "p_partkey")


# Joins


@registered("""WITH a AS (SELECT nullif(n_nationkey % 6, 0) AS k, n_name AS name, n_nationkey FROM nation), b AS (SELECT nullif(r_regionkey, 0) AS k, r_name AS name FROM region)
SELECT b.k, b.name, a.n_nationkey FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def hash_join_nullsafe(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.nullif(F.col("n_nationkey") % 6, F.lit(0)).alias("k"), F.col("n_name").alias("name"), "n_nationkey")
    b = read(spark, sf_dir, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("k"), F.col("r_name").alias("name"))
    return relational.hash_join(a, b, "k", "k")


@registered("SELECT n_name, r_name, n_regionkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey")
def theta_join(spark, sf_dir):
    a, b = read(spark, sf_dir, "nation").select("n_name", "n_regionkey"), read(spark, sf_dir, "region")
    return relational.nested_loop_join(a, b, lambda l, r: l("n_regionkey") > r("r_regionkey"))


@registered("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def cross_join(spark, sf_dir):
    return relational.nested_loop_join(read(spark, sf_dir, "nation").select("n_nationkey"), read(spark, sf_dir, "region").select("r_regionkey"))


def _keyed(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.nullif(F.col("l_suppkey"), F.lit(3)).alias("k"), "l_orderkey", "l_quantity")
    suppliers = read(spark, sf_dir, "supplier").select(F.nullif(F.col("s_suppkey"), F.lit(3)).alias("k"), "s_name")
    return lines, suppliers


_KEYED = "WITH l AS (SELECT nullif(l_suppkey, 3) AS k, l_orderkey, l_quantity FROM lineitem), s AS (SELECT nullif(s_suppkey, 3) AS k, s_name FROM supplier) "
_NULLS_MATCH = _KEYED + "SELECT s.k, l_orderkey, l_quantity, s_name FROM l JOIN s ON l.k IS NOT DISTINCT FROM s.k"


@registered(_NULLS_MATCH)
def join_broadcast(spark, sf_dir):
    lines, suppliers = _keyed(spark, sf_dir)
    return distributed.broadcast_join(lines, suppliers, "k")


@registered(_NULLS_MATCH)
def join_shuffle(spark, sf_dir):
    lines, suppliers = _keyed(spark, sf_dir)
    return distributed.shuffle_join(lines, suppliers, "k")


@registered(_KEYED + "SELECT s.k, l_orderkey, l_quantity, s_name FROM l JOIN s ON l.k = s.k")
def join_colocated(spark, sf_dir):
    """Both sides are bucketed by the key when they are loaded; the join itself moves nothing."""

    def load():
        names = [f"tessela_{side}_{uuid.uuid4().hex[:12]}" for side in ("lines", "suppliers")]
        for name, side in zip(names, _keyed(spark, sf_dir)):
            layouts.write_bucketed(side, name, scratch(spark), "k", 8)
        return names

    lines, suppliers = map(spark.table, once(spark, ("buckets", sf_dir), load))
    return distributed.colocated_join(lines.hint("merge"), suppliers, "k")


@registered("""SELECT c.c_nationkey AS n_nationkey, c_custkey, n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_dispatch(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return distributed.distributed_join(customers, read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")[0]


@registered("""WITH x AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1)
SELECT p_partkey, x.p_brand AS index_brand FROM part JOIN x ON part.p_brand = x.p_brand AND list_contains(x.sizes, p_size) WHERE p_size <= 5""")
def catalog_join(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    index = part.groupBy(F.col("p_brand").alias("index_brand")).agg(F.collect_set("p_size").alias("sizes"))
    return part.where("p_size <= 5").join(index, (F.col("p_brand") == F.col("index_brand")) & F.expr("array_contains(sizes, p_size)")).select("p_partkey", "index_brand")


# Aggregates, sort, limit


@registered("""SELECT l_returnflag, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DECIMAL(38, 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, 0::BIGINT AS absent
FROM lineitem GROUP BY 1""")
def agg_group_all(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    wanted = {"n": ("count", "l_tax"), "total": ("sum", "q"), "low": ("min", "l_quantity"), "high": ("max", "l_quantity"), "mean": ("avg", "l_quantity"), "absent": ("sum", "no_such_column")}
    return relational.aggregate(lines, ["l_returnflag"], wanted).withColumn("mean", F.round("mean", 6)).withColumn("total", F.col("total").cast("decimal(38,2)"))


@registered("SELECT count(*) AS n, max(o_orderkey) AS last FROM orders HAVING count(*) > 0")
def agg_global(spark, sf_dir):
    return relational.aggregate(read(spark, sf_dir, "orders"), (), {"n": ("count", None), "last": ("max", "o_orderkey")})


@registered("SELECT count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
def agg_global_empty(spark, sf_dir):
    return relational.aggregate(read(spark, sf_dir, "orders").where("o_orderkey < 0"), (), {"n": ("count", None), "last": ("max", "o_orderkey")})


@registered("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey)::INTEGER AS rank, c_custkey, c_nationkey FROM (SELECT * FROM customer ORDER BY c_nationkey, c_custkey LIMIT 25)")
def sort_topn(spark, sf_dir):
    top = relational.limit(relational.sort(read(spark, sf_dir, "customer"), ["c_nationkey", "no_such_column"], "c_custkey"), 25)
    return top.select(F.row_number().over(Window.orderBy("c_nationkey", "c_custkey")).alias("rank"), "c_custkey", "c_nationkey")


@registered("SELECT r_regionkey, r_name FROM region")
def limit_none(spark, sf_dir):
    return relational.limit(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), 0)


# Views, constraints


@registered("""SELECT p_partkey, p_brand, count(DISTINCT r.l_orderkey * 10 + r.l_linenumber) AS review_count, round(avg(r.l_quantity), 6) AS avg_rating,
  count(DISTINCT i.l_orderkey) AS order_count, sum(i.l_quantity::BIGINT)::BIGINT AS total_sold
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 > 0) r ON p_partkey = r.l_partkey LEFT JOIN lineitem i ON p_partkey = i.l_partkey GROUP BY 1, 2""")
def product_stats(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity"), "l_returnflag")
    reviews = lines.where("l_returnflag = 'R' AND p_partkey % 3 > 0").withColumn("review_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    items = lines.withColumn("quantity", F.col("l_quantity").cast("long"))
    products = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return views.product_stats(products, reviews, items, "p_partkey", "review_id", "l_quantity", "l_orderkey", "quantity").withColumn("avg_rating", F.round("avg_rating", 6))


@registered("""SELECT c_custkey, c_mktsegment, count(DISTINCT o_orderkey) AS order_count, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(38, 2) AS total_spent,
  sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(o_totalprice) AS avg_order_value, max(o_orderdate) AS last_order_date, count(DISTINCT l_partkey) AS unique_products_bought
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 4 > 0) o ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def customer_summary(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_custkey % 4 > 0").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    full = views.customer_summary(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, items, "c_custkey", "o_custkey", "o_orderkey", "amount", "o_orderdate", "l_partkey")
    return full.withColumn("total_spent", F.col("total_spent").cast("decimal(38,2)"))


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique(spark, sf_dir):
    return constraints.broken_unique(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered("SELECT seller_id FROM sellers WHERE NOT (rating BETWEEN 3 AND 5)")
def constraint_check(spark, sf_dir):
    return constraints.broken_check(read(spark, sf_dir, "sellers"), "rating BETWEEN 3 AND 5").select("seller_id")


@registered("SELECT category_id, parent_category_id FROM categories WHERE parent_category_id IS NOT NULL AND parent_category_id NOT IN (SELECT category_id FROM categories WHERE category_id IS NOT NULL)")
def constraint_reference(spark, sf_dir):
    categories = read(spark, sf_dir, "categories")
    return constraints.broken_reference(categories, "parent_category_id", categories, "category_id").select("category_id", "parent_category_id")


@registered("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def orders_by_year(spark, sf_dir):
    """Over the orders as they are laid out by year: three years' folders are read."""

    def lay_out():
        path = scratch(spark)
        files.partition_by_year(read(spark, sf_dir, "orders"), "o_orderdate", path)
        return path

    orders = spark.read.parquet(once(spark, ("orders by year", sf_dir), lay_out)).where("year BETWEEN 1995 AND 1997")
    return orders.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


# Statistics, costs, plans


@registered(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS null_frac FROM products" for c in ("brand", "category_id", "seller_id", "price")
    )
)
def table_stats(spark, sf_dir):
    return statistics.column_statistics(read(spark, sf_dir, "products"), ["brand", "category_id", "seller_id", "price"], approximate=False)


@registered("SELECT p_type, count(*) FILTER (WHERE p_size < 25)::DOUBLE / count(*) AS selectivity FROM part GROUP BY 1")
def selectivity_actual(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_type").agg((F.count(F.when(F.col("p_size") < 25, 1)) / F.count(F.lit(1))).alias("selectivity"))


_GRID = "(SELECT r, k FROM (VALUES (0), (100), (10000), (20000), (100000), (5000000)) a(r), (VALUES (1), (10), (100)) b(k))"


def _grid(spark):
    rows = spark.createDataFrame([(r,) for r in (0, 100, 10_000, 20_000, 100_000, 5_000_000)], "r long")
    return rows.select("r", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))).alias("k"))


@registered(f"""SELECT r::BIGINT AS n, k, round(greatest(1, ceil(r / 40.0)) + r * 0.01, 4) AS seq_scan,
  round(greatest(1, floor(ln(greatest(r, 1)) / ln(200))) * 4.0 + k * 4.005, 4) AS index_scan, round(r * k * 0.0025::DOUBLE, 4) AS filter_cost FROM {_GRID}""")
def cost_grid_sql(spark, sf_dir):
    r, k = F.col("r"), F.col("k")
    seq, index = cost.seq_scan_column(r, F.lit(200)), cost.index_scan_column(r, k)
    return _grid(spark).select(r.alias("n"), k, F.round(seq, 4).alias("seq_scan"), F.round(index, 4).alias("index_scan"), F.round(r * k * F.lit(0.0025), 4).alias("filter_cost"))


@registered(f"""SELECT r::BIGINT AS n, k, CASE WHEN r <= 0 THEN 0 ELSE round(log2(greatest(r, 1)) * 16 + 40 + 40 * log2(k) * 0.1, 4) END AS hnsw,
  CASE WHEN r <= 0 THEN 0 ELSE round(10 + r * 10 / 100.0 + r * 10 / 100.0 * log2(k) * 0.1, 4) END AS ivfflat, round(r + r * log2(k) * 0.1, 4) AS brute_force FROM {_GRID}""")
def cost_grid_vector(spark, sf_dir):
    r, k = F.col("r"), F.col("k")
    return _grid(spark).select(
        r.alias("n"), k, F.round(cost.hnsw_column(r, k), 4).alias("hnsw"), F.round(cost.ivfflat_column(r, k), 4).alias("ivfflat"), F.round(cost.brute_force_column(r, k), 4).alias("brute_force")
    )


# Learned estimates

_ESTIMATES = "SELECT p_partkey, 1.0 / p_size AS predicted, (p_partkey % 97 + 1) / 100.0 AS actual FROM part"


@registered(f"""SELECT round(quantile_cont(q, 0.5), 6) AS median_q_error, round(quantile_cont(q, 0.95), 6) AS p95_q_error
FROM (SELECT greatest(p / (a + 1e-6), a / (p + 1e-6)) AS q FROM (SELECT predicted::DOUBLE AS p, actual::DOUBLE AS a FROM ({_ESTIMATES})))""")
def qerror_quantiles(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select((F.lit(1.0) / F.col("p_size")).alias("predicted"), ((F.col("p_partkey") % 97 + 1) / F.lit(100.0)).alias("actual"))
    return learned.error_report(rows).select(F.round("median_q_error", 6).alias("median_q_error"), F.round("p95_q_error", 6).alias("p95_q_error"))


@registered("""WITH g AS (SELECT p_brand, count(*) AS n, [count(DISTINCT p_type), count(DISTINCT p_size), 1] AS ndv, [0.0, 0.25, (min(p_size) % 10) / 100.0]::DOUBLE[] AS nulls, [min(p_size) / 100.0, 0.4]::DOUBLE[] AS joins FROM part GROUP BY 1)
SELECT p_brand, round(log10(n), 6) AS log_table_rows, round(log10(greatest(n / 1000.0, 0.1)), 6) AS log_table_size_mb, round(log10(10), 6) AS log_vector_k, round(list_avg(list_transform(ndv, lambda x: log10(x))), 6) AS avg_log_ndv,
  round(list_aggregate(list_transform(ndv, lambda x: log10(x)), 'stddev_pop'), 6) AS std_log_ndv, round(list_avg(nulls), 6) AS avg_null_frac, round(list_max(nulls), 6) AS max_null_frac, round(2 / 3.0, 6)::DOUBLE AS avg_has_index,
  round(list_avg(joins), 6) AS avg_join_sel, round(list_min(joins), 6) AS min_join_sel FROM g""")
def feature_vectors(spark, sf_dir):
    n = F.count(F.lit(1))
    grouped = read(spark, sf_dir, "part").groupBy("p_brand").agg(
        n.alias("table_row_count"), (n / 1000.0).alias("table_size_mb"), F.array(F.count_distinct("p_type"), F.count_distinct("p_size"), F.lit(1)).alias("num_distinct_values"),
        F.array(F.lit(0.0), F.lit(0.25), (F.min("p_size") % 10) / 100.0).alias("null_fraction"), F.array((F.min("p_size") / 100.0).cast("double"), F.lit(0.4).cast("double")).alias("join_selectivity_estimates"),
    )
    fixed = {"num_equality_predicates": 1, "num_range_predicates": 1, "num_like_predicates": 0, "min_histogram_selectivity": 0.1, "max_histogram_selectivity": 0.5, "avg_histogram_selectivity": 0.3, "vector_k": 10, "vector_table_ratio": 0.01, "num_joins": 1}
    full = grouped.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()], F.lit(True).alias("has_vector_search"), F.array(F.lit(True), F.lit(False), F.lit(True)).alias("has_index"))
    shown = ("log_table_rows", "log_table_size_mb", "log_vector_k", "avg_log_ndv", "std_log_ndv", "avg_null_frac", "max_null_frac", "avg_has_index", "avg_join_sel", "min_join_sel")
    return learned.feature_columns(full).select("p_brand", *[F.round(c, 6).alias(c) for c in shown])


@registered("""SELECT p_partkey, round(least(1.0, greatest(0.0, 0.3 * h + 0.5 * coalesce(m, h) + 0.2 * coalesce(s, h))), 6)::DOUBLE AS estimate
FROM (SELECT p_partkey, (1.0 / p_size)::DOUBLE AS h, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 100 / 40.0)::DOUBLE END AS m, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 10 / 10.0)::DOUBLE END AS s FROM part)""")
def ensemble_estimate(spark, sf_dir):
    key = F.col("p_partkey")
    estimate = learned.ensemble_column(F.lit(1.0) / F.col("p_size"), F.when(key % 7 > 0, key % 100 / 40.0), F.when(key % 5 > 0, key % 10 / 10.0))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(estimate, 6).alias("estimate"))


@registered()
def rf_selectivity(spark, sf_dir):
    """Trains on the actual selectivities of size ranges of every type of part, and predicts them back."""
    counts = read(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    model = learned.SelectivityModel(spark, "random_forest", trees=20, depth=8)
    for kind in sorted({r["p_type"] for r in counts}):
        for top in range(5, 51, 5):
            actual = sum(r["n"] for r in counts if r["p_type"] == kind and r["p_size"] < top) / total
            model.add(learned.QueryFeatures(total, num_equality_predicates=1, num_range_predicates=1, max_histogram_selectivity=top / 50, avg_histogram_selectivity=top / 300, num_distinct_values=(6, 50)), actual)
    model.train()
    rows = [f for f, _ in model.examples]
    found = list(zip([a for _, a in model.examples], model.predict(rows)))
    return spark.createDataFrame(found, "actual double, predicted double")


# Partitions and nodes

_MD5 = """((((('0x' || substr(m, 1, 8))::BIGINT % {n}) * (4294967296 % {n}) + ('0x' || substr(m, 9, 8))::BIGINT % {n}) % {n} * (4294967296 % {n}) + ('0x' || substr(m, 17, 8))::BIGINT % {n}) % {n}
  * (4294967296 % {n}) + ('0x' || substr(m, 25, 8))::BIGINT % {n}) % {n}"""


@registered(f"SELECT p_partkey, ({_MD5.format(n=7)})::INTEGER AS partition FROM (SELECT p_partkey, md5(p_partkey::VARCHAR) AS m FROM part)")
def hash_partition_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", hash_id(F.col("p_partkey"), 7).alias("partition"))


@registered("SELECT o_orderkey, (o_orderkey % 5)::INTEGER AS partition FROM orders")
def range_partition_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", range_id(F.col("o_orderkey"), 5).alias("partition"))


@registered("SELECT r_regionkey, 0 AS partition FROM region")
def list_partition_ids(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", partition_id(F.col("r_regionkey"), 4, "list").alias("partition"))


@registered(f"""WITH m AS (SELECT o_orderkey, o_custkey, md5(o_custkey::VARCHAR) AS m FROM orders), p AS (SELECT o_orderkey, o_custkey, ({_MD5.format(n=8)})::INTEGER AS partition FROM m)
SELECT o_orderkey, o_custkey, partition FROM p WHERE partition = (SELECT ({_MD5.format(n=8)})::INTEGER FROM (SELECT md5('37') AS m))""")
def pruned_scan(spark, sf_dir):
    """Over the orders as they are laid out by their customers' hash: one of eight folders is read."""
    layout = distributed.Partitioning("o_custkey", 8)

    def lay_out():
        path = scratch(spark)
        layout.write(read(spark, sf_dir, "orders"), path)
        return path

    return layout.read(spark, once(spark, ("orders by customer", sf_dir), lay_out), {"o_custkey": ("=", 37)}).select("o_orderkey", "o_custkey", "partition")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37")
def pruned_lookup(spark, sf_dir):
    """Over a table without a layout the condition itself reaches the files, and ids are computed for its rows only."""
    layout = distributed.Partitioning("o_custkey", 8)
    return layout.scan(read(spark, sf_dir, "orders"), {"o_custkey": ("=", 37)}, "o_custkey = 37").select("o_orderkey", "o_totalprice")


_NODES = [("n1", "a", 1, True, 0.1), ("n2", "b", 2, True, 0.2), ("n3", "c", 3, False, 0.0)]
_PARTS = [("t_0", "t", "k", 100, 1.5, "n1"), ("t_1", "t", "k", 200, 2.5, "n2"), ("t_2", "t", "k", 300, 3.0, "n1"), ("u_0", "u", "k", 50, 0.5, "n2")]


@registered("SELECT * FROM (VALUES ('n1', true, 2::BIGINT, 400::BIGINT, 4.5::DOUBLE), ('n2', true, 2, 250, 3.0), ('n3', false, 0, 0, 0.0)) v(node_id, is_active, n_partitions, total_rows, total_mb)")
def cluster_status(spark, sf_dir):
    cluster = distributed.Cluster(spark, list(_NODES), list(_PARTS))
    return distributed.cluster_status(cluster.node_table(), cluster.partition_table())


@registered("SELECT 600::BIGINT AS total_rows")
def table_size(spark, sf_dir):
    return distributed.table_rows(distributed.Cluster(spark, list(_NODES), list(_PARTS)).partition_table(), "t")


@registered("SELECT l_orderkey, l_linenumber, 'R' AS part FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, 'A' FROM lineitem WHERE l_returnflag = 'A'")
def scatter_gather_union(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return distributed.gather([lines.where(F.col("l_returnflag") == f).select("l_orderkey", "l_linenumber", F.lit(f).alias("part")) for f in ("R", "A")])


# Hierarchies

_P3_SQL = """
WITH RECURSIVE raw AS (SELECT DISTINCT category_id AS id, parent_category_id AS parent FROM categories WHERE category_id IS NOT NULL),
n AS (SELECT id, min(CASE WHEN parent IN (SELECT id FROM raw) THEN parent END) AS parent FROM raw GROUP BY id),
w(id, cur, walk) AS (
  SELECT id, id, [id] FROM n
  UNION ALL
  SELECT w.id, n.parent, list_append(w.walk, n.parent) FROM w JOIN n ON n.id = w.cur WHERE n.parent IS NOT NULL AND NOT list_contains(w.walk, n.parent)
),
f AS (SELECT id, max_by(walk, len(walk)) AS walk FROM w GROUP BY id),
e AS (SELECT f.id, f.walk, n.parent AS again, list_position(f.walk, n.parent) AS pos FROM f JOIN n ON n.id = f.walk[len(f.walk)]),
d AS (SELECT anc, count(*) AS c FROM (SELECT id, unnest(walk) AS anc FROM f) WHERE anc <> id GROUP BY anc)
SELECT e.id::INTEGER AS category_id,
  (CASE WHEN again IS NULL THEN walk[len(walk)] ELSE list_min(walk[pos:]) END)::INTEGER AS root_id,
  (CASE WHEN again IS NULL THEN len(walk) - 1 ELSE pos - 1 END)::INTEGER AS depth,
  array_to_string(list_reverse(CASE WHEN again IS NULL THEN walk ELSE walk[:pos] END), '/') AS path,
  coalesce(d.c, 0)::INTEGER AS n_descendants,
  (CASE WHEN again IS NULL THEN 0 ELSE 1 END)::INTEGER AS in_loop
FROM e LEFT JOIN d ON d.anc = e.id
"""


@registered(_P3_SQL)
def p3_found(spark, sf_dir):
    full = expand_hierarchy(read(spark, sf_dir, "categories"), "category_id", "parent_category_id")
    ints = [F.col(c).cast("int").alias(c) for c in ("root_id", "depth")]
    return full.select(F.col("id").cast("int").alias("category_id"), *ints, "path", F.col("n_descendants").cast("int").alias("n_descendants"), "in_loop")


@registered(_P3_SQL[: _P3_SQL.index("d AS (")].rstrip().rstrip(",") + """
SELECT a.anc::BIGINT AS category_id, f.id::BIGINT AS descendant FROM (SELECT id, unnest(walk) AS anc FROM f) a JOIN f USING (id) JOIN e ON e.id = a.id WHERE a.anc <> a.id AND e.again IS NULL""")
def p3_descendants(spark, sf_dir):
    """Every pair of a category and one below it, of the trees that hang on no circle."""
    full = written(expand_hierarchy(read(spark, sf_dir, "categories"), "category_id", "parent_category_id").where("in_loop = 0"))
    return descendants(full, full).select(F.col("id").alias("category_id"), "descendant")


@registered(_P3_SQL[: _P3_SQL.index("e AS (")].rstrip().rstrip(",") + """
SELECT a.anc::BIGINT AS category_id, a.id::BIGINT AS descendant FROM (SELECT id, unnest(walk) AS anc FROM f) a WHERE a.anc <> a.id""")
def p3_all_descendants(spark, sf_dir):
    """Every pair of a category and one below it, circles and what hangs on them included."""
    full = written(expand_hierarchy(read(spark, sf_dir, "categories"), "category_id", "parent_category_id"))
    return descendants(full, full).select(F.col("id").alias("category_id"), "descendant")
