"""The queries about files, layouts, logs, constraints and the cluster's metadata, with their SQL."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from tessela.functions.partition_ids import literal_id
from tessela.operators import constraints, distributed, explain, layouts
from tessela.plans import learned
from tessela.registry import registered
from tessela.runtime import once, read, scratch
from tessela.sources import catalogs, files, generator
from tessela.streaming import execution_log

# Files


@registered("SELECT 'csv' AS kind, p_partkey::BIGINT AS p_partkey, p_name FROM part UNION ALL SELECT 'parquet', p_partkey, p_name FROM part")
def exported_files(spark, sf_dir):
    """A table written as Parquet and as CSV without its vectors, and read again by the suffixes of the paths."""
    path = scratch(spark)
    files.export(read(spark, sf_dir, "part").join(read(spark, sf_dir, "embeddings"), F.col("p_partkey") == F.col("vec_id"), "left").select("p_partkey", "p_name", "embedding"), path)
    schema = "p_partkey long, p_name string"
    as_csv = spark.read.schema(schema).option("header", True).csv(f"{path}/csv")
    as_parquet = files.load(spark, f"{path}/parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    return as_csv.select(F.lit("csv").alias("kind"), "*").unionByName(as_parquet.select(F.lit("parquet").alias("kind"), "*"))


@registered("SELECT * FROM (VALUES (1, 'a', 2::BIGINT), (2, 'b', 0), (3, NULL, NULL)) v(id, name, size)")
def inserted_rows(spark, sf_dir):
    """Rows appended in two batches; an empty batch writes nothing."""
    path, schema = scratch(spark), "id int, name string, v array<float>"
    files.insert_rows(spark, [{"id": 1, "name": "a", "v": [1.0, 2.0]}, {"id": 2, "name": "b", "v": []}], schema, path)
    files.insert_rows(spark, [], schema, path)
    files.insert_rows(spark, [{"id": 3, "name": None, "v": None}], schema, path)
    return files.load(spark, path).select("id", "name", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("size"))


@registered("SELECT p_brand AS name, count(*) AS n, 'json' AS kind FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*), 'csv' FROM part GROUP BY 1")
def report_files(spark, sf_dir):
    """A small report as JSON and as CSV, read again. Reports are written by the driver, into a folder of its own."""
    import csv
    import tempfile

    results = [r.asDict() for r in read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()]
    with tempfile.TemporaryDirectory() as folder:
        as_json, as_csv = files.write_report(results, folder)
        with open(as_json) as f:
            rows = [(r["name"], r["n"], "json") for r in json.load(f)]
        with open(as_csv, newline="") as f:
            rows += [(r["name"], int(r["n"]), "csv") for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "name string, n long, kind string")


@registered("SELECT * FROM (VALUES ('random_page_cost', '1.5'), ('seq_scan_cost', '1.0'), ('enable_hybrid', 'True'), ('enable_filter_first', 'True')) v(setting, value)")
def settings(spark, sf_dir):
    """Given settings replace defaults, unknown ones are ignored, the rest stay."""
    config = files.planner_config({"cost_model": {"random_page_cost": 1.5, "no_such_cost": 9}, "optimizer": {"enable_hybrid": True, "no_such_flag": 1}})
    told = [("random_page_cost", config.cost.random_page_cost), ("seq_scan_cost", config.cost.seq_scan_cost), ("enable_hybrid", config.enable_hybrid), ("enable_filter_first", config.enable_filter_first)]
    return spark.createDataFrame([(k, str(v)) for k, v in told], "setting string, value string")


def _uniform_sql(salt: str, seed: int = 42) -> str:
    return f"((('0x' || substr(md5('{seed}:' || id || ':' || {salt}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def _normal_sql(salt: str) -> str:
    return f"sqrt(-2 * ln({_uniform_sql(salt)})) * cos({_uniform_sql(salt + ' || chr(39)')} * 2 * pi())"


def _pick_sql(values: tuple[str, ...], salt: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][floor({_uniform_sql(repr(salt))} * {len(values)})::INTEGER + 1]"


@registered(f"""SELECT id::INTEGER AS id, {_pick_sql(generator.BRANDS, 'brand')} AS brand, {_pick_sql(generator.CATEGORIES, 'category')} AS category, round(exp(6 + {_normal_sql("'price'")}), 2) AS price,
  floor({_uniform_sql("'reviews'")} * 5000)::INTEGER AS num_reviews, {_uniform_sql("'stock'")} < 0.9 AS in_stock, round(list_sort([{', '.join(_uniform_sql(repr(f'rating{i}')) for i in range(9))}])[8] * 5, 2) AS rating,
  32 AS dimension, true AS of_length_one FROM range(1000) r(id)""")
def generated_products(spark, sf_dir):
    made = generator.products(spark, 1_000, 32)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("id", "brand", "category", "price", "num_reviews", "in_stock", "rating", F.size("embedding").alias("dimension"), (F.abs(length - 1) < 1e-5).alias("of_length_one"))


# Index catalogue and layouts


@registered("""SELECT * FROM (VALUES ('t.v', 'hnsw', 'm', 32), ('t.v', 'hnsw', 'ef_construction', 64), ('t.w', 'ivfflat', 'lists', 100), ('u.v', 'hnsw', 'm', 16), ('u.v', 'hnsw', 'ef_construction', 200)) v(index_on, index_type, parameter, value)""")
def index_catalog(spark, sf_dir):
    registry = catalogs.IndexRegistry()
    registry.register("t", "v", "hnsw", "USING hnsw (v) WITH (m = '32')")
    registry.register("t", "w", "ivfflat")
    registry.register("u", "v", "hnsw", ef_construction=200)
    rows = []
    for table, column in (("t", "v"), ("t", "w"), ("u", "v"), ("u", "none")):
        entry = registry.stats(table, column)
        rows += [(f"{table}.{column}", entry["index_type"], k, v) for k, v in entry.items() if k != "index_type"]
    return spark.createDataFrame(rows, "index_on string, index_type string, parameter string, value int")


@registered("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 3 AND l_partkey BETWEEN 10 AND 90")
def composite_index_scan(spark, sf_dir):
    """Over files that are sorted by (l_suppkey, l_partkey), of which the predicate reads those whose range it meets."""

    def lay_out():
        path = scratch(spark)
        layouts.write_sorted(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), path, ["l_suppkey", "l_partkey"])
        return path

    rows = spark.read.parquet(once(spark, ("lines sorted", sf_dir), lay_out))
    return rows.where("l_suppkey = 3 AND l_partkey BETWEEN 10 AND 90").select("l_orderkey", "l_linenumber", "l_partkey")


@registered("""WITH t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM images), c AS (SELECT tag FROM t WHERE tag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 2)
SELECT t.id FROM t JOIN c USING (tag) GROUP BY 1 HAVING count(DISTINCT tag) = 2""")
def posting_lists(spark, sf_dir):
    """The images that carry both of the two most frequent tags, from the tags' posting lists."""

    def lay_out():
        path = scratch(spark)
        layouts.write_postings(read(spark, sf_dir, "images"), path, "id", "tags")
        return path

    path = once(spark, ("tag postings", sf_dir), lay_out)
    top = spark.read.parquet(path).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(2).collect()
    return layouts.holding(spark, path, [r["value"] for r in top])


@registered("""SELECT 'Scan parquet' AS operator, count(*) AS n_rows FROM part UNION ALL SELECT 'Filter', count(*) FROM part WHERE p_size < 25 AND p_type IS NOT NULL
UNION ALL SELECT 'HashAggregate', count(DISTINCT p_type) FROM part WHERE p_size < 25""")
def explain_analyze(spark, sf_dir):
    """The rows that a scan, a filter and a final aggregate gave when the query ran."""
    query = read(spark, sf_dir, "part").where("p_size < 25 AND p_type IS NOT NULL").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    told = explain.analyze(query).withColumn("operator", F.regexp_replace("operator", "Scan parquet.*", "Scan parquet")).where("n_rows IS NOT NULL AND operator IN ('Scan parquet', 'Filter', 'HashAggregate')")
    return told.groupBy("operator").agg(F.min_by("n_rows", "no").alias("n_rows"))


# Logs


def _runs() -> list[tuple]:
    at = dt.datetime(2024, 1, 1)
    kinds = ("filter_first", "vector_first", "hybrid")
    return [(f"h{i % 8}", f"query {i % 8}", kinds[i % 3], Decimal(i) / 4, Decimal(10 + i * 7 % 40), i * 13 % 90, at + dt.timedelta(minutes=17 * i)) for i in range(60)]


_RUNS = """(SELECT 'h' || (i % 8) AS query_hash, ['filter_first', 'vector_first', 'hybrid'][i % 3 + 1] AS plan_type, i / 4.0::DOUBLE AS cost, (10 + i * 7 % 40)::DOUBLE AS ms, i * 13 % 90 AS n, TIMESTAMP '2024-01-01' + to_minutes((17 * i)::INTEGER) AS run_at FROM range(60) r(i))"""


@registered(f"SELECT plan_type, count(*) AS runs, round(avg(ms), 4) AS mean_ms, sum(n)::BIGINT AS n_rows, max(run_at) AS last_run FROM {_RUNS} GROUP BY 1")
def execution_log_summary(spark, sf_dir):
    """The log is appended to twice and read as one table."""
    path, runs = scratch(spark), _runs()
    catalogs.append_log(spark, path, runs[:25])
    catalogs.append_log(spark, path, runs[25:])
    log = catalogs.read_log(spark, path)
    return log.groupBy("plan_type").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("actual_runtime_ms").cast("double")), 4).alias("mean_ms"), F.sum("rows_returned").alias("n_rows"), F.max("executed_at").alias("last_run")
    )


@registered(f"""SELECT plan_type, date_trunc('hour', run_at)::TIMESTAMP AS hour, count(*) AS runs, round(avg(ms), 4) AS mean_ms FROM {_RUNS}
WHERE date_trunc('hour', run_at) + INTERVAL 1 HOUR <= (SELECT max(run_at) - INTERVAL 10 MINUTE FROM {_RUNS}) GROUP BY 1, 2""")
def execution_log_stream(spark, sf_dir):
    """The same log as a stream: hourly windows that the watermark has closed."""
    path, out = scratch(spark), scratch(spark)
    catalogs.append_log(spark, path, _runs())
    summary = execution_log.runtime_by_plan(execution_log.log_stream(spark, path))
    execution_log.start(summary, out, scratch(spark)).awaitTermination(120)
    hour = F.col("window.start").cast("timestamp_ntz").alias("hour")
    return spark.read.parquet(out).select("plan_type", hour, "runs", F.round(F.col("avg_runtime_ms").cast("double"), 4).alias("mean_ms"))


@registered("SELECT 'part' AS table_name, 'by_size' AS index_name, count(*)::INTEGER AS num_rows, count(DISTINCT p_size)::INTEGER AS num_distinct_values, 2.5::DOUBLE AS avg_search_time_ms FROM part")
def index_statistics(spark, sf_dir):
    """Statistics of an index as they are logged, the newest row counting."""
    part, path = read(spark, sf_dir, "part"), scratch(spark)
    now = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_size").alias("d")).first()
    for day, rows, spent in ((1, 7, "9.5"), (2, now["n"], "2.5")):
        catalogs.append_statistics(spark, path, [("part", "by_size", "btree", rows, now["d"], 100, 4096, Decimal(spent), dt.datetime(2024, 1, day))])
    return catalogs.latest_statistics(spark, path).select("table_name", "index_name", "num_rows", "num_distinct_values", F.col("avg_search_time_ms").cast("double").alias("avg_search_time_ms"))


@registered(f"SELECT query_hash, round(avg(n) / 100.0::DOUBLE, 6) AS actual FROM {_RUNS} GROUP BY 1")
def training_examples(spark, sf_dir):
    """What the log says about the selectivities of the queries that ran, as a model takes it."""
    path = scratch(spark)
    catalogs.append_log(spark, path, _runs())
    names = ", ".join(f"{n} {t}" for n, t in _FEATURE_TYPES)
    asked = spark.createDataFrame([(f"h{i}", *[v for _, v in sorted(_features(i).items(), key=lambda x: _ORDER[x[0]])]) for i in range(9)], f"query_hash string, {names}")
    observed = catalogs.observed_selectivities(catalogs.read_log(spark, path), asked)
    model = learned.SelectivityModel(spark)
    model.learn_from(observed)
    told = {f.num_range_predicates: a for f, a in model.examples}
    return spark.createDataFrame([(f"h{i}", round(a, 6)) for i, a in told.items()], "query_hash string, actual double")


_FEATURE_TYPES = (
    ("table_row_count", "long"), ("table_size_mb", "double"), ("num_equality_predicates", "int"), ("num_range_predicates", "int"), ("num_like_predicates", "int"), ("min_histogram_selectivity", "double"),
    ("max_histogram_selectivity", "double"), ("avg_histogram_selectivity", "double"), ("num_distinct_values", "array<int>"), ("null_fraction", "array<double>"), ("has_index", "array<boolean>"),
    ("has_vector_search", "boolean"), ("vector_k", "int"), ("vector_table_ratio", "double"), ("num_joins", "int"), ("join_selectivity_estimates", "array<double>"),
)
_ORDER = {n: i for i, (n, _) in enumerate(_FEATURE_TYPES)}


def _features(i: int) -> dict:
    plain = {"long": 100, "double": 0.5, "int": 1, "boolean": False}
    return {n: [] if t.startswith("array") else plain[t] for n, t in _FEATURE_TYPES} | {"num_range_predicates": i}


# Constraints and nodes


@registered("SELECT product_id, description IS NULL AS lacks_description, brand IS NULL AS lacks_brand FROM products WHERE description IS NULL OR brand IS NULL")
def constraint_not_null(spark, sf_dir):
    broken = constraints.broken_not_null(read(spark, sf_dir, "products").select("product_id", "description", "brand"), ["description", "brand"])
    return broken.select("product_id", F.col("description").isNull().alias("lacks_description"), F.col("brand").isNull().alias("lacks_brand"))


@registered("SELECT product_id, seller_id FROM products WHERE seller_id IS NULL OR seller_id NOT IN (SELECT seller_id FROM sellers WHERE rating < 4)")
def cascaded_delete(spark, sf_dir):
    """The listings that stay when the sellers of low rating go."""
    gone = read(spark, sf_dir, "sellers").where("rating < 4")
    return constraints.cascade_delete(read(spark, sf_dir, "products").select("product_id", "seller_id"), "seller_id", gone, "seller_id")


_NODES = [("n1", "a", 1, True, 0.1), ("n2", "b", 2, True, 0.2), ("n3", "c", 3, False, 0.0)]
_PARTS = [(f"t_{i}", "t", "k", 10 * i, 1.0, f"n{i % 3 + 1}") for i in range(6)]


@registered("SELECT * FROM (VALUES ('all', 'n1', 't_0'), ('all', 'n1', 't_3'), ('all', 'n2', 't_1'), ('all', 'n2', 't_4'), ('one', 'n2', 't_4'), ('absent', 'n1', 't_0'), ('absent', 'n1', 't_3'), ('absent', 'n2', 't_1'), ('absent', 'n2', 't_4')) v(asked, node_id, partition_id)")
def partitions_by_node(spark, sf_dir):
    """The partitions that a query goes to, by their active owners; what an inactive node holds isn't asked for."""
    cluster = distributed.Cluster(spark, list(_NODES), list(_PARTS))
    asked = {"all": None, "one": [4], "absent": [77], "inactive": [2]}
    rows = [(name, node, part) for name, ids in asked.items() for node, parts in cluster.by_node(cluster.target_partitions("t", ids)).items() for part in parts]
    return spark.createDataFrame(rows, "asked string, node_id string, partition_id string")


@registered("""WITH k AS (SELECT o_custkey AS k, md5(o_custkey::VARCHAR) AS m FROM orders WHERE o_orderkey % 10 = 1 GROUP BY 1)
SELECT k::BIGINT AS key, ('0x' || substr(m, 32, 1))::INTEGER % 8 AS target FROM k""")
def partition_targets(spark, sf_dir):
    """The one partition that an equality on the key goes to; of eight, the last hexadecimal digit of the md5 tells it."""
    keys = [r[0] for r in read(spark, sf_dir, "orders").where("o_orderkey % 10 = 1").select("o_custkey").distinct().collect()]
    layout = distributed.Partitioning("o_custkey", 8)
    rows = [(int(k), layout.targets({"o_custkey": ("=", k)})[0]) for k in keys]
    assert all(t == literal_id(k, 8) for k, t in rows)
    return spark.createDataFrame(rows, "key long, target int")
