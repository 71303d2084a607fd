"""The queries about costs, plans and learned estimates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessela.functions import distance
from tessela.operators import relational
from tessela.plans import cost, learned
from tessela.plans.ir import HybridQuery, Predicate, TableStats, VectorOp
from tessela.plans.planner import Planner, PlannerConfig
from tessela.registry import registered
from tessela.runtime import read

# Choices of the cost model, over small grids


@registered("""SELECT * FROM (VALUES ('equality', 50, 0.02::DOUBLE), ('equality', 0, 0.005), ('range', 0, 0.1), ('like', 0, 0.05), ('in', 100, 0.1), ('in', 0, 0.1), ('other', 0, 0.1),
('range 0.3', 0, 0.3), ('range 7', 0, 1.0), ('range -1', 0, 0.0)) v(kind, n_distinct, selectivity)""")
def cost_selectivity(spark, sf_dir):
    model = cost.SqlCost()
    asked = [("equality", 50), ("equality", 0), ("range", 0), ("like", 0), ("in", 100), ("in", 0), ("other", 0), ("range 0.3", 0), ("range 7", 0), ("range -1", 0)]
    rows = []
    for kind, distinct in asked:
        name, _, span = kind.partition(" ")
        rows.append((kind, distinct, round(model.selectivity(name, distinct or None, float(span) if span else None), 6)))
    return spark.createDataFrame(rows, "kind string, n_distinct int, selectivity double")


_SHARES = (0.0, 0.001, 0.01, 0.05, 0.1, 0.5, 0.9, 1.0)
_SIZES = (0, 1000, 100_000, 5_000_000)
_CHOICES = f"(SELECT r, s FROM (VALUES {', '.join(f'({r})' for r in _SIZES)}) a(r), (VALUES {', '.join(f'({s}::DOUBLE)' for s in _SHARES)}) b(s))"
_INDEX = "greatest(1, floor(ln(greatest(r, 1)) / ln(200))) * 4.0 + floor(r * s) * 4.005"
_SCAN = "greatest(1, ceil(r / 40.0)) + r * 0.01 + r * 2 * 0.0025"


@registered(f"""SELECT r::BIGINT AS n, s AS selectivity, i AS indexed, CASE WHEN i AND {_INDEX} < {_SCAN} THEN 'indexscan' ELSE 'seqscan' END AS method,
  round(CASE WHEN i AND {_INDEX} < {_SCAN} THEN {_INDEX} ELSE {_SCAN} END, 4)::DOUBLE AS cost FROM {_CHOICES}, (VALUES (true), (false)) c(i)""")
def cost_best_scan(spark, sf_dir):
    model = cost.SqlCost()
    rows = [(r, s, i, *model.best_scan(r, 200, s, 2, i)) for r in _SIZES for s in _SHARES for i in (True, False)]
    return spark.createDataFrame([(*x[:4], round(x[4], 4)) for x in rows], "n long, selectivity double, indexed boolean, method string, cost double")


def _search_sql(rows: str, k: str) -> str:
    """The cost of a graph search, of probed lists and of all rows, in the order of the index types below."""
    log_k = f"log2(greatest({k}, 1)) * 0.1"
    graph = f"CASE WHEN {rows} <= 0 THEN 0 ELSE log2(greatest({rows}, 1)) * 16 + 40 + 40 * {log_k} END"
    lists = f"CASE WHEN {rows} <= 0 THEN 0 ELSE 10 + {rows} / 10.0 + {rows} / 10.0 * {log_k} END"
    return f"CASE t WHEN 'hnsw' THEN {graph} WHEN 'ivfflat' THEN {lists} ELSE {rows} + {rows} * {log_k} END"


_TYPES = "(VALUES ('hnsw'), ('ivfflat'), ('none')) c(t)"
_LEFT, _WANTED = "floor(r * s)", "(CASE WHEN s <= 0 THEN r ELSE least(floor(10 / s * 1.5), r) END)"


def _choices(spark, compute, schema):
    model = cost.VectorCost()
    return spark.createDataFrame([(r, s, t, *compute(model, r, s, t)) for r in _SIZES for s in _SHARES for t in ("hnsw", "ivfflat", "none")], "n long, selectivity double, index_type string, " + schema)


@registered(f"SELECT r::BIGINT AS n, s AS selectivity, t AS index_type, round({_search_sql(_LEFT, '10')}, 4)::DOUBLE AS cost, {_LEFT}::BIGINT AS candidates FROM {_CHOICES}, {_TYPES}")
def cost_filtered_search(spark, sf_dir):
    def compute(model, r, s, t):
        spent, left = model.filtered(r, s, 10, t)
        return round(spent, 4), left

    return _choices(spark, compute, "cost double, candidates long")


@registered(f"SELECT r::BIGINT AS n, s AS selectivity, t AS index_type, round({_search_sql('r', _WANTED)} + {_WANTED} * 0.0025, 4)::DOUBLE AS cost, {_WANTED}::BIGINT AS candidates FROM {_CHOICES}, {_TYPES}")
def cost_search_then_filter(spark, sf_dir):
    def compute(model, r, s, t):
        spent, wanted = model.search_then_filter(r, s, 10, t)
        return round(spent, 4), wanted

    return _choices(spark, compute, "cost double, candidates long")


@registered(f"""SELECT r::BIGINT AS n, s AS selectivity, t AS index_type, CASE WHEN {_search_sql(_LEFT, '10')} < {_search_sql('r', _WANTED)} + {_WANTED} * 0.0025 THEN 'filter_first' ELSE 'vector_first' END AS plan_type
FROM {_CHOICES}, {_TYPES}""")
def cost_recommended(spark, sf_dir):
    return _choices(spark, lambda model, r, s, t: (model.recommend(r, s, 10, t),), "plan_type string")


# Planning scenarios

SCENARIOS = {
    "high_selectivity": (("brand", "=", "Apple", 0.02), ("price", "<", 500, 0.30)),
    "medium_selectivity": (("category", "=", "Laptops", 0.10),),
    "low_selectivity": (("price", "<", 2000, 0.80),),
    "no_filter": (),
    "multiple_filters": (("brand", "=", "Samsung", 0.02), ("price", "<", 800, 0.40), ("rating", ">", 4.0, 0.60)),
}


SCENARIO_STATS = TableStats(100_000, 250, distinct={"brand": 50, "category": 10}, indexed_columns=frozenset({"brand", "price", "category", "rating"}))


def scenario_planner() -> Planner:
    return Planner(PlannerConfig(cost=cost.CostConfig(random_page_cost=1.5, vector_distance_cost=10.0, vector_comparison_cost=1.0)))


def scenario_rows() -> list[tuple]:
    """(query, plan_type, cost, chosen) of the planning scenarios: 100,000 rows of 250 bytes, top 10."""
    planner, stats = scenario_planner(), SCENARIO_STATS
    out = []
    for name, predicates in SCENARIOS.items():
        query = HybridQuery(VectorOp("embedding", (1.0,), 10), tuple(Predicate(c, o, v, selectivity=s) for c, o, v, s in predicates))
        plans = planner.plans(query, stats)
        best = planner.best(plans, stats)
        out += [(name, p.plan_type.value, round(p.estimated_cost, 2), p is best) for p in plans]
    return out


_PLAN_COSTS = """(VALUES ('high_selectivity', 'filter_first', 2918.49::DOUBLE, true), ('high_selectivity', 'vector_first', 3487.07, false), ('medium_selectivity', 'filter_first', 17736.91, false),
('medium_selectivity', 'vector_first', 3347.07, true), ('low_selectivity', 'filter_first', 123741.91, false), ('low_selectivity', 'vector_first', 3224.38, true), ('no_filter', 'vector_first', 3190.42, true),
('multiple_filters', 'filter_first', 2684.99, true), ('multiple_filters', 'vector_first', 3490.82, false)) v(query, plan_type, cost, chosen)"""


@registered(f"SELECT * FROM {_PLAN_COSTS}")
def plan_costs(spark, sf_dir):
    return spark.createDataFrame(scenario_rows(), "query string, plan_type string, cost double, chosen boolean")


@registered(f"""SELECT max(CASE WHEN chosen THEN plan_type END) AS best_plan, query, round(max(cost) / min(cost), 2) AS speedup FROM {_PLAN_COSTS} GROUP BY query""")
def plan_report(spark, sf_dir):
    rows = spark.createDataFrame(scenario_rows(), "query string, plan_type string, cost double, chosen boolean")
    return rows.groupBy("query").agg(F.max(F.when(F.col("chosen"), F.col("plan_type"))).alias("best_plan"), F.round(F.max("cost") / F.min("cost"), 2).alias("speedup"))


EXPECTED = {"high_selectivity": "filter_first", "medium_selectivity": "depends", "low_selectivity": "vector_first", "no_filter": "vector_first", "multiple_filters": "filter_first"}


@registered(f"""WITH b AS (SELECT query, max(CASE WHEN chosen THEN plan_type END) AS best, max(cost) / min(cost) AS speedup FROM {_PLAN_COSTS} GROUP BY query),
e AS (SELECT * FROM (VALUES ('high_selectivity', 'filter_first'), ('medium_selectivity', 'depends'), ('low_selectivity', 'vector_first'), ('no_filter', 'vector_first'), ('multiple_filters', 'filter_first')) v(query, expected))
SELECT count(*) AS queries, round(avg(speedup), 2) AS mean_speedup, round(max(speedup), 2) AS max_speedup, sum(CASE WHEN expected IN (best, 'depends') THEN 1 ELSE 0 END)::BIGINT AS correct,
  avg(CASE WHEN expected IN (best, 'depends') THEN 1.0 ELSE 0.0 END)::DOUBLE AS correct_share FROM b JOIN e USING (query)""")
def plan_summary(spark, sf_dir):
    told = spark.createDataFrame(list(EXPECTED.items()), "query string, expected string")
    rows = spark.createDataFrame(scenario_rows(), "query string, plan_type string, cost double, chosen boolean")
    best = rows.groupBy("query").agg(F.max(F.when(F.col("chosen"), F.col("plan_type"))).alias("best"), (F.max("cost") / F.min("cost")).alias("speedup")).join(told, "query")
    right = F.col("expected").isin("depends") | (F.col("expected") == F.col("best"))
    return best.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("speedup"), 2).alias("mean_speedup"), F.round(F.max("speedup"), 2).alias("max_speedup"),
        F.sum(right.cast("long")).alias("correct"), F.avg(right.cast("double")).alias("correct_share"),
    )


@registered(f"SELECT plan_type AS best_plan, count(*) AS n FROM {_PLAN_COSTS} WHERE chosen GROUP BY 1")
def plan_counts(spark, sf_dir):
    rows = spark.createDataFrame(scenario_rows(), "query string, plan_type string, cost double, chosen boolean")
    return rows.where("chosen").groupBy(F.col("plan_type").alias("best_plan")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@registered("""SELECT * FROM (VALUES
(1, 'Plan plan_0 (filter_first), estimated cost 2918.49'), (2, '  1. indexscan filter: brand = Apple AND price < 500: 100000 -> 600 rows'), (3, '  2. top 10 by cosine (hnsw): 600 -> 10 rows'), (4, 'Expected rows: 10')) v(line, text)""")
def plan_explain(spark, sf_dir):
    planner, stats = scenario_planner(), SCENARIO_STATS
    query = HybridQuery(VectorOp("embedding", (1.0,), 10), tuple(Predicate(c, o, v, selectivity=s) for c, o, v, s in SCENARIOS["high_selectivity"]))
    text = planner.explain(planner.choose(query, stats), stats)
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line int, text string")


# Learned estimates beyond their formulas


@registered("""SELECT p_brand, greatest(1, floor(count(*) * (min(p_size) / 60.0)))::BIGINT AS cardinality FROM part GROUP BY 1""")
def learned_cardinality(spark, sf_dir):
    """An untrained model falls back to the histogram's estimate; a cardinality is at least 1."""
    model = learned.SelectivityModel(spark)
    rows = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), (F.min("p_size") / 60.0).alias("share"))
    told = [(r["p_brand"], model.cardinality(learned.QueryFeatures(r["n"], avg_histogram_selectivity=float(r["share"])), r["n"])) for r in rows.collect()]
    return spark.createDataFrame(told, "p_brand string, cardinality long")


@registered("""WITH q AS (SELECT 'histogram' AS estimator, quantile_cont(greatest(0.25::DOUBLE / (a + 1e-6), a / (0.25::DOUBLE + 1e-6)), 0.5) AS m FROM (SELECT p_size / 50.0::DOUBLE AS a FROM part)
  UNION ALL SELECT 'ml', quantile_cont(greatest(p / (a + 1e-6), a / (p + 1e-6)), 0.5) FROM (SELECT p_size / 50.0::DOUBLE AS a, (p_size + p_partkey % 5) / 50.0::DOUBLE AS p FROM part)),
w AS (SELECT estimator, 1 / greatest(m, 0.1) AS w FROM q UNION ALL SELECT 'sampling', 0.2::DOUBLE)
SELECT estimator, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def ensemble_feedback(spark, sf_dir):
    """Two estimators are heard of; the third keeps its weight until all are scaled."""
    actual = F.col("p_size") / F.lit(50.0)
    learnt = (F.col("p_size") + F.col("p_partkey") % 5) / F.lit(50.0)
    medians = read(spark, sf_dir, "part").agg(F.percentile(learned.q_errors(F.lit(0.25), actual), 0.5).alias("histogram"), F.percentile(learned.q_errors(learnt, actual), 0.5).alias("ml")).first()
    ensemble = learned.Ensemble()
    ensemble.feedback({name: [medians[name]] for name in ("histogram", "ml")})
    return spark.createDataFrame([(k, round(v, 6)) for k, v in ensemble.weights.items()], "estimator string, weight double")


_ALL_FEATURES = ", ".join(f"('{n}')" for n in learned.FEATURES)


def _observed(spark, sf_dir) -> list[tuple[learned.QueryFeatures, float]]:
    """The actual selectivities of size ranges of every type of part."""
    counts = read(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    out = []
    for kind in sorted({r["p_type"] for r in counts}):
        for top in range(3, 52, 4):
            actual = sum(r["n"] for r in counts if r["p_type"] == kind and r["p_size"] < top) / total
            out.append((learned.QueryFeatures(total, num_equality_predicates=1, num_range_predicates=1, max_histogram_selectivity=top / 50, avg_histogram_selectivity=top / 300, num_distinct_values=(6, 50)), actual))
    return out


@registered("SELECT kind, 'trained' AS status, true AS fits, true AS within_bounds FROM (VALUES ('random_forest'), ('gradient_boost'), ('neural_network')) v(kind)")
def learned_models(spark, sf_dir):
    """Each kind of model, trained on actual selectivities: half of its estimates are within a factor of two, all between 0 and 1."""
    examples, rows = _observed(spark, sf_dir), []
    for kind in ("random_forest", "gradient_boost", "neural_network"):
        model = learned.SelectivityModel(spark, kind, trees=15, depth=5, examples=list(examples))
        report = model.train()
        estimates = model.predict([f for f, _ in examples])
        rows.append((kind, report["status"], report["median_q_error"] < 2, all(0 <= x <= 1 for x in estimates)))
    return spark.createDataFrame(rows, "kind string, status string, fits boolean, within_bounds boolean")


@registered(f"SELECT count(*) AS features, true AS sorted, true AS sums_to_one, true AS survives_saving FROM (VALUES {_ALL_FEATURES}) v(feature)")
def feature_importance(spark, sf_dir):
    """The importances of a trained forest, the greatest first, and the same from its saved copy."""
    from tessela.runtime import scratch

    model = learned.SelectivityModel(spark, "random_forest", trees=10, depth=5, examples=_observed(spark, sf_dir))
    model.train()
    path = scratch(spark)
    model.save(path)
    again = learned.SelectivityModel(spark)
    again.load(path)
    values = sorted(model.importance().values(), reverse=True)
    best = max(model.importance(), key=model.importance().get)
    told = model.explain(model.examples[0][0], 1)
    return spark.createDataFrame([(len(values), best in told, abs(sum(values) - 1) < 1e-6, again.importance() == model.importance())], "features long, sorted boolean, sums_to_one boolean, survives_saving boolean")


@registered("SELECT what, true AS refused FROM (VALUES ('aggregate'), ('metric'), ('operator'), ('plan'), ('model'), ('join'), ('file'), ('index')) v(what)")
def unknown_refused(spark, sf_dir):
    """What isn't known raises ValueError instead of giving a result."""
    from tessela.operators import distributed
    from tessela.plans.hybrid import execute_hybrid
    from tessela.sources import catalogs, files

    region = read(spark, sf_dir, "region")
    asked = {
        "aggregate": lambda: relational.aggregate(region, ("r_name",), {"x": ("median of medians", "r_regionkey")}),
        "metric": lambda: distance.distance(F.col("v"), (1.0,), "manhattan"),
        "operator": lambda: relational.execute(spark, relational.Operator("teleport")),
        "plan": lambda: execute_hybrid(region, VectorOp("v", (1.0,), 1), (), "sideways"),
        "model": lambda: learned.SelectivityModel(spark, "oracle", examples=[(learned.QueryFeatures(1), 0.5)] * learned.LEAST_EXAMPLES).train(),
        "join": lambda: distributed.distributed_join(region, region, "r_regionkey", "left"),
        "file": lambda: files.load(spark, "table.pkl"),
        "index": lambda: catalogs.IndexRegistry().register("t", "v", "lsh"),
    }
    rows = []
    for what, run in asked.items():
        try:
            run()
            rows.append((what, False))
        except ValueError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")
