import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessela.functions.distance import distance
from tessela.operators.vector_search import build_inverted_lists, vector_search
from tessela.plans.hybrid import execute_hybrid
from tessela.plans.ir import Predicate, TableStats, VectorOp

SCHEMA = "id int, kind string, v array<float>"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [10.0, 0.0]), (3, "a", [0.0, 1.0]), (4, "b", [3.0, 4.0]), (5, "a", [0.0, 0.0]), (6, "a", None)], SCHEMA)


def test_metrics_differ(points):
    found = {m: [(r["id"], round(r["distance"], 6)) for r in vector_search(points, "v", [1.0, 0.0], 3, m, tie="id").collect()] for m in ("cosine", "l2", "inner_product")}
    assert found["cosine"] == [(1, 0.0), (2, 0.0), (4, 0.4)]
    assert found["l2"] == [(1, 0.0), (5, 1.0), (3, 1.414214)]
    assert found["inner_product"] == [(2, -10.0), (4, -3.0), (1, -1.0)]


def test_zero_and_null_come_last(points):
    out = vector_search(points, "v", [1.0, 0.0], 10, tie="id").collect()
    assert [r["id"] for r in out[-2:]] == [5, 6] and math.isnan(out[-2]["distance"]) and out[-1]["distance"] is None


def test_wrong_length_and_metric(spark, points):
    with pytest.raises(ValueError):
        distance(F.col("v"), [1.0], "hamming")
    with pytest.raises(PySparkException):
        vector_search(points, "v", [1.0, 0.0, 0.0], 3).collect()


def test_empty_table(spark, points):
    assert vector_search(points.where("id > 99"), "v", [1.0, 0.0], 3).count() == 0


def test_full_probe_is_exact(spark):
    rows = [(i, "a", [math.cos(i * 0.37), math.sin(i * 0.37)]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = build_inverted_lists(df, "v", 8)
    exact = [r["id"] for r in vector_search(df, "v", [1.0, 0.2], 7, tie="id").collect()]
    assert [r["id"] for r in lists.search([1.0, 0.2], 7, 8, tie="id").collect()] == exact
    assert len(lists.search([1.0, 0.2], 7, 2, tie="id").collect()) == 7


def test_plan_orders(points):
    op, predicates = VectorOp("v", (1.0, 0.0), 2, "l2"), (Predicate("kind", "=", "b"),)
    rows, meta = execute_hybrid(points, op, predicates, "filter_first").run()
    assert [r["id"] for r in rows] == [4, 2] and meta["results_returned"] == 2 and meta["plan_type"] == "filter_first"
    assert [r["id"] for r in execute_hybrid(points, op, predicates, "vector_first").run()[0]] == [4, 2]
    assert execute_hybrid(points, op, predicates, "vector_first", TableStats(3)).meta["candidate_rows_scanned"] == 3
    assert execute_hybrid(points, op, predicates).plan.plan_type.value == "filter_first"
    assert execute_hybrid(points, op).plan.plan_type.value == "vector_first"
    two = (*predicates, Predicate("id", ">", 2))
    assert len(execute_hybrid(points, op, two, "hybrid", TableStats(6)).run()[0]) <= 2
    with pytest.raises(ValueError):
        execute_hybrid(points, op, predicates, "fastest")


def test_plan_keeps_filter_above_top_k(points):
    result = execute_hybrid(points, VectorOp("v", (1.0, 0.0), 2, "l2"), (Predicate("kind", "=", "b"),), "vector_first")
    text = result.rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("TakeOrderedAndProject") == 2
