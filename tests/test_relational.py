import pytest
from pyspark.sql import functions as F

from tessela.operators import constraints, relational, statistics, views
from tessela.operators.relational import Operator


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_project_order_absent_and_repeated(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert relational.project(df, ["b", "zz", "a", "b"]).columns == ["b", "a"]


def test_hash_join_nulls_and_clashes(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2")], "k int, v string")
    right = spark.createDataFrame([(1, "r1", 7), (None, "r2", 8)], "k int, v string, w int")
    joined = relational.hash_join(left, right, "k", "k")
    assert joined.columns == ["k", "v", "w"] and rows(joined) == [(1, "r1", 7), (None, "r2", 8)]
    assert rows(relational.hash_join(left, right, "k", "k", null_safe=False)) == [(1, "r1", 7)]


def test_nested_loop_join(spark):
    a, b = spark.createDataFrame([(1,), (3,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert rows(relational.nested_loop_join(a, b)) == [(1, 2), (3, 2)]
    assert rows(relational.nested_loop_join(a, b, lambda l, r: l("x") > r("y"))) == [(3, 2)]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5)], "g string, v int")
    out = relational.aggregate(df, ["g"], {"n": ("count", "v"), "s": ("sum", "v"), "zero": ("max", "absent")})
    assert rows(out) == [("a", 2, 1, 0), (None, 1, 5, 0)]
    empty = df.where("v > 99")
    assert relational.aggregate(empty, (), {"n": ("count", None)}).count() == 0
    assert relational.aggregate(df, ["missing"], {"n": ("count", None)}).first()["n"] == 3
    with pytest.raises(ValueError):
        relational.aggregate(df, (), {"x": ("median", "v")})


def test_sort_limit_filter(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert [r[0] for r in relational.sort(df, ["v", "absent"]).collect()] == [1, 2, None]
    assert relational.limit(df, 0).count() == 3 and relational.limit(df, 2).count() == 2
    assert rows(relational.filter_rows(df, lambda r: r["v"] == 2)) == [(2,)]
    assert rows(relational.filter_rows(df, F.col("v") > 1)) == [(2,)]


def test_tree_and_unknown_operator(spark):
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, s string").createOrReplaceTempView("tree_t")
    tree = Operator("sort", {"keys": ["id"]}, (Operator("filter", {"predicate": "id > 0"}, (Operator("scan", {"table": "tree_t"}),)),))
    assert [r["s"] for r in relational.execute(spark, tree, 1).collect()] == ["x"]
    deep = Operator("scan", {"table": "tree_t"})
    for _ in range(12):
        deep = Operator("filter", {"predicate": "id < 9"}, (deep,))
    assert relational.execute(spark, deep).count() == 2
    with pytest.raises(ValueError):
        relational.execute(spark, Operator("shuffle_everything"))


def test_sql_parameters_are_bound(spark):
    assert relational.sql(spark, "SELECT %s AS a", ["x'; DROP TABLE t"]).first()["a"] == "x'; DROP TABLE t"
    assert relational.sql(spark, "SELECT :v AS a", {"v": 3}).first()["a"] == 3


def test_view_fan_out(spark):
    products = spark.createDataFrame([(1,), (2,)], "p int")
    reviews = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0)], "p int, r int, rating double")
    items = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3), (2, 7, 9)], "p int, o int, q int")
    out = {r["p"]: r for r in views.product_stats(products, reviews, items, "p", "r", "rating", "o", "q").collect()}
    assert (out[1]["review_count"], out[1]["avg_rating"], out[1]["order_count"], out[1]["total_sold"]) == (2, 3.0, 2, 12)
    assert (out[2]["review_count"], out[2]["avg_rating"], out[2]["total_sold"]) == (0, None, 9)


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, None)], "x int, y string")
    stats = statistics.table_statistics(df, indexed=["x, y"], approximate=False, size_bytes=800)
    assert stats.n_tuples == 4 and stats.distinct == {"x": 2, "y": 1} and stats.null_frac["y"] == 0.75 and stats.indexed_columns == {"x", "y"} and stats.avg_tuple_size == 200
    assert statistics.table_statistics(df.where("x > 9"), approximate=False, size_bytes=0).avg_tuple_size == 200


def test_constraints(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None), (3, 1)], "id int, parent int")
    parent = spark.createDataFrame([(1,)], "key int")
    assert rows(constraints.broken_unique(child, ["id"])) == [(3, 2)]
    assert rows(constraints.broken_not_null(child, ["parent"])) == [(3, None)]
    assert rows(constraints.broken_check(child, "parent < 5")) == [(2, 9)]
    assert rows(constraints.broken_reference(child, "parent", parent, "key")) == [(2, 9)]
    assert rows(constraints.cascade_delete(child, "parent", parent, "key")) == [(2, 9), (3, None)]
