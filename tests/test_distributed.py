import hashlib

import pytest
from pyspark.sql import functions as F

from tessela.functions.partition_ids import hash_id, literal_id, partition_id
from tessela.operators import distributed


def test_md5_ids_equal_those_of_the_driver(spark):
    got = {r["id"]: r["p"] for r in spark.range(2000).select("id", hash_id(F.col("id"), 7).alias("p")).collect()}
    assert got == {i: int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 7 for i in range(2000)}
    assert literal_id("k", 5) == int(hashlib.md5(b"k").hexdigest(), 16) % 5
    with pytest.raises(ValueError):
        partition_id(F.col("id"), 4, "round_robin")


def test_ids_survive_repartitioning(spark):
    df = spark.range(100).withColumn("p", hash_id(F.col("id"), 4))
    again = spark.range(100).repartition(7).withColumn("p", hash_id(F.col("id"), 4))
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in again.collect()}


def test_pruning(spark, tmp_path):
    layout = distributed.Partitioning("id", 6)
    assert layout.targets({"id": ("=", 3)}) == [literal_id(3, 6)] and layout.targets({"id": ("<", 3)}) == list(range(6)) == layout.targets()
    assert distributed.Partitioning("id", 6, "range").targets({"id": ("=", 3)}) == list(range(6))
    layout.write(spark.range(60), str(tmp_path / "t"))
    pruned = layout.scan(spark.read.parquet(str(tmp_path / "t")), {"id": ("=", 3)}, "id = 3")
    assert [r["id"] for r in pruned.collect()] == [3] and "PartitionFilters: [isnotnull(partition" in pruned._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cluster(spark):
    c = distributed.Cluster(spark)
    for node, active in (("n1", True), ("n2", True), ("n3", False)):
        c.add_node(node, is_active=active)
    for i in range(6):
        c.register(f"t_{i}", "t", "k", 10 * i, 1.0, f"n{i % 3 + 1}")
    return c


def test_cluster(cluster):
    status = {r["node_id"]: r for r in distributed.cluster_status(cluster.node_table(), cluster.partition_table()).collect()}
    assert status["n1"]["total_rows"] == 30 and status["n3"]["n_partitions"] == 2 and not status["n3"]["is_active"]
    assert [p[0] for p in cluster.target_partitions("t", [4])] == ["t_4"] and len(cluster.target_partitions("t")) == 6
    assert cluster.by_node(cluster.target_partitions("t")) == {"n1": ["t_0", "t_3"], "n2": ["t_1", "t_4"]}
    assert distributed.table_rows(cluster.partition_table(), "t").first()[0] == 150
    assert cluster.colocated("t", "t", "k") and not cluster.colocated("t", "u", "k")


def test_join_strategies(spark):
    small, large = spark.range(999).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k")
    assert distributed.distributed_join(large, small, "k")[1] == "broadcast"
    assert distributed.distributed_join(large, large, "k")[1] == "shuffle"
    joined, how = distributed.distributed_join(large, large, "k", colocated=True)
    assert how == "colocated" and joined.count() == 1000
    with pytest.raises(ValueError):
        distributed.distributed_join(large, small, "k", "left")


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, x int")
    b = spark.createDataFrame([(None, 3), (1, 4)], "k int, y int")
    assert distributed.shuffle_join(a, b, "k").count() == 2 and distributed.broadcast_join(a, b, "k", 2, 2).count() == 2
    assert distributed.colocated_join(a, b, "k").count() == 1


def test_gather(spark):
    assert distributed.gather([spark.range(2), spark.range(2)]).count() == 4


def test_layouts_are_read_in_part_and_joined_in_place(spark, data):
    from tessela import catalog

    plan = lambda name: catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan("join_colocated")
    assert "PartitionFilters: [isnotnull(partition" in plan("pruned_scan") and "PartitionFilters: [isnotnull(year" in plan("orders_by_year")
    assert "PartitionFilters: [list_id" in plan("ivf_probe")
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,37)" in plan("pruned_lookup")
    pruned = catalog.queries()["pruned_scan"](spark, data)
    assert {r[0].split("/")[-2] for r in pruned.select(F.input_file_name()).distinct().collect()} == {f"partition={literal_id(37, 8)}"} or pruned.count() == 0


def test_large_sides_are_not_broadcast(spark):
    a = spark.range(50).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        distributed.broadcast_join(a, a, "k", bound=20)
    assert distributed.broadcast_join(a, a.where("k < 5"), "k", bound=20).count() == 5


def test_explain_analyze(spark, data):
    from tessela.operators import explain

    text = explain.explain_analyze(spark.read.parquet(f"{data}/part.parquet").where("p_size < 25").groupBy("p_type").count())
    assert "Scan parquet" in text and "HashAggregate" in text and "rows=" in text and "time=" in text
    assert explain.analyze(spark.range(0)).count() >= 1
