import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.plans import learned
from tessela.plans.learned import Ensemble, QueryFeatures, SelectivityModel
from tessela.sources import catalogs, files, generator
from tessela.streaming import execution_log


def test_feature_vector():
    v = dict(zip(learned.FEATURES, QueryFeatures(1000, 0.01, vector_k=100, has_vector_search=True, num_distinct_values=(10, 1000), null_fraction=(0.0, 0.5), has_index=(True, False)).vector()))
    assert v["log_table_rows"] == 3 and v["log_table_size_mb"] == -1 and v["log_vector_k"] == 2 and v["avg_log_ndv"] == 2 and v["std_log_ndv"] == 1
    assert v["avg_null_frac"] == 0.25 and v["max_null_frac"] == 0.5 and v["avg_has_index"] == 0.5 and v["avg_join_sel"] == v["min_join_sel"] == 0.5
    assert QueryFeatures(0).vector()[12:17] == [0, 0, 0, 0, 0]


def examples(n):
    rng = np.random.default_rng(1)
    return [(QueryFeatures(10 ** int(rng.integers(3, 7)), avg_histogram_selectivity=s, num_range_predicates=1), float(s)) for s in rng.uniform(0.001, 1, n)]


@pytest.mark.parametrize("kind", ["random_forest", "neural_network"])
def test_training(spark, kind, tmp_path):
    model = SelectivityModel(spark, kind, trees=10, depth=6)
    for f, a in examples(49):
        model.add(f, a)
    assert model.train()["status"] == "insufficient_data" and model.predict([QueryFeatures(10, avg_histogram_selectivity=0.3)]) == [0.3]
    model.add(*examples(1)[0])
    report = model.train()
    assert report["status"] == "trained" and report["median_q_error"] < 2
    assert 0 <= model.predict([examples(1)[0][0]])[0] <= 1 and model.cardinality(examples(1)[0][0], 1000) >= 1
    if kind == "random_forest":
        assert max(model.importance(), key=model.importance().get) == "avg_hist_sel" and "random_forest" in model.explain(examples(1)[0][0])
        model.save(str(tmp_path / "m"))
        again = SelectivityModel(spark, kind)
        again.load(str(tmp_path / "m"))
        assert again.predict([examples(1)[0][0]]) == model.predict([examples(1)[0][0]])


def test_unknown_model(spark):
    model = SelectivityModel(spark, "oracle", examples=examples(50))
    with pytest.raises(ValueError):
        model.train()


def test_ensemble():
    e = Ensemble()
    assert e.estimate(0.2) == pytest.approx(0.2) and e.estimate(0.2, 0.4, 0.1) == pytest.approx(0.28) and e.estimate(3.0) == 1.0
    e.feedback({"ml": [1.0, 1.0, 4.0], "histogram": [4.0]})
    assert sum(e.weights.values()) == pytest.approx(1) and e.weights["ml"] > e.weights["histogram"]


def test_files(spark, tmp_path):
    path, schema = str(tmp_path / "t.parquet"), "id int, v array<float>"
    assert files.insert_rows(spark, [], schema, path) == 0
    assert files.insert_rows(spark, [{"id": 1, "v": np.array([1.0, 2.0], np.float32)}], schema, path) == 1
    files.insert_rows(spark, [{"id": 2, "v": None}], schema, path)
    assert files.load(spark, path).count() == 2
    files.export(files.load(spark, path), str(tmp_path / "out"), "v")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).columns == ["id"]
    with pytest.raises(ValueError):
        files.load(spark, "t.pkl")
    as_json, as_csv = files.write_report([{"a": 1}, {"a": 2, "b": 3}], str(tmp_path / "r"))
    assert json.load(open(as_json))[1]["b"] == 3 and open(as_csv).readline().strip() == "a,b"
    config = files.planner_config({"cost_model": {"random_page_cost": 1.5, "other": 1}, "optimizer": {"enable_hybrid": True}})
    assert config.cost.random_page_cost == 1.5 and config.enable_hybrid and files.planner_config().cost.seq_scan_cost == 1.0
    orders = spark.sql("SELECT id, make_date(2024 + cast(id AS int), 1, 1) AS d FROM range(3)")
    files.partition_by_year(orders, "d", str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).where("year = 2025").count() == 1


def test_generator_is_deterministic(spark):
    a = generator.products(spark, 50, 8).orderBy("id").collect()
    b = generator.products(spark, 80, 8).repartition(3).where("id < 50").orderBy("id").collect()
    assert a == b and all(len(r["embedding"]) == 8 and 0 <= r["rating"] <= 5 and r["price"] > 0 for r in a)


def test_index_registry_and_log(spark, tmp_path):
    registry = catalogs.IndexRegistry(str(tmp_path / "i.json"))
    registry.register("t", "v", "hnsw", "USING hnsw (v) WITH (m = 32)")
    again = catalogs.IndexRegistry(str(tmp_path / "i.json"))
    assert again.stats("t", "v") == {"index_type": "hnsw", "m": 32, "ef_construction": 64} and again.stats("t", "w") == {}
    with pytest.raises(ValueError):
        registry.register("t", "v", "lsh")
    import datetime as dt

    log = str(tmp_path / "log")
    at = dt.datetime(2024, 1, 1)
    catalogs.append_log(spark, log, [("h", "q", "filter_first", Decimal("1.5"), Decimal("10"), 5, at), ("h", "q", "vector_first", Decimal("2"), Decimal("30"), 5, at)])
    catalogs.append_log(spark, log, [("h", "q", "filter_first", Decimal("1.5"), Decimal("20"), 5, at + dt.timedelta(hours=5))])
    assert catalogs.read_log(spark, log).count() == 3
    summary = execution_log.runtime_by_plan(execution_log.log_stream(spark, log))
    execution_log.start(summary, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination(60)
    done = spark.read.parquet(str(tmp_path / "s")).where(F.col("plan_type") == "filter_first").collect()
    assert [(r["runs"], float(r["avg_runtime_ms"])) for r in done][:1] == [(1, 10.0)]
