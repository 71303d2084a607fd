import pytest

from tessela.catalog_estimates import SCENARIOS, scenario_rows
from tessela.plans.cost import CostConfig, SqlCost, VectorCost
from tessela.plans.ir import HybridQuery, Plan, PlanType, Predicate, TableStats, VectorOp
from tessela.plans.planner import Planner, PlannerConfig

SQL, VECTOR = SqlCost(), VectorCost()
OP = VectorOp("embedding", (1.0,), 10)


def query(*predicates):
    return HybridQuery(OP, tuple(Predicate(c, o, v, selectivity=s) for c, o, v, s in predicates))


def test_sequential_scan_is_linear():
    assert SQL.seq_scan(20_000, 200) == 700 and SQL.seq_scan(10_000, 200) == 350
    assert SQL.seq_scan(0, 200) == 1
    assert SQL.seq_scan(10, 0) > 0


def test_index_wins_for_few_rows_only():
    assert SQL.index_scan(100_000, 100) == 408.5
    assert SQL.best_scan(100_000, 200, 0.001, 1, True)[0] == "indexscan"
    assert SQL.best_scan(100_000, 200, 0.9, 1, True)[0] == "seqscan"
    assert SQL.best_scan(100_000, 200, 0.001, 1, False)[0] == "seqscan"


@pytest.mark.parametrize(
    ("kind", "distinct", "span", "expected"),
    [("equality", 50, None, 0.02), ("equality", None, None, 0.005), ("range", None, 0.25, 0.25), ("range", None, 7, 1.0), ("range", None, None, 0.1), ("like", None, None, 0.05), ("in", 100, None, 0.1), ("in", None, None, 0.1), ("odd", 5, None, 0.1)],
)
def test_selectivities(kind, distinct, span, expected):
    assert SQL.selectivity(kind, distinct, span) == pytest.approx(expected)


def test_combined_selectivity():
    assert SQL.combined([0.1, 0.2]) == pytest.approx(0.02) and SQL.combined([]) == 1.0


def test_vector_costs():
    assert VECTOR.hnsw(100_000, 10) == pytest.approx(319.04, abs=0.01) and VECTOR.hnsw(10_000, 10) == pytest.approx(265.89, abs=0.01)
    assert VECTOR.ivfflat(100_000, 10, 100, 20) == pytest.approx(26663.86, abs=0.01)
    assert VECTOR.ivfflat(100_000, 10, 100, 20) > VECTOR.ivfflat(100_000, 10, 100, 5)
    assert VECTOR.brute_force(20_000, 10) == pytest.approx(2 * VECTOR.brute_force(10_000, 10))
    assert VECTOR.hnsw(0, 10) == VECTOR.ivfflat(10, 10, 0) == 0
    assert VECTOR.filtered(100_000, 0.01, 10) == (pytest.approx(212.74, abs=0.01), 1000)
    assert VECTOR.search_then_filter(100_000, 0.01, 10) == (pytest.approx(351.71, abs=0.01), 1500)
    assert VECTOR.search_then_filter(100, 0.0, 10)[1] == 100
    assert VECTOR.recommend(100_000, 0.01, 10) == "filter_first"


def test_scenarios():
    chosen = {q: (kind, c) for q, kind, c, best in scenario_rows() if best}
    assert chosen["high_selectivity"] == ("filter_first", 2918.49) and chosen["low_selectivity"] == ("vector_first", 3224.38)
    assert set(chosen) == set(SCENARIOS)


def test_estimated_rows_multiply_in_order():
    stats = TableStats(100_000)
    plans = Planner().plans(query(("a", "=", 1, 0.02), ("b", "<", 1, 0.4), ("c", ">", 1, 0.6)), stats)
    assert plans[0].metadata["expected_filter_output"] == 479


def test_missing_selectivity_has_its_own_default_at_each_place():
    planner, stats = Planner(PlannerConfig(enable_hybrid=True)), TableStats(10_000, distinct={"a": 50})
    q = query(("a", "=", 1, 0.0), ("b", "<", 1, None), ("c", "<", 1, 0.4))
    assert planner.plans(q, stats)[0].metadata["expected_filter_output"] == int(10_000 * (1.0 * 0.1 * 0.1 * 0.4))
    assert planner.estimate_selectivity(q.predicates[0], stats) == 0.02 and planner.estimate_selectivity(q.predicates[1], stats) == 0.1
    splits = [p for p in planner.plans(q, stats) if p.plan_type is PlanType.HYBRID]
    assert len(splits) == 2 and splits[0].steps[0].predicates[0].column == "c"


def test_enumeration_limit_and_empty_choice():
    q = query(("a", "=", 1, 0.1), ("b", "=", 1, 0.1))
    assert len(Planner(PlannerConfig(enable_hybrid=True, plan_enumeration_limit=2)).plans(q, TableStats(10))) == 2
    with pytest.raises(ValueError):
        Planner().best([], TableStats(10))
    assert Planner().cost(Plan("p", PlanType.SEQUENTIAL, ()), TableStats(10)) == 1.0


def test_explain_names_every_step():
    planner, stats = Planner(PlannerConfig(cost=CostConfig())), TableStats(1000, indexed_columns=frozenset({"a"}))
    plans = planner.plans(query(("a", "=", 1, 0.1)), stats)
    planner.best(plans, stats)
    text = planner.explain(plans[1], stats)
    assert "top 150" in text and "sequential filter: a = 1" in text and "limit 10" in text


def test_unknown_operator():
    with pytest.raises(ValueError):
        Predicate("a", "~", 1).to_column()
