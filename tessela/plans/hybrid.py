"""Runs hybrid queries: a plan becomes a chain of DataFrame operations, which Catalyst optimises further."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessela.operators.vector_search import vector_search
from tessela.plans.ir import FilterStep, HybridQuery, LimitStep, Plan, PlanType, Predicate, TableStats, VectorOp, VectorStep, conjunction
from tessela.plans.planner import SURPLUS, Planner, PlannerConfig

#: Candidates of a vector-first run without statistics, as a multiple of k.
OVERSAMPLING = 10


def lower(plan: Plan, query: HybridQuery, df: DataFrame) -> DataFrame:
    """The plan over df, with a distance column. A filter after a search stays above its top-k, so each order keeps its
    meaning; a limit after a search keeps the nearest."""
    out = df
    for step in plan.steps:
        if isinstance(step, FilterStep):
            out = out.where(conjunction(step.predicates))
        elif isinstance(step, VectorStep):
            out = vector_search(out, step.vector.column, step.vector.query, step.k, step.vector.metric, tie=query.id_column)
        else:
            out = out.orderBy("distance", query.id_column).limit(step.k) if "distance" in out.columns else out.limit(step.k)
    return out


def fixed_plan(kind: PlanType, query: HybridQuery, stats: TableStats | None = None) -> Plan:
    """A plan of a given kind, without costing. vector_first takes k * 10 candidates where nothing is known of the table."""
    k = query.vector.k
    if kind is PlanType.FILTER_FIRST:
        steps = (FilterStep(query.predicates, "seqscan"), VectorStep(query.vector, k))
    elif kind is PlanType.VECTOR_FIRST and not query.predicates:
        steps = (VectorStep(query.vector, k), LimitStep(k))
    elif kind is PlanType.VECTOR_FIRST:
        wanted = k * OVERSAMPLING if stats is None else min(int(k / max(Planner().assumed_selectivity(query.predicates), 0.01) * SURPLUS), stats.n_tuples)
        steps = (VectorStep(query.vector, wanted), FilterStep(query.predicates, "sequential"), LimitStep(k))
    elif kind is PlanType.SEQUENTIAL:
        steps = (*[FilterStep((p,), "seqscan") for p in query.predicates], VectorStep(query.vector, k))
    else:
        raise ValueError(f"unknown plan type: {kind}")
    return Plan(kind.value, kind, steps)


@dataclass
class HybridResult:
    rows: DataFrame
    plan: Plan
    meta: dict

    def run(self) -> tuple[list, dict]:
        """The rows, k at most, and meta with results_returned and execution_time_ms filled in from this one execution."""
        start = time.perf_counter()
        rows = self.rows.take(self.meta["k"])
        return rows, self.meta | {"results_returned": len(rows), "execution_time_ms": round((time.perf_counter() - start) * 1000, 3)}


def execute_hybrid(
    df: DataFrame, vector: VectorOp, predicates: tuple[Predicate, ...] = (), plan_type: str = "auto", stats: TableStats | None = None, id_column: str = "id",
    table: str = "", config: PlannerConfig | None = None, auto_rule: str = "cost",
) -> HybridResult:
    """A hybrid query with the named plan type, or the cheapest one.

    auto chooses by cost where statistics are given; without them, or with auto_rule "predicates", it filters first if
    there is anything to filter. A vector-first run may find fewer than k rows. meta tells the plan and how many
    candidates it takes from the vector search.
    """
    query = HybridQuery(vector, tuple(predicates), id_column)
    if plan_type == "auto":
        if stats is not None and auto_rule == "cost":
            plan = Planner(config).choose(query, stats)
        else:
            plan = fixed_plan(PlanType.FILTER_FIRST if predicates else PlanType.VECTOR_FIRST, query, stats)
    elif plan_type in {p.value for p in PlanType if p is not PlanType.HYBRID}:
        plan = fixed_plan(PlanType(plan_type), query, stats)
    elif plan_type == "hybrid" and len(predicates) > 1:
        split = PlannerConfig(enable_filter_first=False, enable_vector_first=False, enable_hybrid=True)
        plan = Planner(split).choose(query, stats or TableStats(0))
    else:
        raise ValueError(f"unknown plan type: {plan_type}")
    searched = next(s.k for s in plan.steps if isinstance(s, VectorStep))
    meta = {"plan_type": plan.plan_type.value, "table": table, "k": vector.k, "candidate_rows_scanned": searched}
    return HybridResult(lower(plan, query, df), plan, meta)
