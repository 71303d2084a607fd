"""Runs a query and tells what each operator of its final plan did."""

from __future__ import annotations

from pyspark.sql import DataFrame

_SCHEMA = "no int, depth int, operator string, n_rows long, time_ms long"


def _inner(node):
    """The operators below a node; adaptive plans and stages hide theirs."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return []
    below = node.children()
    return [below.apply(i) for i in range(below.size())]


def _metrics(node) -> dict[str, int]:
    found, each = {}, node.metrics().iterator()
    while each.hasNext():
        pair = each.next()
        found[pair._1()] = pair._2().value()
    return found


def analyze(df: DataFrame) -> DataFrame:
    """Runs the query once, its rows going nowhere, and gives (no, depth, operator, n_rows, time_ms) of the plan as it ended up: rows that left the
    operator, and its time over all tasks, null where it keeps none. The plan is the one that ran, after adaptive changes."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[tuple] = []

    def visit(node, depth: int) -> None:
        told = _metrics(node)
        spent = [told[k] for k in ("pipelineTime", "scanTime", "aggTime", "sortTime", "buildTime", "collectTime") if k in told]
        out.append((len(out), depth, node.nodeName().strip(), told.get("numOutputRows"), sum(spent) if spent else None))
        for child in _inner(node):
            visit(child, depth + 1)

    visit(execution.executedPlan(), 0)
    return df.sparkSession.createDataFrame(out, _SCHEMA)


def explain_analyze(df: DataFrame) -> str:
    """The same as text, one line an operator."""
    lines = []
    for r in analyze(df).orderBy("no").collect():
        rows = "" if r["n_rows"] is None else f"  rows={r['n_rows']}"
        spent = "" if r["time_ms"] is None else f"  time={r['time_ms']} ms"
        lines.append(f"{'  ' * r['depth']}{r['operator']}{rows}{spent}")
    return "\n".join(lines)
