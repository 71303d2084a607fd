"""The query and plan objects that the planner works on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


class PlanType(Enum):
    FILTER_FIRST = "filter_first"
    VECTOR_FIRST = "vector_first"
    HYBRID = "hybrid"
    SEQUENTIAL = "sequential"


_COMPARE = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    ">=": lambda c, v: c >= v,
    "IN": lambda c, v: c.isin(list(v)),
    "LIKE": lambda c, v: c.like(v),
}
_KIND = {"=": "equality", "IN": "in", "LIKE": "like"}


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: object
    kind: str | None = None
    selectivity: float | None = None

    @property
    def predicate_type(self) -> str:
        return self.kind or _KIND.get(self.operator.upper(), "range")

    def to_column(self) -> Column:
        compare = _COMPARE.get(self.operator.upper())
        if compare is None:
            raise ValueError(f"unknown predicate operator: {self.operator}")
        return compare(F.col(self.column), self.value)

    def __str__(self) -> str:
        return f"{self.column} {self.operator} {self.value}"


def conjunction(predicates: Sequence[Predicate]) -> Column:
    return reduce(and_, [p.to_column() for p in predicates], F.lit(True))


@dataclass(frozen=True)
class VectorOp:
    column: str
    query: tuple[float, ...]
    k: int
    metric: str = "cosine"
    index_type: str | None = None


@dataclass(frozen=True)
class HybridQuery:
    vector: VectorOp
    predicates: tuple[Predicate, ...] = ()
    id_column: str = "id"


@dataclass(frozen=True)
class FilterStep:
    predicates: tuple[Predicate, ...]
    method: str


@dataclass(frozen=True)
class VectorStep:
    vector: VectorOp
    k: int


@dataclass(frozen=True)
class LimitStep:
    k: int


Step = FilterStep | VectorStep | LimitStep


@dataclass
class Plan:
    plan_id: str
    plan_type: PlanType
    steps: tuple[Step, ...]
    estimated_cost: float = 0.0
    metadata: dict = field(default_factory=dict)


@dataclass
class TableStats:
    n_tuples: int
    avg_tuple_size: int = 200
    table_size_bytes: int = 0
    distinct: dict[str, int] = field(default_factory=dict)
    null_frac: dict[str, float] = field(default_factory=dict)
    indexed_columns: frozenset[str] = frozenset()
    hnsw_m: int = 16
    hnsw_ef_search: int = 40
    ivfflat_lists: int = 100
    ivfflat_probes: int = 10
