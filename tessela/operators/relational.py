"""Relational operators as a tree that lowers to one DataFrame.

Null keys of hash joins match each other, a name on both sides takes the right side's value at the left side's place,
count counts nulls, and an aggregate without groups gives no row for an empty input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessela.operators.vector_search import vector_search

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def scan(df: DataFrame, columns: Sequence[str] = ("*",)) -> DataFrame:
    return df.selectExpr(*columns)


def index_scan(df: DataFrame, predicate: str | Column, columns: Sequence[str] = ("*",)) -> DataFrame:
    """Filter and projection; both reach the Parquet reader."""
    return df.where(predicate).selectExpr(*columns)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in the order asked for; absent ones are skipped, repeated ones kept once."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(columns) if c in df.columns])


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[dict], object]) -> DataFrame:
    """A Column or SQL text stays in the engine. A Python callable sees each row as a dict, by Arrow batches; its truthiness
    decides, as Python has it."""
    if not callable(predicate) or isinstance(predicate, Column):
        return df.where(predicate)

    def run(batches):
        for pdf in batches:
            keep = [bool(predicate(row)) for row in pdf.to_dict("records")]
            yield pdf[keep]

    return df.mapInPandas(run, df.schema)


def _collided(left: DataFrame, right: DataFrame, joined: DataFrame) -> DataFrame:
    taken = set(right.columns)
    out = [joined[f"__r.{c}"] if c in taken else joined[f"__l.{c}"] for c in left.columns]
    out += [joined[f"__r.{c}"] for c in right.columns if c not in left.columns]
    return joined.select(*out)


def hash_join(left: DataFrame, right: DataFrame, left_key: str | Sequence[str], right_key: str | Sequence[str], null_safe: bool = True, hint: str | None = None) -> DataFrame:
    """Inner equi-join. null_safe: null keys match each other. hint: broadcast, shuffle_hash or merge; without one the
    engine chooses by size, at run time too."""
    pairs = list(zip([left_key] if isinstance(left_key, str) else left_key, [right_key] if isinstance(right_key, str) else right_key))
    l, r = left.alias("__l"), right.alias("__r")
    if hint:
        r = r.hint(hint)
    same = [F.col(f"__l.{a}").eqNullSafe(F.col(f"__r.{b}")) if null_safe else F.col(f"__l.{a}") == F.col(f"__r.{b}") for a, b in pairs]
    return _collided(left, right, l.join(r, reduce(and_, same), "inner"))


def nested_loop_join(left: DataFrame, right: DataFrame, predicate: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """Theta join: predicate gets functions that name a column of the left and of the right side. Without one it is the cross
    product, which the caller asks for explicitly."""
    l, r = left.alias("__l"), right.alias("__r")
    joined = l.crossJoin(r) if predicate is None else l.join(r, predicate(lambda c: F.col(f"__l.{c}"), lambda c: F.col(f"__r.{c}")), "inner")
    return _collided(left, right, joined)


def aggregate(df: DataFrame, group_by: Sequence[str] = (), aggregates: Mapping[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """aggregates: output -> (function, input). count counts rows, nulls included; sum, avg, min and max skip nulls. An absent input
    counts as 0 in every row, an absent group column as null; an unknown function raises ValueError."""
    out = []
    for name, (function, column) in (aggregates or {}).items():
        if function == "count":
            out.append(F.count(F.lit(1)).alias(name))
        elif function in AGGREGATES:
            out.append(AGGREGATES[function](F.col(column) if column in df.columns else F.lit(0)).alias(name))
        else:
            raise ValueError(f"unknown aggregate function: {function}")
    for c in group_by:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if group_by:
        return df.groupBy(*group_by).agg(*out) if out else df.select(*group_by).distinct()
    return df.agg(*out, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")


def sort(df: DataFrame, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """Ascending, nulls last; absent keys are constants and don't matter."""
    order = [F.asc_nulls_last(c) for c in [*keys, *([tie] if tie else [])] if c in df.columns]
    return df.orderBy(*order) if order else df


def limit(df: DataFrame, n: int = 0) -> DataFrame:
    """0 is no limit."""
    return df.limit(n) if n else df


@dataclass(frozen=True)
class Operator:
    """A node of an operator tree: its type, parameters and inputs."""

    type: str
    params: Mapping = field(default_factory=dict)
    inputs: tuple[Operator, ...] = ()


def execute(spark: SparkSession, root: Operator, n: int = 0) -> DataFrame:
    """Lower a tree; n limits the rows, 0 not at all. An unknown type raises ValueError."""

    def build(node: Operator) -> DataFrame:
        p, children = node.params, [build(x) for x in node.inputs]
        if node.type == "scan":
            return scan(spark.table(p["table"]), p.get("columns", ["*"]))
        if node.type == "index_scan":
            return index_scan(spark.table(p["table"]), p["predicate"], p.get("columns", ["*"]))
        if node.type == "vector_search":
            found = vector_search(spark.table(p["table"]), p["vector_column"], p["query_vector"], p.get("k", 10), p.get("metric", "cosine"), tie=p.get("tie"))
            columns = p.get("columns", ["*"])
            return found if list(columns) == ["*"] else found.selectExpr(*columns, "distance")
        if node.type == "filter":
            return filter_rows(children[0], p["predicate"])
        if node.type == "hash_join":
            return hash_join(children[0], children[1], p["left_key"], p["right_key"], p.get("null_safe", True), p.get("hint"))
        if node.type == "nested_loop_join":
            return nested_loop_join(children[0], children[1], p.get("predicate"))
        if node.type == "project":
            return project(children[0], p["columns"])
        if node.type == "sort":
            return sort(children[0], p["keys"], p.get("tie"))
        if node.type == "aggregate":
            return aggregate(children[0], p.get("group_by", ()), p.get("aggregates", {}))
        raise ValueError(f"unknown operator type: {node.type}")

    return limit(build(root), n)


def sql(spark: SparkSession, text: str, parameters: Sequence | Mapping | None = None) -> DataFrame:
    """SQL with ? or :name markers, bound and never pasted into the text. %s markers are taken as ?."""
    if parameters is None:
        return spark.sql(text)
    if isinstance(parameters, Mapping):
        return spark.sql(text, args=dict(parameters))
    return spark.sql(text.replace("%s", "?"), args=list(parameters))


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
