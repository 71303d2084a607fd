"""Learned selectivities: features, tree models on MLlib, a small network, and a weighted ensemble with feedback."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The features in their order, the least number of examples, and the ensemble's first weights.
FEATURES = (
    "log_table_rows", "log_table_size_mb", "num_eq_predicates", "num_range_predicates", "num_like_predicates", "min_hist_sel", "max_hist_sel", "avg_hist_sel",
    "has_vector_search", "log_vector_k", "vector_table_ratio", "num_joins", "avg_log_ndv", "std_log_ndv", "avg_null_frac", "max_null_frac", "avg_has_index", "avg_join_sel", "min_join_sel",
)
LEAST_EXAMPLES = 50
MOST_EXAMPLES = 20_000
WEIGHTS = {"histogram": 0.3, "ml": 0.5, "sampling": 0.2}


@dataclass(frozen=True)
class QueryFeatures:
    table_row_count: int
    table_size_mb: float = 1.0
    num_equality_predicates: int = 0
    num_range_predicates: int = 0
    num_like_predicates: int = 0
    min_histogram_selectivity: float = 1.0
    max_histogram_selectivity: float = 1.0
    avg_histogram_selectivity: float = 1.0
    num_distinct_values: Sequence[int] = ()
    null_fraction: Sequence[float] = ()
    has_index: Sequence[bool] = ()
    has_vector_search: bool = False
    vector_k: int = 0
    vector_table_ratio: float = 0.0
    num_joins: int = 0
    join_selectivity_estimates: Sequence[float] = ()

    def vector(self) -> list[float]:
        """The features' values in the order of FEATURES; empty lists count as 0, join estimates as 0.5."""
        ndv = np.log10(np.maximum(np.array(self.num_distinct_values or [1], float), 1))
        some = lambda xs, f, empty: float(f(xs)) if len(xs) else empty
        values = [
            math.log10(max(self.table_row_count, 1)), math.log10(max(self.table_size_mb, 0.1)),
            float(self.num_equality_predicates), float(self.num_range_predicates), float(self.num_like_predicates),
            self.min_histogram_selectivity, self.max_histogram_selectivity, self.avg_histogram_selectivity,
            float(self.has_vector_search), math.log10(max(self.vector_k, 1)) if self.has_vector_search else 0.0, self.vector_table_ratio, float(self.num_joins),
            float(ndv.mean()), float(ndv.std()), some(self.null_fraction, np.mean, 0.0), some(self.null_fraction, np.max, 0.0),
            some([float(x) for x in self.has_index], np.mean, 0.0), some(self.join_selectivity_estimates, np.mean, 0.5), some(self.join_selectivity_estimates, np.min, 0.5),
        ]
        return [float(v) for v in values]


def feature_columns(df: DataFrame) -> DataFrame:
    """The same features, from a table with a column for each field of QueryFeatures, without leaving the engine."""
    avg = lambda c, empty: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c)).otherwise(F.lit(empty))
    logs = F.transform("num_distinct_values", lambda x: F.log10(F.greatest(x.cast("double"), F.lit(1.0))))
    mean = avg(logs, 0.0)
    spread = F.when(F.size(logs) > 0, F.sqrt(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x * x) / F.size(logs) - mean * mean + F.lit(0.0))).otherwise(F.lit(0.0))
    vector = F.col("has_vector_search")
    values: list[Column] = [
        F.log10(F.greatest(F.col("table_row_count").cast("double"), F.lit(1.0))), F.log10(F.greatest(F.col("table_size_mb").cast("double"), F.lit(0.1))),
        F.col("num_equality_predicates"), F.col("num_range_predicates"), F.col("num_like_predicates"), F.col("min_histogram_selectivity"), F.col("max_histogram_selectivity"), F.col("avg_histogram_selectivity"),
        vector.cast("double"), F.when(vector, F.log10(F.greatest(F.col("vector_k").cast("double"), F.lit(1.0)))).otherwise(F.lit(0.0)), F.col("vector_table_ratio"), F.col("num_joins"),
        mean, F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0)), avg(F.col("null_fraction"), 0.0), F.coalesce(F.array_max("null_fraction").cast("double"), F.lit(0.0)),
        avg(F.transform("has_index", lambda x: x.cast("double")), 0.0), avg(F.col("join_selectivity_estimates"), 0.5), F.coalesce(F.array_min("join_selectivity_estimates").cast("double"), F.lit(0.5)),
    ]
    return df.select("*", *[v.cast("double").alias(n) for n, v in zip(FEATURES, values)])


def q_errors(predicted: Column, actual: Column) -> Column:
    return F.greatest(predicted / (actual + 1e-6), actual / (predicted + 1e-6))


def error_report(df: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """One row: r2, mae and rmse of log10 selectivities, and the exact median and 95th percentile of the q-errors."""
    p, a = F.log10(F.greatest(F.col(predicted), F.lit(1e-6))), F.log10(F.greatest(F.col(actual), F.lit(1e-6)))
    q = q_errors(F.col(predicted), F.col(actual))
    return df.agg(
        (1 - F.sum((p - a) * (p - a)) / (F.var_pop(a) * F.count(F.lit(1)))).alias("r2"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.percentile(q, 0.5).alias("median_q_error"), F.percentile(q, 0.95).alias("p95_q_error"),
    )


class _Network:
    """A multilayer perceptron on numpy, trained by Adam: examples number thousands, not billions."""

    def __init__(self, sizes: tuple[int, ...] = (128, 64, 32), steps: int = 400, rate: float = 1e-3, seed: int = 42):
        self.sizes, self.steps, self.rate, self.seed = sizes, steps, rate, seed
        self.layers: list[list[np.ndarray]] = []

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.layers) - 1 else z)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        x = (x - self.mean) / self.scale
        shape = [x.shape[1], *self.sizes, 1]
        self.layers = [[rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)] for a, b in zip(shape, shape[1:])]
        moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in self.layers]
        for step in range(1, self.steps + 1):
            outs = self._forward(x)
            grad = 2 * (outs[-1] - y[:, None]) / len(y)
            for i in reversed(range(len(self.layers))):
                w, _ = self.layers[i]
                grads = [outs[i].T @ grad + 1e-4 * w, grad.sum(0)]
                grad = (grad @ w.T) * (outs[i] > 0) if i else grad
                for p, g, m in zip(self.layers[i], grads, moments[i]):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= self.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[-1][:, 0]


@dataclass
class SelectivityModel:
    """kind: random_forest, gradient_boost or neural_network. Examples are (features, actual selectivity)."""

    spark: SparkSession
    kind: str = "random_forest"
    trees: int = 100
    depth: int = 20
    seed: int = 42
    examples: list[tuple[QueryFeatures, float]] = field(default_factory=list)
    model: PipelineModel | _Network | None = None

    def add(self, features: QueryFeatures, actual: float) -> None:
        self.examples.append((features, actual))

    def learn_from(self, observed: DataFrame, most: int = MOST_EXAMPLES) -> None:
        """Adds the examples of a table with a column for each field of QueryFeatures and ``actual``, as observed_selectivities() gives it. Models are
        fitted on the driver's bounded store; of more rows than ``most`` those with the smallest hashes are taken."""
        names = [f.name for f in fields(QueryFeatures)]
        held = observed.select(*names, "actual").withColumn("h", F.xxhash64(*names, "actual")).orderBy("h").limit(most)
        for row in held.collect():
            self.add(QueryFeatures(**{n: row[n] for n in names}), float(row["actual"]))

    def _frame(self, rows: Sequence[QueryFeatures], actual: Sequence[float] | None = None) -> DataFrame:
        data = [(i, *f.vector(), float(actual[i]) if actual else 0.0) for i, f in enumerate(rows)]
        return self.spark.createDataFrame(data, ", ".join(["no int", *[f"{n} double" for n in FEATURES], "actual double"])).coalesce(1)

    def train(self) -> dict:
        """Fits log10 of the selectivity; returns a status and the errors on the examples."""
        if len(self.examples) < LEAST_EXAMPLES:
            return {"status": "insufficient_data", "examples": len(self.examples)}
        rows, actual = [f for f, _ in self.examples], [a for _, a in self.examples]
        if self.kind == "neural_network":
            self.model = _Network(seed=self.seed)
            self.model.fit(np.array([f.vector() for f in rows]), np.log10(np.maximum(actual, 1e-6)))
        else:
            regressors = {
                "random_forest": lambda: RandomForestRegressor(numTrees=self.trees, maxDepth=min(self.depth, 30), minInstancesPerNode=5, seed=self.seed, labelCol="y", featuresCol="scaled"),
                "gradient_boost": lambda: GBTRegressor(maxIter=self.trees, maxDepth=min(self.depth, 10), stepSize=0.1, minInstancesPerNode=5, seed=self.seed, labelCol="y", featuresCol="scaled"),
            }
            if self.kind not in regressors:
                raise ValueError(f"unknown model type: {self.kind}")
            stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), regressors[self.kind]()]
            frame = self._frame(rows, actual).withColumn("y", F.log10(F.greatest("actual", F.lit(1e-6))))
            self.model = Pipeline(stages=stages).fit(frame)
        predicted = self.predict(rows)
        report = error_report(self.spark.createDataFrame(list(zip(predicted, map(float, actual))), "predicted double, actual double")).first().asDict()
        return {"status": "trained", "examples": len(rows), **report}

    def predict(self, rows: Sequence[QueryFeatures], fallback: float | None = None) -> list[float]:
        """Selectivities in [0, 1], one job for all rows; untrained, the fallback or each row's average histogram value."""
        if self.model is None:
            return [fallback if fallback is not None else f.avg_histogram_selectivity for f in rows]
        if isinstance(self.model, _Network):
            logs = self.model.predict(np.array([f.vector() for f in rows]))
        else:
            logs = [r["prediction"] for r in self.model.transform(self._frame(rows)).orderBy("no").select("prediction").collect()]
        return [float(min(1.0, max(0.0, 10.0**x))) for x in logs]

    def cardinality(self, features: QueryFeatures, rows: int) -> int:
        return max(1, int(rows * self.predict([features])[0]))

    def importance(self) -> dict[str, float]:
        if self.model is None or isinstance(self.model, _Network):
            return {}
        return dict(zip(FEATURES, map(float, self.model.stages[-1].featureImportances.toArray())))

    def explain(self, features: QueryFeatures, top: int = 5) -> str:
        if self.model is None:
            return "The model isn't trained yet."
        best = sorted(self.importance().items(), key=lambda x: -x[1])[:top]
        head = f"Selectivity {self.predict([features])[0]:.4f} by {self.kind}"
        return "\n".join([head, *[f"  {n}: {v:.4f}" for n, v in best], f"Table of {features.table_row_count} rows, histogram estimate {features.avg_histogram_selectivity:.4f}"])

    def save(self, path: str) -> None:
        if not isinstance(self.model, PipelineModel):
            raise ValueError("only a trained tree model can be saved")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> None:
        self.model = PipelineModel.load(path)


@dataclass
class Ensemble:
    """Weighted mean of a histogram estimate, a learned one and a sampled one; a missing one counts as the histogram's."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def estimate(self, histogram: float, ml: float | None = None, sampling: float | None = None) -> float:
        given = {"histogram": histogram, "ml": histogram if ml is None else ml, "sampling": histogram if sampling is None else sampling}
        return min(1.0, max(0.0, sum(self.weights[k] * v for k, v in given.items()) / sum(self.weights.values())))

    def feedback(self, errors: Mapping[str, Sequence[float]]) -> None:
        """q-errors by estimator: each named weight becomes 1 / max(median error, 0.1), then all are scaled to sum to 1."""
        for name, values in errors.items():
            if len(values):
                self.weights[name] = 1.0 / max(float(np.median(values)), 0.1)
        total = sum(self.weights.values())
        self.weights = {k: v / total for k, v in self.weights.items()}


def ensemble_column(histogram: Column, ml: Column, sampling: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    mean = (histogram * weights["histogram"] + F.coalesce(ml, histogram) * weights["ml"] + F.coalesce(sampling, histogram) * weights["sampling"]) / sum(weights.values())
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))
