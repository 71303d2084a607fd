"""Top-k vector search: exact, and over inverted lists of a k-means quantiser."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.functions.distance import between, distance


def vector_search(
    df: DataFrame, column: str, query: Sequence[float], k: int = 10, metric: str = "cosine", where: Column | str | None = None, tie: str | None = None, keep_distance: bool = True
) -> DataFrame:
    """The k nearest rows, nearest first; ties by ``tie``. Nulls come last, after NaN (all-zero vectors under cosine).

    Only a top-k per partition leaves the executors (TakeOrderedAndProject). k of 0 gives no rows; an empty table none.
    """
    rows = df if where is None else df.where(where)
    ranked = rows.withColumn("distance", distance(F.col(column), query, metric))
    order = [F.asc_nulls_last("distance")] + ([F.asc_nulls_last(tie)] if tie else [])
    found = ranked.orderBy(*order).limit(k)
    return found if keep_distance else found.drop("distance")


@dataclass
class InvertedLists:
    """Rows with the list of their nearest centroid; the centroids are few (``lists``) and stay on the driver."""

    rows: DataFrame
    column: str
    centroids: np.ndarray

    def probe(self, query: Sequence[float], probes: int) -> list[int]:
        far = ((self.centroids - np.asarray(query, float)) ** 2).sum(1)
        return [int(i) for i in np.argsort(far, kind="stable")[:probes]]

    def search(self, query: Sequence[float], k: int = 10, probes: int = 10, metric: str = "cosine", where: Column | str | None = None, tie: str | None = None) -> DataFrame:
        """Exact top-k within the probed lists; with probes equal to the number of lists the result is exact. Rows
        without a vector are in no list. Over written lists only the probed lists' folders are read."""
        lists = self.probe(query, probes)
        kept = self.rows.where(F.col("list_id").isin(lists))
        return vector_search(kept, self.column, query, k, metric, where, tie).drop("list_id")

    def search_many(self, queries: DataFrame, id_column: str, k: int = 10, probes: int = 10, metric: str = "cosine") -> DataFrame:
        """queries(query_id, query) -> (query_id, id, distance, rank): the k best rows of the probed lists for every query.

        Queries meet the rows of their lists, so the work is that of the probed rows; ties go to the smaller id."""
        few = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centroids])
        gaps = F.transform(few, lambda c: F.aggregate(F.zip_with(c, F.col("query"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        nearest = F.slice(F.array_sort(F.transform(gaps, lambda g, i: F.struct(g.alias("gap"), i.alias("list_id")))), 1, probes)
        asked = queries.where("query IS NOT NULL").select("query_id", F.col("query").cast("array<double>").alias("query")).select("query_id", "query", F.explode(F.transform(nearest, lambda s: s["list_id"])).alias("list_id"))
        met = self.rows.select("list_id", F.col(id_column).alias("id"), F.col(self.column).cast("array<double>").alias("v")).join(asked, "list_id")
        ranked = met.select("query_id", "id", between(F.col("v"), F.col("query"), metric).alias("distance"))
        order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
        return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def write(self, path: str) -> None:
        """Rows laid out by list, so a probe reads the probed lists' folders only, and the centroids beside them."""
        self.rows.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows")
        centroids = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        self.rows.sparkSession.createDataFrame(centroids, "list_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def open(spark: SparkSession, path: str, column: str) -> InvertedLists:
        """Lists that were written before; nothing is assigned again."""
        centroids = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()]
        return InvertedLists(spark.read.parquet(f"{path}/rows"), column, np.array(centroids))


def build_inverted_lists(df: DataFrame, column: str, lists: int = 100, seed: int = 42, sample: int = 100_000, iterations: int = 10) -> InvertedLists:
    """Fit the quantiser on a bounded sample of rows and assign every row to its list."""
    usable = df.where(F.col(column).isNotNull())
    total = usable.count()
    share = min(1.0, sample / max(1, total))
    fit = usable.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    fit = fit if share >= 1 else fit.sample(share, seed)
    model = KMeans(k=min(lists, max(1, total)), seed=seed, maxIter=iterations, initMode="k-means||").fit(fit)
    centroids = np.array(model.clusterCenters())
    assigned = model.setPredictionCol("list_id").transform(usable.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))).drop("features")
    return InvertedLists(assigned, column, centroids)
