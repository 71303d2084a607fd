"""The training-data queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm import cooccurrence, leakage, mixing, name_variants, product_matching, set_similarity, similar_vectors, text_quality
from tessela.runtime import read


VECTORS = {"embedding": 384, "image_embedding": 512}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors.nearest(read(spark, sf_dir, "products"), "product_id", "last_updated", VECTORS, 10)
    pair = F.least("id", "near").cast("int"), F.greatest("id", "near").cast("int")
    return near.select("field", pair[0].alias("product_id_a"), pair[1].alias("product_id_b")).distinct()


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids divisible by 100, their exact neighbours among all rows against those found; at least nine in ten."""
    told = similar_vectors.recall(read(spark, sf_dir, "products"), "product_id", "last_updated", VECTORS, 10)
    return told.select("field", "queries", (F.col("found") >= F.lit(0.9) * F.col("wanted")).alias("recall_is_enough"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(read(spark, sf_dir, "research_papers"), "id", "authors")


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.link_names(read(spark, sf_dir, "research_papers"), "id", "authors")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.frequent_pairs(read(spark, sf_dir, "order_items"), "order_id", "product_id", 6, 3.0)
    return found.select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cooccurrence.frequent_pairs(read(spark, sf_dir, "order_items"), "order_id", "product_id", 6, 3.0)
    return found.select(
        F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"), F.col("n").cast("long").alias("n"),
        F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), F.round("lift", 6).alias("lift"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = product_matching.same_product_pairs(read(spark, sf_dir, "products"), "product_id", "last_updated")
    return pairs.select(F.col("product_id_a").cast("int").alias("product_id_a"), F.col("product_id_b").cast("int").alias("product_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_matching.group_listings(read(spark, sf_dir, "products"), "product_id", "last_updated")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = set_similarity.normalised_sets(read(spark, sf_dir, "research_papers"), "id", "keywords", 5).withColumn("table", F.lit("papers"))
    images = set_similarity.normalised_sets(read(spark, sf_dir, "images"), "id", "tags", 5).withColumn("table", F.lit("images"))
    return papers.unionByName(images)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = set_similarity.similar_records(_sets(spark, sf_dir), 0.6)
    mixed = F.col("table_a") != F.col("table_b")
    paper_first = F.col("table_a") == "papers"
    return pairs.select(
        F.when(mixed, F.lit("papers_images")).otherwise(F.col("table_a")).alias("side"),
        F.when(mixed & ~paper_first, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"),
        F.when(mixed & ~paper_first, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"),
    )


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = set_similarity.similarity_degrees(_sets(spark, sf_dir).distinct(), 0.6)
    return links.select(F.col("table").alias("side"), "id", F.col("links").cast("long").alias("links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))
    return report.where("short").select("source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.quality(read(spark, sf_dir, "documents")).where("not_prose").select("doc_id").distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.quality(read(spark, sf_dir, "documents"))


_NEAREST = """
WITH u AS (
  SELECT 'embedding' AS field, product_id AS id, last_updated AS t, embedding::DOUBLE[] AS v FROM products WHERE len(embedding) = 384
  UNION ALL SELECT 'image_embedding', product_id, last_updated, image_embedding::DOUBLE[] FROM products WHERE len(image_embedding) = 512
), f AS (SELECT * FROM u WHERE list_bool_and(list_transform(v, lambda x: isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
l AS (SELECT field, id, max_by(v, coalesce(t, TIMESTAMP '1900-01-01')) AS v FROM f GROUP BY 1, 2),
s AS (SELECT x.field, x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM l x JOIN l y ON x.field = y.field AND x.id <> y.id),
r AS (SELECT field, a, b, row_number() OVER (PARTITION BY field, a ORDER BY round(c, 7) DESC, b) AS n FROM s)
SELECT DISTINCT field, least(a, b)::INTEGER AS product_id_a, greatest(a, b)::INTEGER AS product_id_b FROM r WHERE n <= 10
"""

_PAIR_COUNTS = """
WITH r AS (SELECT DISTINCT order_id, product_id FROM order_items WHERE order_id IS NOT NULL AND product_id IS NOT NULL),
c AS (SELECT product_id, count(*) AS n FROM r GROUP BY 1), t AS (SELECT count(DISTINCT order_id) AS n FROM r),
j AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n FROM r x JOIN r y ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2 HAVING count(*) >= 6)
"""

_SETS = r"""
WITH v AS (
  SELECT 'papers' AS side, id, lower(regexp_replace(k, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS k FROM (SELECT id, unnest(keywords) AS k FROM research_papers)
  UNION ALL
  SELECT 'images', id, lower(regexp_replace(k, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) FROM (SELECT id, unnest(tags) AS k FROM images)
), s AS (SELECT DISTINCT side, id, k FROM v WHERE k IS NOT NULL AND k <> ''),
z AS (SELECT side, id, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT s.side, s.id, s.k, z.n FROM s JOIN z ON s.side = z.side AND s.id = z.id),
p AS (
  SELECT x.side AS side_a, x.id AS id_a, y.side AS side_b, y.id AS id_b FROM f x JOIN f y ON x.k = y.k AND (x.side > y.side OR x.side = y.side AND x.id < y.id)
  GROUP BY x.side, x.id, x.n, y.side, y.id, y.n HAVING count(*) >= 0.6 * (x.n + y.n - count(*))
)
"""


# Words and signs stand for tokens: the cases don't hinge on the tokenizer.
_SHORT = r"""
WITH g AS (SELECT source, any_value(target_share)::DOUBLE AS share, any_value(max_repeats) AS repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
o AS (SELECT source, sum(len(regexp_extract_all(text, '\w+|[^\w\s]'))) AS n FROM documents WHERE doc_id IS NOT NULL AND source IN (SELECT source FROM g) GROUP BY 1)
SELECT g.source FROM g LEFT JOIN o USING (source) WHERE share * (SELECT sum(n) FROM o) > repeats * coalesce(n, 0)
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_recall": p1_recall, "p2_found": p2_found, "p2_entities": p2_entities, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_links": p6_links, "p7_found": p7_found, "p8_found": p8_found, "p8_report": p8_report, "p8_plan": p8_plan, "p9_found": p9_found, "p9_statistics": p9_statistics}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _NEAREST,
        "p1_recall": _NEAREST[: _NEAREST.index("s AS (SELECT x.field")].rstrip().rstrip(",") + " SELECT field, count(*) AS queries, true AS recall_is_enough FROM l WHERE id % 100 = 0 GROUP BY 1",
        "p4_found": _PAIR_COUNTS
        + """SELECT j.a AS product_id_a, j.b AS product_id_b FROM j JOIN c x ON x.product_id = j.a JOIN c y ON y.product_id = j.b, t
WHERE j.n::DOUBLE * t.n / (x.n * y.n) >= 3""",
        "p4_scores": _PAIR_COUNTS
        + """SELECT j.a AS product_id_a, j.b AS product_id_b, j.n AS n, x.n AS n_a, y.n AS n_b, round(j.n::DOUBLE * t.n / (x.n * y.n), 6) AS lift
FROM j JOIN c x ON x.product_id = j.a JOIN c y ON y.product_id = j.b, t WHERE j.n::DOUBLE * t.n / (x.n * y.n) >= 3""",
        "p6_found": _SETS + """SELECT CASE WHEN side_a = side_b THEN side_a ELSE 'papers_images' END AS side, id_a, id_b FROM p""",
        "p8_found": _SHORT,
        "p6_links": _SETS
        + """, e AS (SELECT side_a AS side, id_a AS id FROM p UNION ALL SELECT side_b, id_b FROM p)
SELECT z.side, z.id, count(e.id) AS links FROM z LEFT JOIN e ON e.side = z.side AND e.id = z.id GROUP BY 1, 2""",
    }
