"""Mixing sources to target weights: soft memberships, and document rates by projected-gradient least squares.

A document with a source of the target table belongs to it. For the others a classifier, fitted on a bounded sample of the labelled ones,
predicts how likely each source is. Rates (expected copies) are then fitted between 0 and the permitted repeats so that each
source's expected tokens meet its target. Documents of equal membership and limit move alike in every step, so the
iterations run over their sums of tokens: a row for each labelled source and one for each different prediction.

The fit runs twice: over the documents of known source alone, which tells the sources that can't reach their target by themselves (their
documents stand at their limit and tokens are missing still), and from there over all documents.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.runtime import checkpoint

#: The tokenizer's file; None takes the byte-level vocabulary of the public_tokenizers package.
TOKENIZER: str | None = None
#: Labelled rows that the classifier is fitted on at most; everything else covers all documents.
SAMPLE = 20_000
FEATURES = 1 << 12
STEPS = 200
TOLERANCE = 1e-4
#: Steps of which the updates are chained before the rates are written.
CHAIN = 8


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = TOKENIZER) -> DataFrame:
    """docs with the text replaced by its number of tokens; a null text has none. Whole texts are counted."""
    others = [c for c in docs.columns if c != text]
    slim = docs.select(*others, text)

    def run(batches):
        import base64

        import public_tokenizers
        import tiktoken

        path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*others, "tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes if c != text) + ", tokens long"
    return slim.mapInArrow(run, schema)


def predict_sources(labelled: DataFrame, unlabelled: DataFrame, sources: list[str], sample: int = SAMPLE) -> DataFrame:
    """labelled(doc_id, text, source), unlabelled(doc_id, key, text) -> (doc_id, key, m0, m1, ...), probabilities in the order of sources."""
    known = labelled.where("text IS NOT NULL")
    total = known.count()
    place = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(float(i)))])
    share = min(1.0, sample / max(1, total))
    fit = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).withColumn("label", F.try_element_at(place, F.col("source")))
    fit = checkpoint(fit.select("label", "text"))
    classes = sorted(int(r["label"]) for r in fit.select("label").distinct().collect())
    blank = unlabelled.withColumn("text", F.coalesce("text", F.lit("")))
    if len(classes) < 2:
        return blank.select("doc_id", "key", *[F.lit(1.0 if i in classes else 0.0).alias(f"m{i}") for i in range(len(sources))])
    back = {c: i for i, c in enumerate(classes)}
    dense = F.create_map(*[x for c, i in back.items() for x in (F.lit(float(c)), F.lit(float(i)))])
    model = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=2),
            HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True),
            LogisticRegression(labelCol="dense", maxIter=20, regParam=1e-3),
        ]
    ).fit(fit.withColumn("dense", F.try_element_at(dense, F.col("label"))))
    told = model.transform(blank.select("doc_id", "key", "text")).select("doc_id", "key", vector_to_array("probability").alias("p"))
    return told.select("doc_id", "key", *[(F.round(F.col("p")[back[i]], 6) if i in back else F.lit(0.0)).alias(f"m{i}") for i in range(len(sources))])


def _dot(weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"m{i}") * F.lit(w) for i, w in enumerate(weights)])


class Fit(NamedTuple):
    """rated: the members with their rate. totals: each source's expected tokens. residual: by how much of all wanted tokens the totals miss the targets."""

    rated: DataFrame
    totals: list[float]
    steps: int
    converged: bool
    residual: float


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """members(tokens, cap, start, m0, m1, ...), start being the first rate.

    Minimises the sum over sources of (expected tokens - target)^2 / supply within 0 <= rate <= cap, in steps scaled by
    the documents' tokens, for which a step of 1 can't overshoot. Every step is one pass over the members by arrays, in which each partition
    adds up its expected tokens; steps are chained, and the rates written after CHAIN of them. The fit has converged once no source's
    tokens move by more than tolerance of the mean target."""
    count = len(targets)
    m = [f"m{i}" for i in range(count)]
    table = checkpoint(members.select("tokens", "cap", F.least("start", "cap").alias("rate"), *m))
    schema = ", ".join(f"{c} double" for c in m)
    pulls: list[np.ndarray] = []

    def moved(batch: pa.RecordBatch, chained: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cap, rate = batch.column("cap").to_numpy(), batch.column("rate").to_numpy()
        share = np.stack([batch.column(c).to_numpy() for c in m], axis=1)
        for pull in chained:
            rate = np.clip(rate - share @ pull, 0.0, cap)
        return batch.column("tokens").to_numpy().astype(np.float64), rate, share

    def sums(table: DataFrame, weigh: bool) -> np.ndarray:
        chained = list(pulls)

        def run(batches):
            for batch in batches:
                tokens, rate, share = moved(batch, chained)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (tokens * rate if weigh else tokens) @ share], m)

        row = table.mapInArrow(run, schema).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in m]).first()
        return np.array([row[c] for c in m], np.float64)

    def rated() -> DataFrame:
        chained = list(pulls)

        def run(batches):
            for batch in batches:
                _, rate, _ = moved(batch, chained)
                yield pa.RecordBatch.from_arrays([batch.column("tokens"), batch.column("cap"), pa.array(rate), *[batch.column(c) for c in m]], ["tokens", "cap", "rate", *m])

        return table.mapInArrow(run, "tokens long, cap double, rate double, " + schema)

    goals = np.array(targets, np.float64)
    whole = max(1.0, float(goals.sum()))
    supply = sums(table, weigh=False)
    totals, taken, converged = sums(table, weigh=True), 0, False
    while taken < steps and not converged:
        pulls.append(np.where(supply > 0, (totals - goals) / np.maximum(supply, 1e-300), 0.0))
        taken += 1
        if len(pulls) == CHAIN:
            table = checkpoint(rated())
            pulls.clear()
        after = sums(table, weigh=True)
        converged = bool(np.abs(after - totals).max(initial=0.0) <= tolerance * whole / count)
        totals = after
    return Fit(rated(), totals.tolist(), taken, converged, float(np.abs(totals - goals).sum() / whole))


def mix(
    documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = TOKENIZER, sample: int = SAMPLE
) -> tuple[DataFrame, DataFrame]:
    """(report, plan) of the mixture.

    targets(source, target_share, max_repeats) must be of bounded size, one row a source. report has a row for each of
    them: own_tokens, wanted_tokens (its share of the tokens of all documents with a source of the table), possible_tokens (own
    times max_repeats), short (fitted by themselves, the source's documents stand at their limit and stay below the target), mixed_tokens and expected_share (what the fitted rates give, memberships of
    unlabelled documents included), actual_tokens and actual_share (what the plan's whole copies give), converged and residual (the share of all wanted tokens
    by which the fitted totals miss the targets). plan has a row for each document: tokens, rate (expected copies) and
    copies (whole, the fraction decided by the id's hash).

    Defined cases: a null text has no tokens; a null or foreign source makes a document unlabelled; null ids are dropped; equal ids
    with equal rows count as often as they stand there; a target without documents is short unless its share is 0; a null
    share or limit counts as 0; empty tables give empty results.
    """
    goals = targets.select(
        F.col("source").alias("source"), F.coalesce(F.col("target_share").cast("decimal(9,6)"), F.lit(0).cast("decimal(9,6)")).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("repeats")
    )
    goals = sorted(goals.where("source IS NOT NULL").distinct().collect(), key=lambda r: r["source"])
    spark = documents.sparkSession
    report_schema = "source string, target_share double, max_repeats int, own_tokens long, wanted_tokens double, possible_tokens long, short boolean, mixed_tokens double, expected_share double, actual_tokens double, actual_share double, converged boolean, residual double"
    plan_schema = "doc_id long, source string, tokens long, rate double, copies long"
    if not goals:
        return spark.createDataFrame([], report_schema), spark.createDataFrame([], plan_schema)
    sources = [r["source"] for r in goals]
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    counted = checkpoint(count_tokens(docs, "text", tokenizer))
    listed = F.coalesce(F.col("source").isin(sources), F.lit(False))
    own = {r["source"]: r["t"] for r in counted.where(listed).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(own.values())
    targets_t = [float(r["share"]) * total for r in goals]
    repeats = [float(r["repeats"]) for r in goals]
    m = [f"m{i}" for i in range(len(sources))]
    one_hot = [F.when(F.col("source") == s, 1.0).otherwise(0.0).alias(c) for s, c in zip(sources, m)]
    labelled = counted.where(listed).select("doc_id", "source", "tokens", *one_hot)
    foreign = counted.where(~listed)
    cap = F.round(_dot(repeats), 6)
    known = checkpoint(labelled.withColumn("cap", cap).groupBy(*m, "cap").agg(F.sum("tokens").alias("tokens")))
    alone = fit_rates(known.withColumn("start", F.lit(1.0)), targets_t)
    stuck = {i for r in alone.rated.where("rate < cap").collect() for i, c in enumerate(m) if r[c] > 0}
    short = [i not in stuck and got < goal - 1e-9 * max(1.0, total) for i, (got, goal) in enumerate(zip(alone.totals, targets_t))]
    labelled = labelled.withColumn("cap", cap)
    if foreign.limit(1).count() and own:
        told = checkpoint(predict_sources(docs.where(listed), docs.where(~listed).dropDuplicates(["doc_id", "key"]), sources, sample))
        rest = foreign.join(told, ["doc_id", "key"]).drop("key").withColumn("cap", cap)
        alike = labelled.unionByName(rest).groupBy(*m, "cap").agg(F.sum("tokens").alias("tokens"))
        begun = alone.rated.select(*m, "cap", F.col("rate").alias("start"))
        fit = fit_rates(alike.join(F.broadcast(begun), [*m, "cap"], "left").withColumn("start", F.coalesce("start", F.lit(1.0))), targets_t)
        rest = rest.join(fit.rated.select(*m, "cap", "rate"), [*m, "cap"])
    else:
        fit = alone
        rest = foreign.select("doc_id", "source", "tokens", *[F.lit(0.0).alias(c) for c in [*m, "cap", "rate"]])
    # One row for each source: all documents of known source share these few keys.
    few = fit.rated.join(F.broadcast(known.select(*m, "cap")), [*m, "cap"], "left_semi").select(*m, "cap", "rate")
    totals = fit.totals
    luck = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    drawn = labelled.join(F.broadcast(few), [*m, "cap"]).unionByName(rest).withColumn("copies", copies)
    row = drawn.agg(*[F.coalesce(F.sum(F.col("copies") * F.col("tokens") * F.col(c)), F.lit(0.0)).alias(c) for c in m]).first()
    built = [float(row[c]) for c in m]
    mixed, whole = sum(totals) or 1.0, sum(built) or 1.0
    rows = []
    for r, got, real, lacks in zip(goals, totals, built, short):
        tokens, possible = own.get(r["source"], 0), r["repeats"] * own.get(r["source"], 0)
        rows.append((r["source"], float(r["share"]), r["repeats"], tokens, float(r["share"] * total), possible, lacks, got, got / mixed, real, real / whole, fit.converged, fit.residual))
    report = spark.createDataFrame(rows, report_schema)
    return report, drawn.select("doc_id", "source", "tokens", "rate", "copies")
