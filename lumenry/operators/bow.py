"""Multinomial naive Bayes over bags of words: counts as grouped rows, prediction as a join and an arg-max."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..sources.tables import cut_lineage


@dataclass
class Model:
    """priors (label, prior), counts (label, token, n), totals (label, total, vocabulary)."""

    priors: DataFrame
    counts: DataFrame
    totals: DataFrame
    labels: Sequence[str]


def train(examples: DataFrame, labels: Sequence[str]) -> Model:
    """Of rows (text, label); labels outside the label space are left out. Priors aren't smoothed.

    The counts are written once; priors and totals have a row a label, so they pass through the driver.
    """
    spark = examples.sparkSession
    known = examples.where(F.col("label").isin(*labels))
    docs = {r["label"]: r["docs"] for r in known.groupBy("label").agg(F.count("*").alias("docs")).collect()}
    counts = cut_lineage(known.select("label", F.explode(word_tokens(F.col("text"))).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n")))
    sums = {r["label"]: r["total"] for r in counts.groupBy("label").agg(F.sum("n").alias("total")).collect()}
    size = max(1, counts.select("token").distinct().count())
    priors = spark.createDataFrame([(x, i, docs.get(x, 0) / max(1, sum(docs.values()))) for i, x in enumerate(labels)], "label string, place int, prior double")
    totals = spark.createDataFrame([(x, sums.get(x, 0), size) for x in labels], "label string, total bigint, vocabulary bigint")
    return Model(priors, counts, totals, labels)


def save(model: Model, path: str) -> None:
    """Writes the model as tables of a folder; what is there is replaced."""
    for name in ("priors", "counts", "totals"):
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Model:
    priors, counts, totals = (spark.read.parquet(f"{path}/{name}") for name in ("priors", "counts", "totals"))
    return Model(priors, counts, totals, [r["label"] for r in priors.orderBy("place").select("label").collect()])


def predict(model: Model, docs: DataFrame, key: str) -> DataFrame:
    """(key, predicted, score): the likeliest label, unknown words included; the first label on ties.

    Every document meets every label, of which there are few; counts are joined on (label, token).
    """
    classes = model.priors.join(model.totals, "label")
    tokens = docs.select(key, F.explode_outer(word_tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("times"))
    scored = tokens.crossJoin(F.broadcast(classes)).join(model.counts, ["label", "token"], "left")
    word = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("vocabulary")))
    per_label = scored.groupBy(key, "label", "place", "prior").agg(F.sum(F.when(F.col("token").isNotNull(), F.col("times") * word)).alias("words"))
    score = F.round(F.log(F.greatest("prior", F.lit(1e-12))) + F.coalesce("words", F.lit(0.0)), 9)
    best = per_label.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("place"))).alias("best"))
    return best.select(key, F.col("best.label").alias("predicted"), F.col("best.score").alias("score"))
