"""Predictions aligned to references by key: no reference is dropped, and the last prediction of a key counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing, strip

INVALID, MISSING = "invalid", "missing"


def keyed(rows: DataFrame, id_column: str) -> DataFrame:
    """Adds `key`: the stripped id; null for a null or blank one."""
    return rows.withColumn("key", F.when(~is_missing(F.col(id_column)), strip(F.col(id_column))))


def last_by_key(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order. Rows without a key are left out."""
    kept = rows.where(F.expr(" and ".join(f"{c} is not null" for c in by)))
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in by])
    return kept.groupBy(*by).agg(F.max_by(whole, F.struct(*order)).alias("row")).select(*by, "row.*")


def aligned(references: DataFrame, predictions: DataFrame, key: str = "key") -> DataFrame:
    """Every reference with its prediction's columns, and `matched`. Predictions of other keys are ignored."""
    return references.join(predictions.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unique_last(predictions: DataFrame, order: str | None = None) -> DataFrame:
    """One prediction a key, the last by `order`, or by place in the input where the rows have no such column; those without a key are left out."""
    rows = predictions if order else predictions.withColumn("_at", F.monotonically_increasing_id())
    return last_by_key(rows, ["key"], [F.col(order or "_at")]).drop("_at")


def reference_counts(rows: DataFrame, by: Sequence[str] = (), valid: str = "is_valid_json") -> DataFrame:
    """(by, examples, matched, missing, invalid) of aligned references; a missing prediction is also an invalid one, an unflagged one is valid."""
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    bad = ~F.col("matched") | ~F.coalesce(F.col(valid), F.lit(True))
    return rows.groupBy(*by).agg(F.count("*").alias("examples"), n(F.col("matched")).alias("matched"), n(~F.col("matched")).alias("missing"), n(bad).alias("invalid"))


def alignment_counts(predictions: DataFrame, references: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, prediction_rows, unkeyed, duplicates, matched, extra) of keyed predictions against distinct reference keys."""
    known = references.select("key").where("key is not null").distinct().withColumn("known", F.lit(1))
    per_key = predictions.groupBy(*by, "key").agg(F.count("*").alias("n")).join(known, "key", "left")
    has = F.col("key").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.groupBy(*by).agg(
        total(F.col("n")).alias("prediction_rows"),
        total(F.when(~has, F.col("n"))).alias("unkeyed"),
        total(F.when(has, F.col("n") - 1)).alias("duplicates"),
        total(F.when(has & F.col("known").isNotNull(), 1)).alias("matched"),
        total(F.when(has & F.col("known").isNull(), 1)).alias("extra"),
    )


def outer_labels(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, gold, predicted): labels of both sides by key; the absent side is 'missing'. Each side has one row a key."""
    joined = gold.withColumnRenamed("label", "gold").join(predicted.withColumnRenamed("label", "predicted"), list(keys), "full")
    return joined.select(*keys, F.coalesce("gold", F.lit(MISSING)).alias("gold"), F.coalesce("predicted", F.lit(MISSING)).alias("predicted"))
