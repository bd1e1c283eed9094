"""State events as a stream: the best metric of each family, kept up to date as experiments end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_float, strip

EVENT = "timestamp_utc string, experiment_id string, model_family string, status string, val_metric string"


def state_events(spark: SparkSession, path: str) -> DataFrame:
    """New JSON lines of a folder; lines that don't parse come out with nulls."""
    return spark.readStream.schema(EVENT).json(path)


def best_by_family(events: DataFrame) -> DataFrame:
    """(model_family, best_val_metric, best_experiment_id, num_experiments) of completed experiments."""
    done = events.where("status is not null and status <> 'crash'").withColumn("metric", safe_float(F.col("val_metric")))
    family = F.when(strip(F.col("model_family")) != "", F.col("model_family")).otherwise("unknown")
    return done.groupBy(family.alias("model_family")).agg(F.max("metric").alias("best_val_metric"), F.max_by("experiment_id", F.struct("metric", "timestamp_utc")).alias("best_experiment_id"), F.count("*").alias("num_experiments"))


def hourly_outcomes(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(hour, status, n): experiments by the hour they ended in; those later than the lateness are dropped by the watermark."""
    at = events.withColumn("at", F.to_timestamp("timestamp_utc")).withWatermark("at", lateness)
    return at.groupBy(F.window("at", "1 hour"), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "status", "n")
