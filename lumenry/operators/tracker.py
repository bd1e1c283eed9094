"""The experiment log: an append-only table from which leaderboards, decisions and histories are derived."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import safe_float, strip

# The columns of the log.
COLUMNS = (
    "timestamp_utc", "experiment_id", "run_tag", "model_registry_id", "hf_model_name", "model_family", "selection_strategy", "val_metric", "json_schema_compliance",
    "status", "checkpoint_path", "predictions_path", "metrics_json", "config_json", "notes",
)


#: Ranges of a log that are ordered by tasks of their own, at most.
BLOCKS = 128


def ranked_by() -> list[Column]:
    return [F.desc("metric"), F.desc("compliance"), F.desc("timestamp_utc"), F.asc("seq")]


def with_numbers(log: DataFrame) -> DataFrame:
    """Adds metric and compliance as numbers; what is none, and NaN, counts as 0."""
    return log.withColumns({"metric": safe_float(F.col("val_metric")), "compliance": safe_float(F.col("json_schema_compliance"))})


def leaderboard(log: DataFrame, top: int = 20) -> DataFrame:
    """The best `top` rows by metric, compliance and time, all descending, then by `seq`, with their rank. The rank is numbered over those few rows."""
    best = with_numbers(log).orderBy(*ranked_by()).limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*ranked_by())))


def by_family(log: DataFrame) -> DataFrame:
    """(model_family, best_val_metric, best_experiment_id, num_experiments)."""
    rows = with_numbers(log).withColumn("model_family", F.when(strip(F.col("model_family")) != "", F.col("model_family")).otherwise("unknown"))
    best = F.max_by("experiment_id", F.struct("metric", "compliance", "timestamp_utc", -F.col("seq")))
    return rows.groupBy("model_family").agg(F.max("metric").alias("best_val_metric"), best.alias("best_experiment_id"), F.count("*").alias("num_experiments"))


def _blocked(rows: DataFrame) -> DataFrame:
    """Adds `block`: the number of the range of `seq`, so that a window over all earlier rows is one within a block and one over the few blocks."""
    n = min(BLOCKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.approxQuantile("seq", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("seq") > bounds[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return rows.withColumn("block", search(0, len(bounds)))


def _with_carried(rows: DataFrame, of_block: Column, carried: Column) -> DataFrame:
    """Adds `earlier` to rows with a block: what the blocks before hand on. Those are few, so one task orders them."""
    return rows.join(F.broadcast(rows.groupBy("block").agg(of_block.alias("own")).select("block", carried.alias("earlier"))), "block")


def _best_with(rows: DataFrame, until: int) -> tuple[DataFrame, Column]:
    rows = _with_carried(_blocked(rows), F.max("metric"), F.max("own").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    return rows, F.greatest(F.max("metric").over(W.partitionBy("block").orderBy("seq").rowsBetween(W.unboundedPreceding, until)), F.col("earlier"))


def decisions(log: DataFrame) -> DataFrame:
    """(seq, experiment_id, metric, best_before, decision): keep if at least the best of all earlier rows."""
    rows, best = _best_with(with_numbers(log), -1)
    return rows.withColumn("best_before", F.coalesce(best, F.lit(0.0))).withColumn("decision", F.when(F.col("metric") >= F.col("best_before"), "keep").otherwise("discard")).select("seq", "experiment_id", "metric", "best_before", "decision")


def _kept(log: DataFrame) -> DataFrame:
    return with_numbers(log).where(F.upper(strip(F.col("status"))) == "KEEP")


def running_best(log: DataFrame) -> DataFrame:
    """(seq, experiment_id, metric, best_so_far) of kept rows."""
    rows, best = _best_with(_kept(log), 0)
    return rows.withColumn("best_so_far", best).select("seq", "experiment_id", "metric", "best_so_far")


def improvements(log: DataFrame) -> DataFrame:
    """(seq, experiment_id, delta) of kept rows against the kept row before; the first has none and is left out."""
    rows = _with_carried(_blocked(_kept(log)), F.max_by("metric", "seq"), F.lag("own").over(W.orderBy("block")))
    return rows.withColumn("delta", F.col("metric") - F.coalesce(F.lag("metric").over(W.partitionBy("block").orderBy("seq")), F.col("earlier"))).where("delta is not null").select("seq", "experiment_id", "delta")


def outcome_counts(log: DataFrame) -> DataFrame:
    """(status, n, share)."""
    counts = log.groupBy(F.upper(strip(F.col("status"))).alias("status")).agg(F.count("*").alias("n"))
    return counts.crossJoin(log.agg(F.count("*").alias("total"))).select("status", "n", F.try_divide(F.col("n"), F.col("total")).alias("share"))


def summary(log: DataFrame) -> DataFrame:
    """(best_experiment_id, best_val_metric, total_experiments): one row, with nulls for an empty log."""
    best = F.max_by(F.struct("experiment_id", "metric"), F.struct("metric", "compliance", "timestamp_utc", -F.col("seq")))
    return with_numbers(log).agg(best.alias("best"), F.count("*").alias("total_experiments")).select(F.col("best.experiment_id").alias("best_experiment_id"), F.col("best.metric").alias("best_val_metric"), "total_experiments")


def within_budget(rows: DataFrame, key: str, order: str, seconds: str, budget: float = 300.0) -> DataFrame:
    """The steps of each series that begin before its seconds, those of the first step aside, use up the budget. A window by key."""
    w = W.partitionBy(key).orderBy(order)
    first = F.row_number().over(w) == 1
    before = F.coalesce(F.sum(F.when(~F.col("_first"), F.coalesce(F.col(seconds), F.lit(0.0)))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_first", first).withColumn("_before", before).where(F.col("_before") < budget).drop("_first", "_before")


def loss_trend(rows: DataFrame, key: str, order: str, value: str, decay: float = 0.95, patience: int = 20, min_delta: float = 5e-4) -> DataFrame:
    """(key, steps, ema, best, stale, stopped): the smoothed last loss of each series, its best value, the steps since, and whether patience ran out.

    The rows are ordered by range, so a long series lies in several partitions; each hands on one summary of what
    it does to a state that comes in, and the few summaries of a series are put together.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, last = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and k != last:
                    yield summary_of(last, part, own)
                    own = []
                last = k
                own.append(x)
        if own:
            yield summary_of(last, part, own)

    def summary_of(k: object, part: int, losses: list[float | None]) -> pa.RecordBatch:
        known = np.array([np.nan if x is None else x for x in losses])
        n = len(known)
        gained = None if None in losses else float((1 - decay) * (decay ** np.arange(n - 1, -1, -1) * known).sum())
        # Only a new minimum can become the best, whatever the best so far; from there on the rest is settled.
        lowest = np.minimum.accumulate(np.concatenate([[np.inf], np.where(np.isnan(known), np.inf, known)]))
        at = np.flatnonzero(lowest[1:] < lowest[:-1])
        records: list[dict] = [{}] * len(at)
        for r in range(len(at) - 1, -1, -1):
            i, x = int(at[r]), float(known[at[r]])
            later = int(np.searchsorted(-known[at], -(x - min_delta), "right"))
            if later < len(at):
                records[r] = records[later] | {"at": i, "loss": x, "stopped": records[later]["stopped"] or int(at[later]) - 1 - i >= patience}
            else:
                records[r] = {"at": i, "loss": x, "best": x, "stale": n - 1 - i, "stopped": n - 1 - i >= patience}
        return pa.RecordBatch.from_arrays([pa.array([k], key_kind), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([gained], pa.float64()), pa.array([records], record_kind)], [key, "part", "n", "gained", "records"])

    ordered = rows.select(F.col(key), F.col(order).alias("at"), F.col(value).cast("double").alias("loss")).repartitionByRange(key, "at").sortWithinPartitions(key, "at", "loss").select(key, "loss")
    key_kind = to_arrow_schema(ordered.select(key).schema).field(0).type
    record_kind = pa.list_(pa.struct([("at", pa.int32()), ("loss", pa.float64()), ("best", pa.float64()), ("stale", pa.int32()), ("stopped", pa.bool_())]))
    records = "array<struct<at:int,loss:double,best:double,stale:int,stopped:boolean>>"
    parts = ordered.mapInArrow(summarise, f"`{key}` {ordered.schema[key].dataType.simpleString()}, part int, n int, gained double, records {records}")
    series = parts.groupBy(key).agg(F.sum("n").cast("int").alias("steps"), F.array_sort(F.collect_list(F.struct("part", "n", "gained", "records"))).alias("parts"))
    start = F.struct(F.lit(0.0).alias("ema"), F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(False).alias("stopped"))

    def step(s: Column, p: Column) -> Column:
        found = F.get(F.filter(p["records"], lambda r: r["loss"] < s["best"] - min_delta), F.lit(0))
        waited = s["stale"] + F.coalesce(found["at"], p["n"])
        return F.struct(
            (F.pow(F.lit(decay), p["n"]) * s["ema"] + p["gained"]).alias("ema"), F.coalesce(found["best"], s["best"]).alias("best"),
            F.coalesce(found["stale"], waited).alias("stale"), (s["stopped"] | (waited >= patience) | F.coalesce(found["stopped"], F.lit(False))).alias("stopped"),
        )

    return series.select(key, "steps", F.aggregate("parts", start, step).alias("state")).select(key, "steps", "state.*")
