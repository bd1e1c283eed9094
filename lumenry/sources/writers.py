"""Sinks: prediction lines, the experiment log, leaderboards and state events."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracker import COLUMNS, by_family, leaderboard
from .readers import read_log

REQUIRED = ("experiment_id", "model_registry_id", "hf_model_name", "model_family", "val_metric", "json_schema_compliance")
# What a record holds that doesn't say otherwise.
DEFAULTS = {"status": "completed", "run_tag": "default", "selection_strategy": "round_robin", "checkpoint_path": "", "predictions_path": "", "metrics": {}, "config": {}, "notes": ""}


def stable_json(value: Mapping) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def predictions_path(run_tag: str, split: str, family: str) -> str:
    return f"predictions/{run_tag}_{family}_{split}_predictions.jsonl"


def write_predictions(df: DataFrame, path: str) -> None:
    """JSON lines with columns in alphabetical order and nulls kept; what is there is replaced."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def record_of(payload: Mapping) -> dict:
    """A record from parsed JSON: required fields must be there, others get their defaults; unknown ones are left out."""
    missing = [c for c in REQUIRED if payload.get(c) in (None, "")]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    record = {c: payload.get(c) if payload.get(c) is not None else default for c, default in DEFAULTS.items()}
    record |= {c: str(payload[c]) for c in REQUIRED[:4]} | {c: float(payload[c]) for c in REQUIRED[4:]}
    return record | {"timestamp_utc": str(payload.get("timestamp_utc") or utc_now())}


def log_row(record: Mapping) -> dict[str, str]:
    """A record as the log's text columns: numbers with eight decimals, tabs in notes as spaces."""
    whole = record_of(record)
    row = {c: str(whole.get(c, "")) for c in COLUMNS} | {c: f"{whole[c]:.8f}" for c in REQUIRED[4:]}
    return row | {"metrics_json": stable_json(whole["metrics"]), "config_json": stable_json(whole["config"]), "notes": whole["notes"].replace("\t", " ")}


def append_log(spark: SparkSession, log_path: str, record: Mapping, leaderboard_path: str | None = None) -> None:
    """Appends one record to the log, a folder of TSV parts with headers, and rebuilds the leaderboard if one is named.

    Each append is a part of its own, named by time, so that none rewrites another. A log with another header raises.
    """
    read_log(spark, log_path)
    row = log_row(record)
    part = f"{log_path}/part-{time.time_ns():020d}"
    spark.createDataFrame([tuple(row[c] for c in COLUMNS)], ", ".join(f"{c} string" for c in COLUMNS)).coalesce(1).write.option("header", True).option("sep", "\t").option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(part)
    if leaderboard_path:
        write_leaderboard(read_log(spark, log_path), leaderboard_path, log_path)


def write_leaderboard(log: DataFrame, path: str, source: str = "", top: int = 20) -> None:
    """The ranked leaders and the best of each family as one JSON document; replaced as a whole. It has `top` leaders and a row a family."""
    shown = ["rank", "experiment_id", "run_tag", "model_registry_id", "hf_model_name", "model_family", "selection_strategy", "status", "timestamp_utc"]
    leaders = leaderboard(log, top).select(*shown, F.col("metric").alias("val_metric"), F.col("compliance").alias("json_schema_compliance")).orderBy("rank").collect()
    families = by_family(log).collect()
    found = {
        "generated_at_utc": utc_now(), "source_results_path": source, "top_k": top, "total_experiments": sum(r["num_experiments"] for r in families),
        "leaders": [r.asDict() for r in leaders], "by_family": {r["model_family"]: {c: r[c] for c in ("best_val_metric", "best_experiment_id", "num_experiments")} for r in families},
    }
    log.sparkSession.createDataFrame([(json.dumps(found, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def utc_now(compact: bool = False) -> str:
    """The time in UTC, to the second; compact for names."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ" if compact else "%Y-%m-%dT%H:%M:%S+00:00")


def append_state(spark: SparkSession, path: str, event: Mapping) -> None:
    spark.createDataFrame([(stable_json(event),)], "value string").write.mode("append").text(path)


def write_summary(summary: Mapping, path: str | None) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(summary, sort_keys=True, indent=2), encoding="utf-8")


def summary_lines(summary: Mapping) -> list[str]:
    return [f"{k}: {v:.6f}" if isinstance(v, float) else f"{k}: {v}" for k, v in summary.items()]


def with_stable_json(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
