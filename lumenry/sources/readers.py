"""Readers of survey, tagging and generic CSV files, prediction lines, experiment logs and key-value output."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import example_id_or_ordinal, is_missing, key_text, parse_json, split_or_hash, stable_id, strip
from ..operators.normalize import legacy_payload, tag_labels, with_analysis
from ..operators.tracker import COLUMNS, summary

# The names that each column may have, in order of preference.
ALIASES = {
    "raw_text": ("request_text", "raw_text", "text", "survey_text", "response"),
    "response_text": ("response_text", "analysis_json", "label_json", "analysis"),
    "example_id": ("example_id", "id", "record_id"),
    "split": ("split", "dataset_split"),
    "language": ("language", "lang", "locale"),
    "overall_sentiment": ("overall_sentiment", "sentiment", "document_sentiment"),
    "overall_sentiment_score": ("overall_sentiment_score", "sentiment_score", "document_sentiment_score"),
    "sentence_sentiments": ("sentence_sentiments", "sentences", "sentence_annotations"),
    "metadata": ("metadata", "metadata_entities", "entities", "entity_spans"),
    "main_themes": ("main_themes", "themes", "theme_labels", "theme_annotations"),
}
LEGACY = ("overall_sentiment", "sentence_sentiments", "metadata", "main_themes")
EXAMPLE_CONFIG = Path(__file__).with_name("example.config.json")
METRICS = ("macro_f1", "accuracy", "json_schema_compliance")


def resolve_dataset(explicit: str | None = None, folder: str = "data", name: str = "survey.csv") -> str:
    """The given path, else the named file of the folder, else its only CSV file."""
    if explicit:
        if not Path(explicit).exists():
            raise FileNotFoundError(explicit)
        return explicit
    if (Path(folder) / name).exists():
        return str(Path(folder) / name)
    files = sorted(Path(folder).glob("*.csv")) if Path(folder).is_dir() else []
    if len(files) != 1:
        raise FileNotFoundError(f"{folder} must hold {name} or exactly one CSV file; it holds {len(files)}")
    return str(files[0])


def with_ordinal(df: DataFrame, first: int = 0) -> DataFrame:
    """Adds `ordinal`, the place of a row in its file, for rows just read from files.

    Rows are counted within each input partition, and partitions are offset by the counts of those before
    them: a table with a row a partition is all that meets in one task.
    """
    marked = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    parts = marked.groupBy("_part").agg(F.count("*").alias("_n"), F.min(F.struct("_file", "_block", "_at")).alias("_where"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_where").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy("_file", "_block", "_at"))
    return marked.withColumn("_within", within).join(before, "_part").withColumn("ordinal", (F.col("_before") + F.col("_within") - 1 + first).cast("int")).drop("_part", "_at", "_file", "_block", "_within", "_before")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text. Cells may hold doubled quotes and line breaks; a byte order mark is dropped."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).option("encoding", "UTF-8").csv(path)


def lookup(columns: Sequence[str], canonical: str) -> str | None:
    """The first alias that the header has."""
    return next((a for a in ALIASES[canonical] if a in columns), None)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Renames aliases, drops unknown columns, and adds absent optional ones as null."""
    found = {c: lookup(df.columns, c) for c in ALIASES}
    if not found["raw_text"]:
        raise ValueError(f"no text column; one of {', '.join(ALIASES['raw_text'])} is needed")
    if not found["response_text"] and not any(found[c] for c in LEGACY):
        raise ValueError("neither an annotation column nor any of the older annotation columns is there")
    kept = [F.col(f"`{a}`").alias(c) if a else F.lit(None).cast("string").alias(c) for c, a in found.items()]
    return df.select(*kept, *[c for c in ("ordinal",) if c in df.columns])


def normalized(rows: DataFrame) -> DataFrame:
    """(example_id, split, raw_text, language, analysis, is_valid) of canonical rows with `ordinal`; bad rows stay, marked."""
    payload = F.coalesce(F.when(~is_missing(F.col("response_text")), F.col("response_text")), legacy_payload(F.col("overall_sentiment"), F.col("overall_sentiment_score").try_cast("double"), F.col("sentence_sentiments"), F.col("metadata"), F.col("main_themes")))
    ready = rows.withColumns({"raw_text": strip(F.col("raw_text")), "_json": payload, "example_id": example_id_or_ordinal(F.col("example_id"), F.col("ordinal"))})
    ready = ready.withColumn("split", split_or_hash(F.col("split"), F.col("example_id")))
    return with_analysis(ready, "raw_text", "_json").withColumn("is_valid", F.col("is_valid") & ~is_missing(F.col("raw_text")) & F.col("split").isNotNull()).select("example_id", "split", "raw_text", "language", "analysis", "is_valid")


def read_survey(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A survey CSV, normalised. strict: a row that is not valid raises when it is read."""
    found = normalized(canonical_columns(with_ordinal(read_csv(spark, path).select("*", "_metadata"))))
    return found.where(F.when(F.col("is_valid"), True).otherwise(F.raise_error(F.concat(F.lit("not valid: "), F.col("example_id"))).cast("boolean"))) if strict else found


def read_tagging(spark: SparkSession, path: str) -> DataFrame:
    """(example_id, split, raw_text, labels). A blank text or an unknown split raises when the row is read."""
    rows = with_ordinal(read_csv(spark, path).select("*", "_metadata"), first=1)
    given = F.col("example_id") if "example_id" in rows.columns else F.lit(None).cast("string")
    split, text = key_text(F.col("split")), strip(F.col("raw_text"))
    checked = F.when(split.isin("train", "val", "test") & ~is_missing(F.col("raw_text")), split).otherwise(F.raise_error(F.concat(F.lit("bad split or text in row "), F.col("ordinal").cast("string"))))
    return rows.select(F.coalesce(F.when(~is_missing(given), strip(given)), stable_id("tag", split, F.col("ordinal").cast("string"), text)).alias("example_id"), checked.alias("split"), text.alias("raw_text"), tag_labels(F.col("labels")).alias("labels"))


@dataclass(frozen=True)
class GenericConfig:
    """A classification task: its columns, labels and the weights of its composite score."""

    input_fields: tuple[str, ...]
    target_field: str
    label_space: tuple[str, ...]
    metrics: tuple[str, ...] = ("macro_f1", "accuracy")
    weights: Mapping[str, float] = field(default_factory=lambda: {"macro_f1": 0.8, "accuracy": 0.2})


def load_config(csv_path: str | None, explicit: str | None = None) -> GenericConfig:
    """From the given file, else the one beside the CSV file, else the packaged example; weights come out with sum 1."""
    beside = f"{os.path.splitext(csv_path)[0]}.config.json" if csv_path else None
    if explicit and not Path(explicit).exists():
        raise FileNotFoundError(explicit)
    path = explicit or (beside if beside and Path(beside).exists() else str(EXAMPLE_CONFIG))
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if raw.get("task_kind", "classification") != "classification" or raw.get("prediction_format", "json") != "json":
        raise ValueError("only classification with JSON predictions is supported")
    fields, labels, metrics = tuple(raw.get("input_fields") or ()), tuple(raw.get("label_space") or ()), tuple(raw.get("metrics") or ("macro_f1", "accuracy"))
    weights = {k: float(v) for k, v in (raw.get("val_metric") or {}).items()}
    if not fields or len(labels) < 2 or not raw.get("target_field"):
        raise ValueError("input fields, a target field and at least two labels are needed")
    if set(metrics) - set(METRICS) or set(weights) - set(metrics):
        raise ValueError(f"metrics must be among {METRICS}, and weights among the metrics")
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    total = sum(weights.values())
    return GenericConfig(fields, raw["target_field"], labels, metrics, {k: w / total for k, w in weights.items()})


def generic_text(fields: Sequence[str]) -> Column:
    return strip(F.concat_ws(" ", *[F.coalesce(strip(F.col(f"`{f}`")), F.lit("")) for f in fields]))


def read_generic(spark: SparkSession, path: str, config: GenericConfig) -> DataFrame:
    """(example_id, split, text, label). Rows without text, of an unknown label or split raise when they are read."""
    rows = with_ordinal(read_csv(spark, path).select("*", "_metadata"), first=1)
    split, label, text = key_text(F.col("split")), strip(F.col(f"`{config.target_field}`")), generic_text(config.input_fields)
    given = F.col("example_id") if "example_id" in rows.columns else F.lit(None).cast("string")
    good = split.isin("train", "val", "test") & label.isin(*config.label_space) & (text != "")
    signature = F.concat_ws("|", *[F.coalesce(F.col(f"`{f}`"), F.lit("")) for f in config.input_fields], label)
    named = F.coalesce(F.when(~is_missing(given), strip(given)), stable_id("gen", split, F.col("ordinal").cast("string"), signature))
    return rows.select(named.alias("example_id"), F.when(good, split).otherwise(F.raise_error(F.concat(F.lit("bad row "), F.col("ordinal").cast("string")))).alias("split"), text.alias("text"), label.alias("label"))


def prediction_rows(lines: DataFrame) -> DataFrame:
    """(ordinal, example_id, payload, is_valid_json, error) of lines (ordinal, value). Blank lines are skipped; one that is no
    object stays, invalid. A record without a `prediction` is its own payload; a null prediction is invalid."""
    v = parse_json(F.col("value"))
    kept = lines.where(~is_missing(F.col("value"))).withColumn("v", v)
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    inner = F.try_variant_get("v", "$.prediction", "variant")
    absent = ~F.coalesce(F.schema_of_variant("v").rlike(r"[<\s]prediction:"), F.lit(False))
    valid = F.coalesce(F.try_variant_get("v", "$.is_valid_json", "boolean"), F.lit(True))
    payload = F.when(is_object & absent, F.to_json("v")).when(is_object & ~F.coalesce(F.is_variant_null(inner), F.lit(False)), F.to_json(inner))
    error = F.when(F.col("v").isNull(), F.concat(F.lit("malformed JSON on line "), (F.col("ordinal") + 1).cast("string"))).when(~is_object, F.concat(F.lit("no object on line "), (F.col("ordinal") + 1).cast("string")))
    return kept.select("ordinal", F.when(is_object, F.try_variant_get("v", "$.example_id", "string")).alias("example_id"), payload.alias("payload"), (is_object & valid & payload.isNotNull()).alias("is_valid_json"), error.alias("error"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return prediction_rows(with_ordinal(spark.read.text(path).select("value", "_metadata")).select("ordinal", "value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The experiment log, with `seq`: a file, or a folder as `append_log` writes it, whose parts sort by the time of
    their writing. Its header must be exactly that of the log. A missing or empty log has no rows."""
    try:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    except AnalysisException:
        rows = None
    if rows is None or not rows.columns:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS) + ", seq int")
    if tuple(rows.columns) != COLUMNS:
        raise ValueError(f"unexpected header: {rows.columns}")
    return with_ordinal(rows.select("*", "_metadata")).withColumnRenamed("ordinal", "seq").drop("_metadata")


def with_parsed(log: DataFrame) -> DataFrame:
    """Adds `metrics` and `config`, maps of the numbers and texts of metrics_json and config_json; empty where these are blank, broken or no objects."""
    as_map = lambda c, kind: F.coalesce(F.try_variant_get(parse_json(F.col(c)), "$", f"map<string,{kind}>"), F.create_map().cast(f"map<string,{kind}>"))
    return log.withColumns({"metrics": as_map("metrics_json", "double"), "config": as_map("config_json", "string")})


def best_metric(log: DataFrame) -> float:
    """The best metric so far; 0 for an empty log, and where it is no number."""
    return float(summary(log).first()["best_val_metric"] or 0.0)


def read_leaderboard(spark: SparkSession, path: str) -> dict:
    """A written leaderboard; {} if there is none."""
    try:
        rows = spark.read.option("wholetext", True).text(path).collect()  # one row
    except AnalysisException:
        return {}
    return json.loads(rows[0]["value"]) if rows else {}


def key_values(lines: DataFrame) -> DataFrame:
    """(key, value) of `key: value` lines (ordinal, value); the last of a key counts, lines without a colon don't."""
    parts = F.split("value", ":", 2)
    found = lines.where(F.contains("value", F.lit(":"))).select("ordinal", strip(parts[0]).alias("key"), strip(parts[1]).alias("value"))
    return found.groupBy("key").agg(F.max_by("value", "ordinal").alias("value"))
