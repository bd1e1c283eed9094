"""Task profiles: what to read, train, predict and score for a kind of task; preflight checks; the experiment loop."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_split, is_missing, spaced_tokens, strip
from ..operators import align, bow, lexicon, metrics, normalize
from ..operators.spans import token_labels
from ..sources import readers
from ..sources.tables import cut_lineage
from ..sources.writers import predictions_path, write_predictions

SPLITS = ("train", "val", "test")
# The data files that are looked for where none is named.
DEFAULT_FILES = {"nlp_analysis": "data/sample_survey.csv", "tagging": "data/tagging_dataset.csv", "generic": "data/generic_task.csv"}


@dataclass(frozen=True)
class TaskContext:
    profile_id: str
    split: str
    run_tag: str
    experiment_id: str
    path: str | None = None
    artifact_dir: str | None = None


@dataclass(frozen=True)
class TaskProfile:
    """load(spark, path) -> examples; train(examples) -> model; predict(model, examples) -> predictions; evaluate(examples, predictions) -> one row.

    read(lines) turns rows of a prediction file into predictions; save and load_model store a model.
    """

    profile_id: str
    description: str
    load: Callable[[SparkSession, str], DataFrame]
    train: Callable[[DataFrame], object]
    predict: Callable[[object, DataFrame], DataFrame]
    evaluate: Callable[[DataFrame, DataFrame], DataFrame]
    default_metric: str = "val_metric"
    read: Callable[[DataFrame], DataFrame] | None = None
    save: Callable[[object, str], None] | None = None
    load_model: Callable[[SparkSession, str], object] | None = None


def task_context(profile_id: str, split: str, run_tag: str, experiment_id: str, path: str | None = None, root: str = ".", artifact_dir: str | None = None) -> TaskContext:
    """A context; models go to artifacts/<profile>/<run>/<experiment> below the root unless another folder is named."""
    return TaskContext(profile_id, split, run_tag, experiment_id, path, artifact_dir or f"{root}/artifacts/{profile_id}/{run_tag}/{experiment_id}")


def config_profile(path: str | None = None, config: str | None = None) -> TaskProfile:
    """The classification profile of a configuration: its label space, weights and columns."""
    known = readers.load_config(path, config)
    return classification_profile(known.label_space, known.weights, lambda spark, p: readers.read_generic(spark, p, known))


def analysis_profile(predict: Callable[[object, DataFrame], DataFrame] | None = None, weights: Mapping[str, float] | None = None) -> TaskProfile:
    """Examples (example_id, split, raw_text, language, analysis, is_valid); predictions (example_id, payload, is_valid_json).

    The built-in predictor learns the commonest overall sentiment, to be beaten by others that are given.
    """

    def train(examples: DataFrame) -> str:
        labels = examples.where("is_valid").groupBy(F.col("analysis.overall_sentiment").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).collect()
        return labels[0]["label"] if labels else "neutral"

    def commonest(model: object, examples: DataFrame) -> DataFrame:
        payload = F.to_json(F.struct(F.lit(model).alias("overall_sentiment"), F.lit(0.5).alias("sentiment_score")))
        return examples.select("example_id", F.concat(F.lit('{"text_analysis":'), payload, F.lit("}")).alias("payload"), F.lit(True).alias("is_valid_json"))

    return TaskProfile("nlp_analysis", "nested analyses of survey texts", readers.read_survey, train, predict or commonest, lambda ex, pr: score_payloads(ex, pr, weights), read=lambda rows: rows.select("ordinal", "example_id", "payload", "is_valid_json"))


def score_payloads(examples: DataFrame, predictions: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row of all metrics of analyses: valid examples against the last prediction of each; a missing or invalid one counts as invalid."""
    order = "ordinal" if "ordinal" in predictions.columns else None
    refs = align.keyed(examples.where("is_valid"), "example_id").select("key", "raw_text", F.col("analysis").alias("gold"))
    last = align.unique_last(align.keyed(predictions, "example_id"), order).select("key", "payload", "is_valid_json")
    read = normalize.with_analysis(align.aligned(refs, last), "raw_text", "payload")
    ok = F.col("matched") & F.coalesce(F.col("is_valid_json"), F.lit(True)) & F.col("is_valid")
    rows = read.select(F.col("key").alias("id"), F.col("raw_text").alias("text"), "gold", F.when(ok, F.col("analysis")).alias("predicted"))
    return metrics.score_analyses(cut_lineage(rows), (), weights)


def evaluate_file(spark: SparkSession, profile: TaskProfile, predictions_file: str, split: str, path: str) -> tuple[dict, dict]:
    """(metrics, alignment counts) of a prediction file against a split of a data file. An unknown or empty split raises."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split}; known are {', '.join(SPLITS)}")
    examples = profile.load(spark, path).where(F.col("split") == split)
    lines = cut_lineage(readers.read_predictions(spark, predictions_file))
    keyed, refs = align.keyed(lines, "example_id"), align.keyed(examples, "example_id").select("key")
    counts = align.alignment_counts(keyed, refs).first().asDict()
    matched = align.reference_counts(align.aligned(refs, align.unique_last(keyed, "ordinal").select("key", "is_valid_json"))).first().asDict()
    if not matched["examples"]:
        raise ValueError(f"no examples in split {split}")
    scores = profile.evaluate(examples, profile.read(lines) if profile.read else lines).first().asDict()
    return scores, counts | {c: matched[c] for c in ("examples", "missing", "invalid")}


def predict_to_file(spark: SparkSession, profile: TaskProfile, context: TaskContext, family: str, root: str = ".") -> str:
    """Trains on the train split, stores the model in the context's folder, and writes the predictions of the context's split; gives their path."""
    examples = profile.load(spark, context.path)
    model = profile.train(examples.where(F.col("split") == "train"))
    if profile.save:
        profile.save(model, context.artifact_dir)
        model = profile.load_model(spark, context.artifact_dir)
    target = f"{root}/{predictions_path(context.run_tag, context.split, family)}"
    made = profile.predict(model, examples.where(F.col("split") == context.split))
    write_predictions(made.select("example_id", prediction_of(made), F.lit(True).alias("is_valid_json"), F.lit(None).cast("string").alias("validation_error")), target)
    return target


def prediction_of(made: DataFrame) -> Column:
    """The prediction as its file has it: {label}, {labels} or the payload."""
    if "predicted" in made.columns:
        return F.struct(F.col("predicted").alias("label")).alias("prediction")
    return F.struct(F.col("spans").alias("labels")).alias("prediction") if "spans" in made.columns else F.from_json("payload", f"struct<text_analysis:{normalize.ANALYSIS}>").alias("prediction")


def retried(attempt: Callable[[DataFrame, int], DataFrame], examples: DataFrame, attempts: int = 2) -> DataFrame:
    """Predictions (example_id, payload, is_valid_json, validation_error) of attempt(examples, number): only what isn't valid is
    asked for again, at most so many times; what never is keeps its last output and error."""
    left, found = examples, None
    for number in range(max(1, attempts)):
        made = normalize.with_analysis(attempt(left, number).join(left.select("example_id", "raw_text"), "example_id"), "raw_text", "payload")
        checked = cut_lineage(made.select("example_id", "payload", F.col("is_valid").alias("is_valid_json"), F.when(~F.col("is_valid"), F.lit("not a valid analysis")).alias("validation_error")))
        kept = checked if number == max(1, attempts) - 1 else checked.where("is_valid_json")
        found = kept if found is None else found.unionByName(kept)
        left = left.join(checked.where("not is_valid_json").select("example_id"), "example_id", "left_semi")
    return found


def classification_profile(labels: Sequence[str], weights: Mapping[str, float] | None = None, load: Callable | None = None) -> TaskProfile:
    """Examples (example_id, split, text, label); predictions (example_id, predicted)."""
    weights = weights or {"macro_f1": 0.8, "accuracy": 0.2}

    def read(rows: DataFrame) -> DataFrame:
        label = strip(F.try_variant_get(F.try_parse_json("payload"), "$.label", "string"))
        return rows.select("ordinal", "example_id", label.alias("predicted"), "is_valid_json")

    def evaluate(examples: DataFrame, predictions: DataFrame) -> DataFrame:
        return score_labels(examples, predictions, labels, weights)

    return TaskProfile("generic", "classification of texts", load or (lambda spark, path: spark.read.parquet(path)), lambda ex: bow.train(ex.select("text", "label"), labels), lambda m, ex: bow.predict(m, ex.select("example_id", "text"), "example_id"), evaluate, read=read, save=bow.save, load_model=bow.load)


def score_labels(examples: DataFrame, predictions: DataFrame, labels: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """One row: every example counts against the last prediction of its id; one that is missing, marked invalid or outside the label space is wrong and not compliant."""
    flagged = predictions if "is_valid_json" in predictions.columns else predictions.withColumn("is_valid_json", F.lit(True))
    refs = align.keyed(examples, "example_id").select("key", "label")
    pairs = align.aligned(refs, align.unique_last(align.keyed(flagged, "example_id"), "ordinal" if "ordinal" in flagged.columns else None).select("key", "predicted", "is_valid_json"))
    valid = F.coalesce(F.col("predicted").isin(*labels) & F.coalesce(F.col("is_valid_json"), F.lit(True)), F.lit(False))
    pairs = pairs.withColumns({"valid": valid, "predicted": F.when(valid, F.col("predicted")).otherwise("")})
    f1 = metrics.macro_f1_fixed(pairs, "label", "predicted", labels)
    rest = pairs.agg(F.count("*").alias("examples"), F.coalesce(F.avg((F.col("label") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(0.0)).alias("json_schema_compliance"))
    scored = rest.crossJoin(f1)
    return scored.withColumn("val_metric", metrics.composite({c: F.col(c) for c in ("macro_f1", "accuracy", "json_schema_compliance")}, weights))


def tagging_profile(load: Callable | None = None) -> TaskProfile:
    """Examples (example_id, split, text, labels of (start, end, type)); predictions (example_id, spans)."""

    def train(examples: DataFrame) -> DataFrame:
        spans = examples.select("text", F.inline("labels")).select(F.expr("substring(text, start + 1, end - start)").alias("phrase"), "type")
        return lexicon.train(spans)

    def read(rows: DataFrame) -> DataFrame:
        return rows.select("ordinal", "example_id", normalize.predicted_tags(F.col("payload")).alias("spans"), "is_valid_json")

    def from_csv(spark: SparkSession, path: str) -> DataFrame:
        return readers.read_tagging(spark, path).withColumnRenamed("raw_text", "text")

    return TaskProfile("tagging", "typed spans in texts", load or from_csv, train, lambda m, ex: lexicon.predict(ex.select("example_id", "text"), "example_id", m), score_spans, read=read, save=lexicon.save, load_model=lexicon.load)


def score_spans(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: span F1, typed F1 and token F1 over all examples against the last prediction of each id; a missing one, and one
    that is invalid, counts as none; 1 where neither side has any. Compliance is the share of examples with a valid one."""
    empty = F.array().cast("array<struct<start:int,end:int,type:string>>")
    flagged = predictions if "is_valid_json" in predictions.columns else predictions.withColumn("is_valid_json", F.lit(True))
    last = align.unique_last(align.keyed(flagged, "example_id"), "ordinal" if "ordinal" in flagged.columns else None).select("key", "spans", "is_valid_json")
    pairs = align.aligned(align.keyed(examples, "example_id").select("key", "text", "labels"), last)
    valid = F.coalesce(F.col("matched") & F.coalesce(F.col("is_valid_json"), F.lit(True)) & F.col("spans").isNotNull(), F.lit(False))
    pairs = pairs.withColumn("valid", valid).withColumn("spans", F.when(F.col("valid"), F.col("spans")).otherwise(empty))
    places = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    pairs = pairs.withColumns({"gold_places": places(F.col("labels")), "predicted_places": places(F.col("spans")), "tokens": spaced_tokens(F.col("text"))})
    pairs = pairs.withColumns({"gold_tokens": token_labels(F.col("tokens"), F.col("labels")), "predicted_tokens": token_labels(F.col("tokens"), F.col("spans"))})
    typed = metrics.micro_prf(pairs, "labels", "spans", empty=1.0).select(F.col("f1").alias("typed_f1"))
    span = metrics.micro_prf(pairs, "gold_places", "predicted_places", empty=1.0).select(F.col("f1").alias("span_f1"))
    scored = typed.crossJoin(span).crossJoin(metrics.token_f1(pairs, "gold_tokens", "predicted_tokens")).crossJoin(metrics.compliance(pairs, "valid"))
    return scored.withColumn("val_metric", metrics.composite({c: F.col(c) for c in ("typed_f1", "span_f1", "json_schema_compliance")}, metrics.TAGGING_WEIGHTS))


def registry(*profiles: TaskProfile) -> dict[str, TaskProfile]:
    return {p.profile_id: p for p in profiles}


def get_profile(known: Mapping[str, TaskProfile], profile_id: str) -> TaskProfile:
    if profile_id not in known:
        raise KeyError(f"unknown profile {profile_id}; known are {', '.join(sorted(known))}")
    return known[profile_id]


def preflight(examples: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """(split, examples, missing_ids, duplicate_ids, ok): each repeat of an id after the first is a duplicate."""
    ids = examples.withColumn("example_id", F.when(~is_missing(F.col("example_id")), F.col("example_id")))
    per_id = ids.groupBy(*by, "example_id").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    found = per_id.groupBy(*by).agg(total(F.col("n")).alias("examples"), total(F.when(F.col("example_id").isNull(), F.col("n"))).alias("missing_ids"), total(F.when(F.col("example_id").isNotNull(), F.col("n") - 1)).alias("duplicate_ids"))
    return found.withColumn("ok", (F.col("missing_ids") == 0) & (F.col("duplicate_ids") == 0))


@dataclass(frozen=True)
class Report:
    """What a check of a task found."""

    profile_id: str
    path: str | None
    split: str
    ok: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    summary: Mapping[str, object] = field(default_factory=dict)


def default_path(profile_id: str, path: str | None, root: str = ".") -> str | None:
    """The given path, else the profile's default file where it exists, else none."""
    file = Path(root) / DEFAULT_FILES.get(profile_id, "")
    return path or (str(file) if file.is_file() else None)


def validated(spark: SparkSession, profile: TaskProfile, split: str, path: str | None) -> Report:
    """Checks the split's name, the file, that it loads, and that the split has examples with ids of their own; an empty train split is a warning."""
    name = str(split).strip().lower()
    summary: dict[str, object] = {"split": split, "path": path or "", "default_metric": profile.default_metric, "description": profile.description}
    report = lambda errors, warnings=(): Report(profile.profile_id, path, name, not errors, tuple(errors), tuple(warnings), summary)
    if name not in SPLITS:
        return report([f"unknown split {split}; known are {', '.join(SPLITS)}"])
    if path and "://" not in path and not Path(path).exists():
        return report([f"no such file: {path}"])
    try:
        counts = {r["split"]: r for r in preflight(profile.load(spark, path)).collect()}  # a row a split
    except Exception as error:  # noqa: BLE001
        return report([f"loading failed: {str(error).splitlines()[0]}"])
    own = counts.get(name)
    found = {"split_examples": own["examples"] if own else 0, "duplicate_example_ids": own["duplicate_ids"] if own else 0, "missing_example_ids": own["missing_ids"] if own else 0}
    summary |= found | {"train_examples": counts["train"]["examples"] if "train" in counts else 0}
    errors = [text for text, bad in ((f"no examples in split {name}", not own), (f"repeated ids: {found['duplicate_example_ids']}", found["duplicate_example_ids"]), (f"rows without id: {found['missing_example_ids']}", found["missing_example_ids"])) if bad]
    return report(errors, ["the train split is empty"] if "train" not in counts and name != "train" else [])


def formatted(report: Report) -> str:
    lines = [f"profile_id: {report.profile_id}", f"split: {report.split}", f"path: {report.path or ''}", f"ok: {report.ok}"]
    lines += [f"summary_{k}: {report.summary[k]}" for k in sorted(report.summary)]
    return "\n".join([*lines, *(f"warning: {w}" for w in report.warnings), *(f"error: {e}" for e in report.errors)])


def dataset_contract() -> dict[str, object]:
    """What a survey file must and may hold."""
    return {"required": ["raw_text", "response_text"], "optional": ["example_id", "split", "language"], "fields": list(readers.ALIASES), "aliases": {k: list(v) for k, v in readers.ALIASES.items()}, "envelope": "text_analysis"}


@dataclass(frozen=True)
class ModelSpec:
    registry_id: str
    family: str
    defaults: Mapping[str, object] = field(default_factory=dict)
    description: str = ""


def registry_rows(spark: SparkSession, specs: Sequence[ModelSpec], family_defaults: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """(registry_id, family, description, defaults): each entry with its family's defaults under its own."""
    validate_registry(specs)
    own = lambda s: {k: str(v) for k, v in {**family_defaults.get(s.family, {}), **s.defaults}.items()}
    return spark.createDataFrame([(s.registry_id, s.family, s.description, own(s)) for s in specs], "registry_id string, family string, description string, defaults map<string,string>")


def validate_registry(specs: Sequence[ModelSpec], families: Sequence[str] = ()) -> None:
    """Ids must be distinct, and each of the named families must have an entry."""
    if not specs or len({s.registry_id for s in specs}) != len(specs):
        raise ValueError("the registry must have entries with distinct ids")
    if lacking := set(families) - {s.family for s in specs}:
        raise ValueError(f"no entry of family {', '.join(sorted(lacking))}")


def select_model(specs: Sequence[ModelSpec], index: int, strategy: str = "round_robin", seed: int = 17) -> ModelSpec:
    validate_registry(specs)
    return specs[index % len(specs)] if strategy == "round_robin" else random.Random(seed + index).choice(list(specs))


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def run_experiments(spark: SparkSession, profile: TaskProfile, path: str, specs: Sequence[ModelSpec], count: int, run_tag: str, split: str = "val", dry_run: bool = False, best: float = 0.0) -> list[dict]:
    """Select, train, predict, score and decide, `count` times; a failing experiment is recorded as a crash and the next one runs."""
    records = []
    for index in range(count):
        spec, began = select_model(specs, index), time.time()
        record = {"timestamp_utc": now(), "experiment_id": f"{run_tag}_{index:04d}_{spec.registry_id}", "run_tag": run_tag, "model_registry_id": spec.registry_id, "model_family": spec.family, "hf_model_name": spec.registry_id}
        try:
            if dry_run:
                record |= {"status": "dry_run", "val_metric": 0.0}
            else:
                examples = profile.load(spark, path)
                model = profile.train(examples.where(F.col("split") == "train"))
                wanted = examples.where(F.col("split") == split)
                scores = profile.evaluate(wanted, profile.predict(model, wanted)).first().asDict()
                value = round(float(scores[profile.default_metric]), 8)
                record |= {"status": "keep" if value >= best else "discard", "val_metric": value, "json_schema_compliance": scores.get("json_schema_compliance", 0.0), "metrics": scores}
                best = max(best, value)
        except Exception as error:  # noqa: BLE001
            record |= {"status": "crash", "val_metric": 0.0, "notes": str(error)[:200]}
        records.append(record | {"elapsed_seconds": time.time() - began})
    return records


def hash_splits(examples: DataFrame) -> DataFrame:
    return examples.withColumn("split", hash_split(F.col("example_id")))
