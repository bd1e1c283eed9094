"""Metrics of aligned predictions. Each is one aggregation, for all rows or by group columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_text
from .align import outer_labels

# Default weights of the composite score of nested analyses, and of span tagging.
ANALYSIS_WEIGHTS = {"overall_sentiment_macro_f1": 0.30, "sentence_sentiment_macro_f1": 0.20, "metadata_span_f1": 0.20, "theme_f1": 0.15, "emotion_f1": 0.10, "json_schema_compliance": 0.05}
TAGGING_WEIGHTS = {"typed_f1": 0.60, "span_f1": 0.30, "json_schema_compliance": 0.10}


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(empty))


def _label_counts(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str]) -> DataFrame:
    """(by, label, tp, fp, fn): one pass over the pairs, whatever the number of labels."""
    hit = F.col(gold).eqNullSafe(F.col(predicted))
    one = lambda c: c.cast("int")
    rows = F.array(
        F.struct(F.col(gold).alias("label"), one(hit).alias("tp"), F.lit(0).alias("fp"), one(~hit).alias("fn")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), one(~hit).alias("fp"), F.lit(0).alias("fn")),
    )
    return pairs.select(*by, F.inline(rows)).where("label is not null").groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def macro_f1(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, macro_f1) over the labels that occur as gold or predicted; 0 for no rows."""
    scored = _label_counts(pairs, gold, predicted, by).withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return scored.groupBy(*by).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def macro_f1_fixed(pairs: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """macro_f1 over a given label space, whether or not its labels occur."""
    counts = _label_counts(pairs, gold, predicted, ())
    space = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    scored = space.join(counts, "label", "left").withColumn("f1", _f1(F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0)), F.coalesce("fn", F.lit(0))))
    return scored.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def accuracy(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(F.coalesce(F.avg(F.col(gold).eqNullSafe(F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def label_scores(pairs: DataFrame, gold: str, predicted: str, valid: str, by: Sequence[str]) -> DataFrame:
    """(by, macro_f1, accuracy, json_schema_compliance) in one pass over the pairs: all three come from counts by (gold, predicted, valid)."""
    by = list(by)
    cells = pairs.groupBy(*by, F.col(gold).alias("g"), F.col(predicted).alias("p"), F.col(valid).alias("v")).agg(F.count("*").alias("n"))
    hit = F.col("g").eqNullSafe(F.col("p"))
    rest = cells.groupBy(*by).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("v"), F.col("n")).otherwise(0)).alias("valid"), F.sum("n").alias("n"))
    sides = F.array(
        F.struct(F.col("g").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("wrong")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("wrong")),
    )
    per_label = cells.select(*by, F.inline(sides)).where("label is not null").groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("wrong").alias("wrong"))
    f1 = per_label.groupBy(*by).agg(F.avg(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong"))).alias("macro_f1"))
    return f1.join(rest, by).select(*by, "macro_f1", ratio(F.col("hits"), F.col("n")).alias("accuracy"), ratio(F.col("valid"), F.col("n")).alias("json_schema_compliance"))


def sample_set_f1(rows: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, set_f1): the mean of each row's F1 of two arrays as sets; two empty ones agree fully."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    both = F.size(F.array_intersect(g, p))
    score = F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).otherwise(ratio(2 * both, F.size(g) + F.size(p)))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("set_f1"))


def micro_prf(rows: DataFrame, gold: str, predicted: str, by: Sequence[str] = (), empty: float = 0.0) -> DataFrame:
    """(by, precision, recall, f1) over all elements of the rows' sets; `empty` if neither side has any."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    sums = rows.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("hit", F.size(F.array_intersect(g, p))), ("gold_n", F.size(g)), ("pred_n", F.size(p)))])
    none = (F.col("gold_n") == 0) & (F.col("pred_n") == 0)
    value = lambda top, bottom: F.when(none, F.lit(empty)).otherwise(ratio(top, bottom))
    return sums.select(*by, value(F.col("hit"), F.col("pred_n")).alias("precision"), value(F.col("hit"), F.col("gold_n")).alias("recall"), value(2 * F.col("hit"), F.col("pred_n") + F.col("gold_n")).alias("f1"))


def token_f1(rows: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, token_f1) of two arrays of token labels of equal length; 1 if no token has a label on either side."""
    pairs = rows.select(*by, F.inline(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))))
    hit = (F.col("g") == F.col("p")) & (F.col("g") != "O")
    miss = F.col("g") != F.col("p")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    sums = pairs.groupBy(*by).agg(n(hit).alias("tp"), n(miss & (F.col("p") != "O")).alias("fp"), n(miss & (F.col("g") != "O")).alias("fn"))
    return sums.select(*by, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), empty=1.0).alias("token_f1"))


def compliance(rows: DataFrame, valid: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.col(valid).cast("double")), F.lit(0.0)).alias("json_schema_compliance"))


def composite(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The weighted mean; a metric that is missing counts as 0."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    found = F.lit(0.0)
    for name, weight in weights.items():
        found = found + F.lit(weight / total) * F.coalesce(scores.get(name, F.lit(None)).cast("double"), F.lit(0.0))
    return found


def entity_keys(text: Column, entities: Column, typed: bool) -> Column:
    """What identifies each entity: where its name first stands in the text, else the name; with its type if typed."""

    def key(m: Column) -> Column:
        at = F.call_function("instr", text, m["metadata_name"]) - 1
        found = at >= 0
        return F.struct(
            F.when(found, at).otherwise(-1).alias("start"), F.when(found, at + F.length(m["metadata_name"])).otherwise(-1).alias("end"),
            F.when(found, "").otherwise(m["metadata_name"]).alias("name"), (key_text(m["metadata_type"]) if typed else F.lit("")).alias("type"),
        )

    return F.array_distinct(F.transform(entities, key))


def score_analyses(rows: DataFrame, by: Sequence[str] = (), weights: Mapping[str, float] | None = None) -> DataFrame:
    """(by, 12 metrics, val_metric) of rows (id, text, gold, predicted), analyses of which predicted is null if invalid.

    An invalid prediction is the label 'invalid' and has no sentences, entities, themes or emotions. A sentence
    that only one side has is 'missing' on the other; of equal sentences in a record the last counts. The rows
    are read once for each metric, so they should be a written table.
    """
    by = list(by)
    none = lambda c, field: F.coalesce(F.transform(c["main_themes"], lambda t: key_text(t[field])), F.array().cast("array<string>"))
    entities = lambda c, typed: F.coalesce(entity_keys(F.col("text"), c["metadata"], typed), F.array().cast("array<struct<start:int,end:int,name:string,type:string>>"))
    g, p = F.col("gold"), F.col("predicted")
    wide = rows.select(
        *by, "id", g["overall_sentiment"].alias("gold_label"), F.coalesce(p["overall_sentiment"], F.lit("invalid")).alias("predicted_label"), p.isNotNull().alias("valid"),
        *[f(c, x).alias(f"{side}_{name}") for side, c in (("gold", g), ("predicted", p)) for name, f, x in (("themes", none, "theme"), ("emotions", none, "emotion"), ("spans", entities, False), ("typed", entities, True))],
    )
    labels = lambda c: F.transform(F.coalesce(c["sentence_sentiments"], F.array().cast("array<struct<sentence:string,sentence_sentiment:string,sentence_sentiment_score:double>>")), lambda s, i: F.struct(s["sentence"].alias("sentence"), s["sentence_sentiment"].alias("label"), i.alias("place")))
    last = lambda c: rows.select(*by, "id", F.inline(labels(c))).groupBy(*by, "id", "sentence").agg(F.max_by("label", "place").alias("label"))
    sentences = outer_labels(last(g), last(p), [*by, "id", "sentence"])
    parts = [
        macro_f1(wide, "gold_label", "predicted_label", by).withColumnRenamed("macro_f1", "overall_sentiment_macro_f1"),
        macro_f1(sentences, "gold", "predicted", by).withColumnRenamed("macro_f1", "sentence_sentiment_macro_f1"),
        accuracy(sentences, "gold", "predicted", by).withColumnRenamed("accuracy", "sentence_sentiment_accuracy"),
        *[micro_prf(wide, f"gold_{n}", f"predicted_{n}", by).withColumnsRenamed({k: f"metadata_{m}_{k}" for k in ("precision", "recall", "f1")}) for n, m in (("spans", "span"), ("typed", "typed"))],
        sample_set_f1(wide, "gold_themes", "predicted_themes", by).withColumnRenamed("set_f1", "theme_f1"),
        sample_set_f1(wide, "gold_emotions", "predicted_emotions", by).withColumnRenamed("set_f1", "emotion_f1"),
        compliance(wide, "valid", by),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.join(part, by, "left") if by else found.crossJoin(part)
    found = found.fillna(0.0)
    score_weights = ANALYSIS_WEIGHTS | dict(weights or {})
    return found.withColumn("val_metric", composite({c: F.col(c) for c in found.columns if c not in by}, score_weights))
