"""Annotation payloads in any of their shapes brought to one typed structure, with a validity flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing, let, parse_json, sentiment, strip

ANALYSIS = (
    "struct<overall_sentiment:string,sentiment_score:double,"
    "main_themes:array<struct<theme:string,theme_sentiment:string,theme_sentiment_score:double,theme_relevance_score:double,emotion:string,emotion_sentiment:string,emotion_intensity_score:double,theme_associated_phrases:array<string>>>,"
    "sentence_sentiments:array<struct<sentence:string,sentence_sentiment:string,sentence_sentiment_score:double>>,"
    "metadata:array<struct<metadata_type:string,metadata_name:string,metadata_sentiment:string,metadata_sentiment_score:double>>>"
)
_ITEMS = "array<variant>"


def _get(v: Column, kind: str, *names: str) -> Column:
    """The first of the fields that is there."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _number(v: Column, default: float, *names: str) -> Column:
    """The first of the fields as a number: the default if none is there, null if it is no number."""
    return F.when(_get(v, "variant", *names).isNull(), F.lit(default)).otherwise(_get(v, "double", *names))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _items(v: Column, *names: str) -> Column:
    """An array field, also one given as JSON text; empty if it isn't there."""
    return F.coalesce(_get(v, _ITEMS, *names), F.try_variant_get(parse_json(_get(v, "string", *names)), "$", _ITEMS), F.array().cast(_ITEMS))


def span_text(source: Column, given: Column, start: Column, end: Column) -> Column:
    """The given text, or the stretch between the offsets; null if there is neither or they disagree."""
    cut = F.when((start >= 0) & (end >= start), F.substring(source, start + 1, end - start))
    return let(F.struct(cut.alias("cut"), given.alias("given")), lambda x: F.when(x["cut"].isNull(), x["given"]).when(x["given"].isNull() | (x["cut"] == x["given"]), x["cut"]))


def phrase_texts(text: Column, phrases: Column) -> Column:
    """Phrases given as strings, or as objects with a text or with offsets into the text; blank ones left out."""

    def one(p: Column) -> Column:
        start, end = _get(p, "int", "start_char", "start", "begin"), _get(p, "int", "end_char", "end", "stop")
        return strip(F.when(_is_object(p), span_text(text, _get(p, "string", "text"), start, end)).otherwise(F.try_variant_get(p, "$", "string")))

    return F.filter(F.transform(phrases, one), lambda p: p.isNotNull() & (p != ""))


def analysis_of(text: Column, payload: Column) -> Column:
    """The typed analysis of a JSON payload (variant), unknown fields left out; aliases and older shapes are read too.

    What a required field lacks stays null. Only themes and emotions given as two lists inherit the overall sentiment.
    """
    found = let(F.coalesce(F.try_variant_get(payload, "$.text_analysis", "variant"), payload), lambda body: let(_head(body), lambda head: _analysis(text, body, head)))
    return F.when(F.coalesce(_is_object(payload), F.lit(False)), found)


def overall_label(payload: Column) -> Column:
    """The overall sentiment alone of a JSON payload given as text; null if it has none or doesn't parse."""

    def of(v: Column) -> Column:
        overall = F.try_variant_get(F.coalesce(F.try_variant_get(v, "$.text_analysis", "variant"), v), "$.overall_sentiment", "variant")
        nested = F.coalesce(_is_object(overall), F.lit(False))
        return F.when(F.coalesce(_is_object(v), F.lit(False)), F.when(nested, _get(overall, "string", "sentiment", "label")).otherwise(F.try_variant_get(overall, "$", "string")))

    return sentiment(let(F.when(~is_missing(payload), parse_json(payload)), of))


def _head(body: Column) -> Column:
    """(label, score, zipped, emotions): what is overall, and the emotions that go with themes by place if there are such."""
    overall = F.try_variant_get(body, "$.overall_sentiment", "variant")

    def of(o: Column) -> Column:
        nested = F.coalesce(_is_object(o), F.lit(False))
        label = sentiment(F.when(nested, _get(o, "string", "sentiment", "label")).otherwise(F.try_variant_get(o, "$", "string")))
        scored = nested & F.try_variant_get(o, "$.score", "variant").isNotNull()
        score = F.when(scored, _get(o, "double", "score")).otherwise(_get(body, "double", "sentiment_score", "overall_sentiment_score"))
        emotions = F.when(F.try_variant_get(body, "$.main_themes", "variant").isNull(), _items(body, "emotions"))
        return F.struct(label.alias("label"), score.alias("score"), emotions.alias("emotions"))

    return let(overall, of)


def _theme(text: Column, t: Column, i: Column, head: Column) -> Column:
    zipped = F.coalesce(F.size(head["emotions"]) > 0, F.lit(False))
    emotion = F.when(zipped, F.get(head["emotions"], i)).otherwise(F.try_variant_get(t, "$.emotion", "variant"))

    def of(e: Column) -> Column:
        within = F.coalesce(_is_object(e), F.lit(False))
        given = F.when(within, _get(e, "string", "emotion_sentiment", "sentiment")).otherwise(_get(t, "string", "emotion_sentiment"))
        intensity = F.when(within, _number(e, 1.0, "emotion_intensity_score", "intensity")).otherwise(_number(t, 1.0, "emotion_intensity_score"))
        inherited = lambda c: let(c, lambda x: F.when(zipped & x.isNull(), head["label"]).otherwise(sentiment(x)))
        return F.struct(
            strip(_get(t, "string", "theme")).alias("theme"), inherited(_get(t, "string", "theme_sentiment", "sentiment")).alias("theme_sentiment"),
            _number(t, 0.0, "theme_sentiment_score", "score").alias("theme_sentiment_score"), _number(t, 1.0, "theme_relevance_score", "relevance").alias("theme_relevance_score"),
            strip(F.when(within, _get(e, "string", "emotion")).otherwise(F.try_variant_get(e, "$", "string"))).alias("emotion"),
            inherited(given).alias("emotion_sentiment"), intensity.alias("emotion_intensity_score"), phrase_texts(text, _items(t, "theme_associated_phrases", "associated_phrases")).alias("theme_associated_phrases"),
        )

    return let(emotion, of)


def _analysis(text: Column, body: Column, head: Column) -> Column:
    place = lambda v: (_get(v, "int", "start_char", "start"), _get(v, "int", "end_char", "end"))

    def sentence(s: Column) -> Column:
        return F.struct(strip(span_text(text, _get(s, "string", "sentence", "text"), *place(s))).alias("sentence"), sentiment(_get(s, "string", "sentence_sentiment", "sentiment")).alias("sentence_sentiment"), _number(s, 0.0, "sentence_sentiment_score", "score").alias("sentence_sentiment_score"))

    def entity(m: Column) -> Column:
        return F.struct(
            strip(_get(m, "string", "metadata_type", "entity_type", "type")).alias("metadata_type"), strip(span_text(text, _get(m, "string", "metadata_name", "text"), *place(m))).alias("metadata_name"),
            sentiment(_get(m, "string", "metadata_sentiment", "sentiment")).alias("metadata_sentiment"), _number(m, 0.0, "metadata_sentiment_score", "score").alias("metadata_sentiment_score"),
        )

    return F.struct(
        head["label"].alias("overall_sentiment"), head["score"].alias("sentiment_score"), F.transform(_items(body, "main_themes", "themes"), lambda t, i: _theme(text, t, i, head)).alias("main_themes"),
        F.transform(_items(body, "sentence_sentiments"), sentence).alias("sentence_sentiments"), F.transform(_items(body, "metadata", "metadata_entities"), entity).alias("metadata"),
    )


def _in_range(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1), F.lit(False))


def is_valid(analysis: Column) -> Column:
    """Whether all required fields are there, themes have phrases, and all scores lie between 0 and 1."""
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    themes = F.forall(analysis["main_themes"], lambda t: text(t["theme"]) & text(t["emotion"]) & (F.size(t["theme_associated_phrases"]) > 0) & t["theme_sentiment"].isNotNull() & t["emotion_sentiment"].isNotNull() & _in_range(t["theme_sentiment_score"]) & _in_range(t["theme_relevance_score"]) & _in_range(t["emotion_intensity_score"]))
    sentences = F.forall(analysis["sentence_sentiments"], lambda s: text(s["sentence"]) & s["sentence_sentiment"].isNotNull() & _in_range(s["sentence_sentiment_score"]))
    entities = F.forall(analysis["metadata"], lambda m: text(m["metadata_type"]) & text(m["metadata_name"]) & m["metadata_sentiment"].isNotNull() & _in_range(m["metadata_sentiment_score"]))
    return F.coalesce(analysis["overall_sentiment"].isNotNull() & _in_range(analysis["sentiment_score"]) & themes & sentences & entities, F.lit(False))


def with_analysis(rows: DataFrame, text: str, payload: str) -> DataFrame:
    """Adds `analysis` and `is_valid`. A payload that is null, malformed or no object gives null and false."""
    variant = F.when(~is_missing(F.col(payload)), parse_json(F.col(payload)))
    found = rows.withColumn("analysis", let(variant, lambda v: analysis_of(F.col(text), v)))
    return found.withColumn("is_valid", F.coalesce(let(F.col("analysis"), is_valid), F.lit(False)))


def legacy_payload(overall: Column, score: Column, sentences: Column, metadata: Column, themes: Column) -> Column:
    """The older separate columns as one JSON payload; null if all are missing. JSON columns that don't parse count as absent."""
    parts = F.to_json(F.struct(overall.alias("overall_sentiment"), score.alias("sentiment_score")))
    extra = lambda name, c: F.concat(F.lit(f',"{name}":'), F.coalesce(F.to_json(parse_json(c)), F.lit("[]")))
    whole = F.concat(F.regexp_replace(parts, r"\}$", ""), extra("sentence_sentiments", sentences), extra("metadata", metadata), extra("main_themes", themes), F.lit("}"))
    return F.when(~(is_missing(overall) & is_missing(sentences) & is_missing(metadata) & is_missing(themes)), whole)


def tag_labels(c: Column) -> Column:
    """(start, end, type) from a JSON array, offsets and type under either name; bad ones left out; sorted."""
    item = lambda v: F.struct(_get(v, "int", "start", "start_char").alias("start"), _get(v, "int", "end", "end_char").alias("end"), strip(_get(v, "string", "type", "entity_type")).alias("type"))
    good = lambda t: F.coalesce((t["start"] >= 0) & (t["end"] > t["start"]) & (t["type"] != ""), F.lit(False))
    return F.array_sort(F.filter(F.transform(F.coalesce(F.try_variant_get(parse_json(c), "$", _ITEMS), F.array().cast(_ITEMS)), item), good))


def predicted_tags(c: Column) -> Column:
    """The labels of a prediction, or null if any of them is bad."""
    item = lambda v: F.struct(_get(v, "int", "start").alias("start"), _get(v, "int", "end").alias("end"), strip(_get(v, "string", "type")).alias("type"))
    good = lambda t: F.coalesce((t["start"] >= 0) & (t["end"] > t["start"]) & (t["type"] != ""), F.lit(False))
    found = F.transform(F.try_variant_get(parse_json(c), "$.labels", _ITEMS), item)
    return F.when(F.forall(found, good), F.array_sort(found))
