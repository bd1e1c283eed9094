"""Prediction records: raw model outputs cleaned against their source text and assembled to one structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import aligned_phrase, argmax, clamp, key_text, phrase_for_label, sentiment_or_neutral, simple_sentences, source_cased, strip
from .normalize import ANALYSIS

LONGEST = 80


def training_envelope(sentences: Column, label: Column, score: Column, metadata: Column, themes: Column) -> Column:
    """A prediction as training writes it: the gold sentences all with the overall label and score, entities and themes as they are."""
    one = lambda s: F.struct(s["sentence"].alias("sentence"), label.alias("sentence_sentiment"), clamp(score).alias("sentence_sentiment_score"))
    return F.struct(F.struct(label.alias("overall_sentiment"), clamp(score).alias("sentiment_score"), F.transform(sentences, one).alias("sentence_sentiments"), metadata.alias("metadata"), themes.alias("main_themes")).alias("text_analysis"))


def chosen(probabilities: Column, threshold: float = 0.5) -> Column:
    """The places of the probabilities that reach the threshold; the largest one's if none does; none of an empty array."""
    reached = F.filter(F.transform(probabilities, lambda p, i: F.when(p >= threshold, i)), lambda i: i.isNotNull())
    return F.when(F.size(reached) > 0, reached).when(F.size(probabilities) > 0, F.array(argmax(probabilities))).otherwise(F.array().cast("array<int>"))


def themes_from_probabilities(text: Column, label: Column, score: Column, themes: Column, theme_p: Column, emotions: Column, emotion_p: Column, threshold: float = 0.5) -> Column:
    """The chosen themes, all with the first chosen emotion and the overall label and score."""
    first = F.get(chosen(emotion_p, threshold), F.lit(0))
    emotion = F.coalesce(F.get(emotions, first), F.lit("neutral"))
    intensity = clamp(F.coalesce(F.get(emotion_p, first), score))

    def theme(i: Column) -> Column:
        name = F.get(themes, i)
        return F.struct(
            name.alias("theme"), label.alias("theme_sentiment"), clamp(score).alias("theme_sentiment_score"), clamp(F.get(theme_p, i)).alias("theme_relevance_score"), emotion.alias("emotion"),
            label.alias("emotion_sentiment"), intensity.alias("emotion_intensity_score"), F.array(phrase_for_label(text, name)).alias("theme_associated_phrases"),
        )

    return F.transform(chosen(theme_p, threshold), theme)


def phrase_map(themes: Column) -> Column:
    """(theme, phrases) entries of gold themes by lower-case name, phrases of equal names joined in order."""
    names = F.array_distinct(F.transform(themes, lambda t: key_text(t["theme"])))
    return F.transform(names, lambda n: F.struct(n.alias("theme"), F.flatten(F.transform(F.filter(themes, lambda t: key_text(t["theme"]) == n), lambda t: t["theme_associated_phrases"])).alias("phrases")))


def clean_themes(text: Column, themes: Column, gold: Column | None = None) -> Column:
    """Themes with a name; phrases are the gold ones of that theme if `gold` is given, else the predicted ones as they stand in the text, else the text's beginning."""
    known = phrase_map(gold) if gold is not None else None

    def one(t: Column) -> Column:
        own = F.filter(F.transform(F.coalesce(t["theme_associated_phrases"], F.array().cast("array<string>")), lambda p: aligned_phrase(text, p)), lambda p: p.isNotNull() & (p != ""))
        beginning = F.filter(F.array(F.substring(strip(text), 1, LONGEST)), lambda p: p != "")
        phrases = F.when(F.size(own) > 0, own).otherwise(beginning)
        if known is not None:
            hit = F.get(F.filter(known, lambda k: k["theme"] == key_text(t["theme"])), F.lit(0))["phrases"]
            phrases = F.when(F.coalesce(F.size(hit), F.lit(0)) > 0, hit).otherwise(phrases)
        return F.struct(
            strip(t["theme"]).alias("theme"), key_text(F.coalesce(t["theme_sentiment"], F.lit("neutral"))).alias("theme_sentiment"), F.coalesce(t["theme_sentiment_score"], F.lit(0.5)).alias("theme_sentiment_score"),
            F.coalesce(t["theme_relevance_score"], F.lit(0.5)).alias("theme_relevance_score"), strip(F.coalesce(t["emotion"], F.lit("neutral"))).alias("emotion"),
            key_text(F.coalesce(t["emotion_sentiment"], F.lit("neutral"))).alias("emotion_sentiment"), F.coalesce(t["emotion_intensity_score"], F.lit(0.5)).alias("emotion_intensity_score"), phrases.alias("theme_associated_phrases"),
        )

    return F.transform(F.filter(themes, lambda t: F.coalesce(strip(t["theme"]) != "", F.lit(False))), one)


def clean_metadata(text: Column, entities: Column) -> Column:
    """Entities with a name, spelled as in the text."""

    def one(m: Column) -> Column:
        return F.struct(
            strip(F.coalesce(m["metadata_type"], F.lit("Entity"))).alias("metadata_type"), F.coalesce(source_cased(text, m["metadata_name"]), strip(m["metadata_name"])).alias("metadata_name"),
            key_text(F.coalesce(m["metadata_sentiment"], F.lit("neutral"))).alias("metadata_sentiment"), F.coalesce(m["metadata_sentiment_score"], F.lit(0.5)).alias("metadata_sentiment_score"),
        )

    return F.transform(F.filter(entities, lambda m: F.coalesce(strip(m["metadata_name"]) != "", F.lit(False))), one)


def sentence_entries(text: Column, label: Column, score: Column, gold: Column | None = None) -> Column:
    """Gold sentences if given and any, else the text's; each with the overall label and score."""
    own = simple_sentences(text)
    names = own if gold is None else F.when(F.size(gold) > 0, F.transform(gold, lambda s: s["sentence"])).otherwise(own)
    return F.transform(names, lambda s: F.struct(s.alias("sentence"), label.alias("sentence_sentiment"), clamp(score).alias("sentence_sentiment_score")))


def assembled(rows: DataFrame, use_gold: bool = False) -> DataFrame:
    """Adds `prediction` to rows (text, label, score, themes, metadata, and gold if use_gold).

    use_gold copies sentences and phrases from the gold analysis, which leaks it into predictions; it is off by default.
    """
    text, label, score = F.col("text"), sentiment_or_neutral(F.col("label")), clamp(F.coalesce("score", F.lit(0.5)))
    gold = F.col("gold") if use_gold else None
    built = F.struct(
        label.alias("overall_sentiment"), score.alias("sentiment_score"), clean_themes(text, F.col("themes"), None if gold is None else gold["main_themes"]).alias("main_themes"),
        sentence_entries(text, label, score, None if gold is None else gold["sentence_sentiments"]).alias("sentence_sentiments"), clean_metadata(text, F.col("metadata")).alias("metadata"),
    )
    return rows.withColumn("prediction", built.cast(ANALYSIS))
