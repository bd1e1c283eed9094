"""Queries of the evaluation operators over a data directory, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import align, bow, lexicon, metrics, normalize, predictions, spans, targets, tracker
from ..sources import readers
from ..sources.tables import cut_lineage, table
from . import profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LABELS = fn.SENTIMENTS


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _r(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# Pieces of SQL that several queries share.
_SPACE = r"^\s+|\s+$"
_BUCKET = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967295::DOUBLE)"
_HASHED = f"CASE WHEN {_BUCKET} < 0.1 THEN 'test' WHEN {_BUCKET} < 0.1::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END"
_NAMED = "CASE WHEN s IN ('train','training') THEN 'train' WHEN s IN ('val','valid','validation','dev') THEN 'val' WHEN s IN ('test','holdout') THEN 'test' END"
_SPLIT = f"""SELECT row_id, id, CASE WHEN s = '' THEN {_HASHED.format('id')} ELSE {_NAMED} END AS split FROM (
    SELECT row_id, coalesce(nullif(CASE WHEN trim(example_id) = '' THEN '' ELSE example_id END, ''), printf('example-%06d', row_id)) AS id, lower(trim(coalesce(split, ''))) AS s FROM survey)"""


# What Unicode counts as white space, at either end; and words with the white space before them.
_ENDS = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
_PIECES = r"regexp_extract_all({0}, '[\s\p{Z}]*[^\s\p{Z}]+')"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, {_ENDS})"


def _words_sql(rows: str, key: str, text: str) -> str:
    """(key, place, token, start, end) of the words of each text."""
    return f"""SELECT {key}, place::INT AS place, token, (last - length(token))::INT AS "start", last::INT AS "end" FROM (
        SELECT {key}, i - 1 AS place, {_stripped("p[i]")} AS token, list_sum(list_transform(p[1:i], lambda x: length(x))) AS last FROM (
          SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {key}, {_PIECES.replace("{0}", text)} AS p FROM ({rows}))))"""


def survey_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "survey")
    example = fn.example_id_or_ordinal(F.col("example_id"), F.col("row_id"))
    return s.select("row_id", example.alias("id"), "split").withColumn("split", fn.split_or_hash(F.col("split"), F.col("id")))


@query(_SPLIT)
def split_assignment(spark, sf_dir):
    return survey_splits(spark, sf_dir)


@query(f"SELECT split, count(*) AS examples, count(DISTINCT id) AS ids FROM ({_SPLIT}) GROUP BY split")
def split_summary(spark, sf_dir):
    return survey_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("id").alias("ids"))


@query("SELECT row_id, raw_text, language AS lang FROM survey WHERE raw_text IS NOT NULL AND regexp_replace(raw_text, '[\\s\\p{Z}]', '', 'g') <> ''")
def missing_filter(spark, sf_dir):
    s = table(spark, sf_dir, "survey")
    return s.where(~fn.is_missing(F.col("raw_text"))).select("row_id", "raw_text", F.col("language").alias("lang"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT annotation_id, CASE WHEN lower(trim(theme_sentiment)) IN ('positive','negative','neutral') THEN lower(trim(theme_sentiment)) END AS label, CASE WHEN lower(trim(theme_sentiment)) IN ('positive','negative','neutral') THEN lower(trim(theme_sentiment)) ELSE 'neutral' END AS label_or_neutral FROM theme_annotation")
def label_normalize(spark, sf_dir):
    t = table(spark, sf_dir, "theme_annotation")
    return t.select("annotation_id", fn.sentiment(F.col("theme_sentiment")).alias("label"), fn.sentiment_or_neutral(F.col("theme_sentiment")).alias("label_or_neutral"))


@query("SELECT doc_id, 'tag-train-' || substr(md5(concat_ws(':', 'train', doc_id::VARCHAR, text)), 1, 12) AS stable_id FROM documents WHERE text IS NOT NULL")
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", fn.stable_id("tag", F.lit("train"), F.col("doc_id").cast("string"), F.col("text")).alias("stable_id"))


@query("""SELECT doc_id, len(s)::INT AS sentences, coalesce(list_aggregate(list_transform(s, lambda x: length(x)), 'max'), 0)::INT AS longest FROM (
    SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)""")
def sentence_split_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.simple_sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


@query(_words_sql("SELECT * FROM sentence_sentiment WHERE sentence IS NOT NULL", "sentence_id", "sentence"))
def token_offsets(spark, sf_dir):
    s = table(spark, sf_dir, "sentence_sentiment").where("sentence is not null")
    return s.select("sentence_id", F.posexplode(fn.spaced_tokens(F.col("sentence"))).alias("place", "t")).select("sentence_id", "place", "t.*")


_PHRASES = "SELECT annotation_id, row_id, unnest(theme_associated_phrases) AS phrase FROM theme_annotation"


def _phrases(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "theme_annotation").select("annotation_id", "row_id", F.explode("theme_associated_phrases").alias("phrase"))
    return t.join(table(spark, sf_dir, "survey").select("row_id", "raw_text"), "row_id").where("phrase is not null and raw_text is not null")


@query(f"SELECT p.annotation_id, p.phrase, (instr(s.raw_text, p.phrase) - 1)::INT AS start, instr(s.raw_text, p.phrase) > 0 AS found, CASE WHEN instr(lower(s.raw_text), lower(p.phrase)) > 0 THEN substr(s.raw_text, instr(lower(s.raw_text), lower(p.phrase)), length(p.phrase)) END AS cased FROM ({_PHRASES}) p JOIN survey s USING (row_id) WHERE p.phrase IS NOT NULL AND s.raw_text IS NOT NULL")
def phrase_find(spark, sf_dir):
    p = _phrases(spark, sf_dir)
    return p.select("annotation_id", "phrase", fn.find_start(F.col("raw_text"), F.col("phrase")).cast("int").alias("start"), F.contains("raw_text", F.col("phrase")).alias("found"), fn.source_cased(F.col("raw_text"), F.col("phrase")).alias("cased"))


def _starts_sql(low: str, needle: str) -> str:
    """The places of all occurrences, from the lengths of what lies between them."""
    parts = f"string_split({low}, {needle})"
    return f"list_transform(range(1, len({parts})), lambda i: list_sum(list_transform({parts}[1:i], lambda x: length(x))) + (i - 1) * length({needle}))"


@query(f"SELECT annotation_id, phrase, len(s)::INT AS hits, array_to_string(s, ',') AS places FROM (SELECT p.annotation_id, p.phrase, {_starts_sql('lower(s.raw_text)', 'lower(p.phrase)')} AS s FROM ({_PHRASES}) p JOIN survey s USING (row_id) WHERE p.phrase <> '' AND s.raw_text IS NOT NULL)")
def phrase_find_all(spark, sf_dir):
    p = _phrases(spark, sf_dir).where("phrase <> ''").select("annotation_id", "phrase", fn.all_spans(F.col("raw_text"), F.col("phrase")).alias("s"))
    return p.select("annotation_id", "phrase", F.size("s").alias("hits"), F.concat_ws(",", F.transform("s", lambda x: x["start"].cast("string"))).alias("places"))


@query("SELECT prediction_id, CASE WHEN raw_output IS NULL OR trim(raw_output) = '' THEN '' WHEN regexp_matches(raw_output, '(?s)\\{.*\\}') THEN regexp_extract(raw_output, '(?s)\\{.*\\}', 0) ELSE trim(raw_output) END AS json_text FROM prediction")
def extract_json(spark, sf_dir):
    return table(spark, sf_dir, "prediction").select("prediction_id", fn.extract_json(F.col("raw_output")).alias("json_text"))


def _payload() -> Column:
    """The payload of a survey record; the separate older columns count where there is none."""
    older = normalize.legacy_payload(*map(F.col, ("overall_sentiment", "overall_sentiment_score", "sentence_sentiments", "metadata", "main_themes")))
    return F.coalesce(F.when(~fn.is_missing(F.col("response_text")), F.col("response_text")), older)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, key, raw_text, analysis, is_valid) of survey records."""
    rows = align.keyed(table(spark, sf_dir, "survey"), "example_id").select("row_id", "key", fn.strip(F.col("raw_text")).alias("raw_text"), _payload().alias("payload"), "ingested_at")
    return normalize.with_analysis(rows, "raw_text", "payload").drop("payload")


_BODY = """SELECT row_id, CASE WHEN json_type(j, '$.text_analysis') = 'OBJECT' THEN j->'$.text_analysis' ELSE j END AS b FROM (
    SELECT row_id, CASE WHEN json_valid(response_text) THEN response_text::JSON END AS j FROM survey WHERE trim(response_text) <> '') WHERE json_type(j) = 'OBJECT'"""


@query(f"""SELECT row_id, CASE WHEN l IN ('positive','negative','neutral') THEN l END AS overall_sentiment, round(score, 6) AS sentiment_score, themes FROM (
    SELECT row_id, lower(trim(coalesce(b->>'$.overall_sentiment.sentiment', b->>'$.overall_sentiment.label', b->>'$.overall_sentiment'))) AS l,
    coalesce((b->>'$.overall_sentiment.score')::DOUBLE, (b->>'$.sentiment_score')::DOUBLE, (b->>'$.overall_sentiment_score')::DOUBLE) AS score,
    coalesce(json_array_length(b, '$.main_themes'), json_array_length(b, '$.themes'), 0)::INT AS themes FROM ({_BODY}))""")
def payload_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "survey").where(~fn.is_missing(F.col("response_text"))).select("row_id", "raw_text", "response_text")
    a = F.col("analysis")
    return normalize.with_analysis(rows, "raw_text", "response_text").where("analysis is not null").select("row_id", a["overall_sentiment"].alias("overall_sentiment"), _r(a["sentiment_score"], "sentiment_score"), F.size(a["main_themes"]).alias("themes"))


@query()
def payload_validity(spark, sf_dir):
    return analyses(spark, sf_dir).groupBy(F.col("analysis").isNotNull().alias("readable"), "is_valid").agg(F.count("*").alias("records"))


@query()
def analysis_summary(spark, sf_dir):
    rows = analyses(spark, sf_dir).join(survey_splits(spark, sf_dir).select("row_id", "split"), "row_id").where("is_valid")
    return targets.dataset_summary(rows)


def _predictions(spark, sf_dir) -> DataFrame:
    return align.keyed(table(spark, sf_dir, "prediction"), "example_id")


_KEYED = "SELECT *, nullif(trim(example_id), '') AS key FROM prediction"
_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, key ORDER BY written_at DESC, prediction_id DESC) AS rn FROM ({_KEYED}) WHERE key IS NOT NULL AND experiment_id IS NOT NULL) WHERE rn = 1"


def _last_predictions(spark, sf_dir) -> DataFrame:
    return align.last_by_key(_predictions(spark, sf_dir), ["experiment_id", "key"], [F.col("written_at"), F.col("prediction_id")])


@query(f"SELECT experiment_id, key, prediction_id, is_valid_json FROM ({_LAST})")
def align_last_wins(spark, sf_dir):
    return _last_predictions(spark, sf_dir).select("experiment_id", "key", "prediction_id", "is_valid_json")


_REFS = "SELECT DISTINCT nullif(trim(example_id), '') AS key FROM survey WHERE nullif(trim(example_id), '') IS NOT NULL"


@query(f"""SELECT experiment_id, sum(n)::BIGINT AS prediction_rows, coalesce(sum(CASE WHEN key IS NULL THEN n END), 0)::BIGINT AS unkeyed, coalesce(sum(CASE WHEN key IS NOT NULL THEN n - 1 END), 0)::BIGINT AS duplicates,
    coalesce(sum(CASE WHEN known THEN 1 END), 0)::BIGINT AS matched, coalesce(sum(CASE WHEN key IS NOT NULL AND NOT coalesce(known, false) THEN 1 END), 0)::BIGINT AS extra FROM (
    SELECT experiment_id, p.key, count(*) AS n, any_value(r.known) AS known FROM ({_KEYED}) p LEFT JOIN (SELECT key, true AS known FROM ({_REFS})) r ON p.key = r.key GROUP BY experiment_id, p.key) GROUP BY experiment_id""")
def alignment_stats(spark, sf_dir):
    return align.alignment_counts(_predictions(spark, sf_dir), align.keyed(table(spark, sf_dir, "survey"), "example_id"), ["experiment_id"])


@query(f"SELECT count(*)::BIGINT AS missing FROM ({_REFS}) WHERE key NOT IN (SELECT key FROM ({_KEYED}) WHERE key IS NOT NULL)")
def missing_predictions(spark, sf_dir):
    refs = align.keyed(table(spark, sf_dir, "survey"), "example_id").select("key").where("key is not null").distinct()
    return refs.join(_predictions(spark, sf_dir).select("key"), "key", "left_anti").agg(F.count("*").alias("missing"))


@query(f"SELECT key FROM ({_REFS}) WHERE key IN (SELECT key FROM ({_KEYED}))")
def matched_keys(spark, sf_dir):
    refs = align.keyed(table(spark, sf_dir, "survey"), "example_id").select("key").where("key is not null").distinct()
    return refs.join(_predictions(spark, sf_dir).select("key"), "key", "left_semi")


def scored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment_id, key, gold, predicted, valid) of every last prediction whose reference has a sentiment; unreadable ones are 'invalid'."""
    own = F.when(~fn.is_missing(F.col("response_text")), normalize.overall_label(F.col("response_text"))).otherwise(fn.sentiment(F.col("overall_sentiment")))
    labels = align.keyed(table(spark, sf_dir, "survey"), "example_id").select("key", own.alias("gold"), "ingested_at", "row_id").where("key is not null")
    # The last label that there is; labels are read once, so none is sought before they are grouped.
    refs = labels.groupBy("key").agg(F.max_by("gold", F.struct(F.col("gold").isNotNull(), "ingested_at", "row_id")).alias("gold")).where("gold is not null")
    last = _last_predictions(spark, sf_dir).select("experiment_id", "key", normalize.overall_label(F.col("prediction")).alias("label"), "is_valid_json")
    ok = F.coalesce(F.col("is_valid_json"), F.lit(True)) & F.col("label").isNotNull()
    return last.join(refs, "key").select("experiment_id", "key", "gold", F.when(ok, F.col("label")).otherwise(align.INVALID).alias("predicted"), ok.alias("valid"))


_GOLD = f"""SELECT key, gold FROM (SELECT key, gold, row_number() OVER (PARTITION BY key ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM (
    SELECT s.row_id, nullif(trim(s.example_id), '') AS key, s.ingested_at, CASE WHEN l IN ('positive','negative','neutral') THEN l END AS gold FROM survey s JOIN (
      SELECT row_id, lower(trim(coalesce(b->>'$.overall_sentiment.sentiment', b->>'$.overall_sentiment.label', b->>'$.overall_sentiment'))) AS l FROM ({_BODY})
      UNION ALL SELECT row_id, lower(trim(overall_sentiment)) FROM survey WHERE response_text IS NULL OR trim(response_text) = '') x ON x.row_id = s.row_id) WHERE key IS NOT NULL AND gold IS NOT NULL) WHERE rn = 1"""
_PAIRS = f"""SELECT experiment_id, key, gold, CASE WHEN coalesce(is_valid_json, true) AND l IN ('positive','negative','neutral') THEN l ELSE 'invalid' END AS predicted FROM (
    SELECT experiment_id, key, is_valid_json, lower(trim(coalesce(b->>'$.overall_sentiment.sentiment', b->>'$.overall_sentiment.label', b->>'$.overall_sentiment'))) AS l FROM (
      SELECT experiment_id, key, is_valid_json, CASE WHEN json_type(j, '$.text_analysis') = 'OBJECT' THEN j->'$.text_analysis' WHEN json_type(j) = 'OBJECT' THEN j END AS b FROM (
        SELECT experiment_id, key, is_valid_json, CASE WHEN json_valid(prediction) THEN prediction::JSON END AS j FROM ({_LAST})))) JOIN ({_GOLD}) USING (key)"""


@query(f"SELECT experiment_id, key, gold, predicted, predicted <> 'invalid' AS valid FROM ({_PAIRS})")
def aligned_sentiments(spark, sf_dir):
    return scored_predictions(spark, sf_dir)


def _macro_sql(pairs: str, by: str) -> str:
    return f"""SELECT {by}, round(avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END), 6) AS macro_f1 FROM (
        SELECT {by}, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
          SELECT {by}, gold AS label, (gold = predicted)::INT AS tp, 0 AS fp, (gold <> predicted)::INT AS fn FROM ({pairs})
          UNION ALL SELECT {by}, predicted, 0, (gold <> predicted)::INT, 0 FROM ({pairs})) GROUP BY {by}, label) GROUP BY {by}"""


@query(_macro_sql(_PAIRS, "experiment_id"))
def macro_f1(spark, sf_dir):
    return _label_scores(spark, sf_dir).select("experiment_id", _r(F.col("macro_f1"), "macro_f1"))


def _label_scores(spark, sf_dir) -> DataFrame:
    return metrics.label_scores(scored_predictions(spark, sf_dir), "gold", "predicted", "valid", ["experiment_id"])


@query(f"SELECT experiment_id, round(avg((gold = predicted)::INT::DOUBLE), 6) AS accuracy, round(avg((predicted <> 'invalid')::INT::DOUBLE), 6) AS json_schema_compliance FROM ({_PAIRS}) GROUP BY experiment_id")
def accuracy(spark, sf_dir):
    return _label_scores(spark, sf_dir).select("experiment_id", _r(F.col("accuracy"), "accuracy"), _r(F.col("json_schema_compliance"), "json_schema_compliance"))


@query(f"""SELECT round(avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END), 6) AS macro_f1 FROM (SELECT l.label, (SELECT count(*) FROM ({_PAIRS}) WHERE gold = l.label AND predicted = l.label) AS tp,
    (SELECT count(*) FROM ({_PAIRS}) WHERE gold <> l.label AND predicted = l.label) AS fp, (SELECT count(*) FROM ({_PAIRS}) WHERE gold = l.label AND predicted <> l.label) AS fn FROM (VALUES ('positive'), ('negative'), ('neutral')) l(label))""")
def macro_f1_fixed(spark, sf_dir):
    return metrics.macro_f1_fixed(scored_predictions(spark, sf_dir), "gold", "predicted", LABELS).select(_r(F.col("macro_f1"), "macro_f1"))


@query(f"""SELECT experiment_id, round(coalesce(m.macro_f1, 0) * 0.75 + coalesce(a.compliance, 0) * 0.25, 6) AS val_metric FROM ({_macro_sql(_PAIRS, "experiment_id").replace("round(avg(", "(avg(").replace(", 6) AS macro_f1", ") AS macro_f1")}) m
    JOIN (SELECT experiment_id, avg((predicted <> 'invalid')::INT::DOUBLE) AS compliance FROM ({_PAIRS}) GROUP BY experiment_id) a USING (experiment_id)""")
def composite_score(spark, sf_dir):
    return _label_scores(spark, sf_dir).select("experiment_id", _r(metrics.composite({c: F.col(c) for c in ("macro_f1", "json_schema_compliance")}, {"macro_f1": 3.0, "json_schema_compliance": 1.0}), "val_metric"))


def _analysis_pairs(spark, sf_dir) -> DataFrame:
    """(experiment_id, id, text, gold, predicted): valid gold analyses against the last predictions; predicted is null if invalid."""
    refs = align.last_by_key(analyses(spark, sf_dir).where("is_valid").select("key", "raw_text", "analysis", "ingested_at", "row_id"), ["key"], [F.col("ingested_at"), F.col("row_id")])
    last = _last_predictions(spark, sf_dir).select("experiment_id", "key", "prediction", "is_valid_json", F.lit("").alias("none"))
    read = normalize.with_analysis(last, "none", "prediction")
    ok = F.coalesce(F.col("is_valid_json"), F.lit(True)) & F.col("is_valid")
    read = read.select("experiment_id", "key", F.when(ok, F.col("analysis")).alias("predicted"))
    return read.join(refs, "key").select("experiment_id", F.col("key").alias("id"), F.col("raw_text").alias("text"), F.col("analysis").alias("gold"), "predicted")


@query()
def score_analyses(spark, sf_dir):
    found = metrics.score_analyses(cut_lineage(_analysis_pairs(spark, sf_dir)), ["experiment_id"])
    return found.select("experiment_id", *[_r(F.col(c), c) for c in found.columns if c != "experiment_id"])


@query(f"""SELECT split, count(*) AS examples, count(p.key) AS matched, count(*) - count(p.key) AS missing, sum(CASE WHEN p.key IS NULL OR p.is_valid_json = false THEN 1 ELSE 0 END)::BIGINT AS invalid FROM (
    SELECT nullif(trim(s.example_id), '') AS key, x.split FROM survey s JOIN ({_SPLIT}) x USING (row_id) WHERE nullif(trim(s.example_id), '') IS NOT NULL AND x.split IS NOT NULL GROUP BY 1, 2) r LEFT JOIN (
    SELECT key, is_valid_json FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY written_at DESC, prediction_id DESC) AS rn FROM ({_KEYED}) WHERE key IS NOT NULL) WHERE rn = 1) p USING (key) GROUP BY split""")
def alignment_by_split(spark, sf_dir):
    refs = align.keyed(table(spark, sf_dir, "survey"), "example_id").select("row_id", "key").where("key is not null").join(survey_splits(spark, sf_dir).select("row_id", "split"), "row_id")
    refs = refs.where("split is not null").select("split", "key").distinct()
    last = align.last_by_key(_predictions(spark, sf_dir), ["key"], [F.col("written_at"), F.col("prediction_id")]).select("key", "is_valid_json")
    return align.reference_counts(align.aligned(refs, last), ["split"])


# Records whose payload is an object, with their label and items: of the payload, or of the older columns where it is blank.
_ITEMS = f"""SELECT row_id, coalesce(b->>'$.overall_sentiment.sentiment', b->>'$.overall_sentiment.label', b->>'$.overall_sentiment') AS label, coalesce(b->'$.main_themes', b->'$.themes') AS themes, coalesce(b->'$.metadata', b->'$.metadata_entities') AS entities FROM ({_BODY})
    UNION ALL SELECT row_id, overall_sentiment, CASE WHEN json_valid(main_themes) THEN main_themes::JSON END, CASE WHEN json_valid(metadata) THEN metadata::JSON END FROM survey WHERE coalesce({_stripped("response_text")}, '') = ''
      AND coalesce({_stripped("overall_sentiment")}, '') || coalesce({_stripped("sentence_sentiments")}, '') || coalesce({_stripped("metadata")}, '') || coalesce({_stripped("main_themes")}, '') <> ''"""


def _named_sql(items: str, name: str) -> str:
    return f"coalesce(len(list_filter(json_extract_string({items}, '$[*].{name}'), lambda x: {_stripped('x')} <> '')), 0)::INT"


@query(f"""SELECT row_id, CASE WHEN lower(trim(label)) IN ('positive','negative','neutral') THEN lower(trim(label)) ELSE 'neutral' END AS overall_sentiment, {_named_sql("themes", "theme")} AS themes,
    len(list_filter(list_transform(regexp_extract_all({_stripped("raw_text")}, '[^.!?]+[.!?]?'), lambda x: {_stripped("x")}), lambda x: x <> ''))::INT AS sentences, {_named_sql("entities", "metadata_name")} AS entities
    FROM ({_ITEMS}) JOIN (SELECT row_id, raw_text FROM survey) USING (row_id) WHERE {_stripped("raw_text")} <> ''""")
def assembled_predictions(spark, sf_dir):
    a = F.col("analysis")
    read = analyses(spark, sf_dir).where("analysis is not null and raw_text <> ''")
    rows = read.select("row_id", F.col("raw_text").alias("text"), a["overall_sentiment"].alias("label"), a["sentiment_score"].alias("score"), a["main_themes"].alias("themes"), a["metadata"].alias("metadata"))
    made = predictions.assembled(rows)
    p = F.col("prediction")
    return made.select("row_id", p["overall_sentiment"].alias("overall_sentiment"), F.size(p["main_themes"]).alias("themes"), F.size(p["sentence_sentiments"]).alias("sentences"), F.size(p["metadata"]).alias("entities"))


def _theme_sets(spark, sf_dir) -> DataFrame:
    """(gold, predicted): themes of valid gold analyses against those of the last predictions; an invalid prediction has none."""
    themes = lambda c: F.coalesce(F.transform(F.col(c)["main_themes"], lambda t: fn.key_text(t["theme"])), F.array().cast("array<string>")).alias(c)
    return _analysis_pairs(spark, sf_dir).select(themes("gold"), themes("predicted"))


def _entity_sets(spark, sf_dir) -> DataFrame:
    """(gold, predicted): where the entities of both sides stand in the text."""
    kind = "array<struct<start:int,end:int,name:string,type:string>>"
    entities = lambda c: F.coalesce(metrics.entity_keys(F.col("text"), F.col(c)["metadata"], False), F.array().cast(kind)).alias(c)
    return _analysis_pairs(spark, sf_dir).select(entities("gold"), entities("predicted"))


@query()
def set_f1(spark, sf_dir):
    return metrics.sample_set_f1(_theme_sets(spark, sf_dir), "gold", "predicted").select(_r(F.col("set_f1"), "set_f1"))


@query()
def span_prf(spark, sf_dir):
    return metrics.micro_prf(_entity_sets(spark, sf_dir), "gold", "predicted").select(_r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"), _r(F.col("f1"), "f1"))


def _annotated_themes(spark, sf_dir) -> DataFrame:
    """(experiment_id, gold, predicted): the annotated themes of each record against those of the last predictions of it, both as they are compared."""
    themes = table(spark, sf_dir, "theme_annotation").groupBy("row_id").agg(F.collect_set(F.when(~fn.is_missing(F.col("theme")), fn.key_text(F.col("theme")))).alias("gold"))
    refs = align.last_by_key(align.keyed(table(spark, sf_dir, "survey"), "example_id").select("key", "row_id", "ingested_at"), ["key"], [F.col("ingested_at"), F.col("row_id")]).select("key", "row_id")
    none = F.array().cast("array<string>")
    names = F.transform(F.try_variant_get(fn.parse_json(F.col("prediction")), "$.text_analysis.main_themes", "array<variant>"), lambda t: fn.key_text(F.try_variant_get(t, "$.theme", "string")))
    said = F.array_distinct(F.filter(F.coalesce(names, none), lambda x: x != ""))
    last = _last_predictions(spark, sf_dir).select("experiment_id", "key", said.alias("predicted"))
    return last.join(refs, "key").join(themes, "row_id", "left").select("experiment_id", F.coalesce("gold", none).alias("gold"), "predicted")


_THEMES = f"""SELECT experiment_id, coalesce(t.gold, []) AS g, coalesce(l.said, []) AS p, len(list_intersect(coalesce(t.gold, []), coalesce(l.said, []))) AS hit FROM (
      SELECT experiment_id, key, list_distinct(list_filter(list_transform(CASE WHEN json_valid(prediction) THEN json_extract_string(prediction, '$.text_analysis.main_themes[*].theme') ELSE [] END, lambda x: lower({_stripped("x")})), lambda x: x <> '')) AS said FROM ({_LAST})) l
    JOIN (SELECT key, row_id FROM (SELECT nullif(trim(example_id), '') AS key, row_id, row_number() OVER (PARTITION BY nullif(trim(example_id), '') ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM survey) WHERE key IS NOT NULL AND rn = 1) r ON r.key = l.key
    LEFT JOIN (SELECT row_id, list(DISTINCT lower({_stripped("theme")})) AS gold FROM theme_annotation WHERE {_stripped("theme")} <> '' GROUP BY row_id) t ON t.row_id = r.row_id"""


@query(f"SELECT experiment_id, round(avg(CASE WHEN len(g) + len(p) = 0 THEN 1.0 ELSE 2.0::DOUBLE * hit / (len(g) + len(p)) END), 6) AS set_f1 FROM ({_THEMES}) GROUP BY experiment_id")
def theme_set_f1(spark, sf_dir):
    return metrics.sample_set_f1(_annotated_themes(spark, sf_dir), "gold", "predicted", ["experiment_id"]).select("experiment_id", _r(F.col("set_f1"), "set_f1"))


@query(f"SELECT experiment_id, round(coalesce(sum(hit) / nullif(sum(len(p)), 0)::DOUBLE, 0), 6) AS precision, round(coalesce(sum(hit) / nullif(sum(len(g)), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0::DOUBLE * sum(hit) / nullif(sum(len(p)) + sum(len(g)), 0), 0), 6) AS f1 FROM ({_THEMES}) GROUP BY experiment_id")
def theme_prf(spark, sf_dir):
    found = metrics.micro_prf(_annotated_themes(spark, sf_dir), "gold", "predicted", ["experiment_id"])
    return found.select("experiment_id", *[_r(F.col(c), c) for c in ("precision", "recall", "f1")])


def _sentence_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Annotated sentences with their labels, and the simple sentences of the texts that have such, all with the record's overall label."""
    s = table(spark, sf_dir, "sentence_sentiment").where("sentence is not null").select("row_id", fn.strip(F.col("sentence")).alias("sentence"), fn.sentiment(F.col("sentence_sentiment")).alias("label"), "item_no")
    gold = align.last_by_key(s, ["row_id", "sentence"], [F.col("item_no")]).select("row_id", "sentence", "label")
    labelled = fn.let(normalize.overall_label(F.col("response_text")), lambda label: F.transform(fn.simple_sentences(F.col("raw_text")), lambda x: F.struct(x.alias("sentence"), label.alias("label"))))
    texts = table(spark, sf_dir, "survey").select("row_id", F.inline(labelled))
    return gold, texts.join(s.select("row_id"), "row_id", "left_semi").distinct()


_ANNOTATED = f"SELECT row_id, {_stripped('sentence')} AS sentence, arg_max(CASE WHEN lower(trim(sentence_sentiment)) IN ('positive','negative','neutral') THEN lower(trim(sentence_sentiment)) ELSE '' END, item_no) AS label FROM sentence_sentiment WHERE sentence IS NOT NULL GROUP BY 1, 2"
_SIMPLE = f"""SELECT DISTINCT row_id, sentence, CASE WHEN l IN ('positive','negative','neutral') THEN l ELSE '' END AS label FROM (
    SELECT row_id, unnest(list_filter(list_transform(regexp_extract_all(raw_text, '[^.!?]+[.!?]?'), lambda x: {_stripped("x")}), lambda x: x <> '')) AS sentence FROM survey WHERE row_id IN (SELECT row_id FROM sentence_sentiment WHERE sentence IS NOT NULL)) t
    LEFT JOIN (SELECT row_id, lower(trim(coalesce(b->>'$.overall_sentiment.sentiment', b->>'$.overall_sentiment.label', b->>'$.overall_sentiment'))) AS l FROM ({_BODY})) x USING (row_id)"""


@query(f"SELECT gold, predicted, count(*) AS n FROM (SELECT coalesce(nullif(a.label, ''), 'missing') AS gold, coalesce(nullif(b.label, ''), 'missing') AS predicted FROM ({_ANNOTATED}) a FULL JOIN ({_SIMPLE}) b USING (row_id, sentence)) GROUP BY gold, predicted")
def sentence_outer_align(spark, sf_dir):
    gold, predicted = _sentence_labels(spark, sf_dir)
    return align.outer_labels(gold, predicted, ["row_id", "sentence"]).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def _metadata_spans(spark, sf_dir) -> DataFrame:
    """(row_id, text, labels, tokens): where each record's entity names stand in its text."""
    names = table(spark, sf_dir, "metadata_entity").where(~fn.is_missing(F.col("metadata_name"))).groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct(F.col("metadata_name").alias("name"), F.coalesce(fn.key_text(F.col("metadata_type")), F.lit("")).alias("type")))).alias("names"))
    rows = table(spark, sf_dir, "survey").select("row_id", fn.strip(F.col("raw_text")).alias("text")).where("text <> ''").join(names, "row_id")
    found = rows.withColumn("labels", F.array_sort(spans.located(F.col("text"), F.col("names")))).where(F.size("labels") > 0)
    return found.select("row_id", "text", "labels", fn.spaced_tokens(F.col("text")).alias("tokens"))


_ENTITY_SPANS = f"""SELECT row_id, s, s + length(name) AS e, type FROM (
    SELECT row_id, name, type, instr(text, name) - 1 AS s FROM (SELECT DISTINCT row_id, metadata_name AS name, coalesce(lower({_stripped("metadata_type")}), '') AS type FROM metadata_entity WHERE {_stripped("metadata_name")} <> '')
    JOIN (SELECT row_id, {_stripped("raw_text")} AS text FROM survey) USING (row_id) WHERE text <> '') WHERE s >= 0"""
_TEXT_TOKENS = _words_sql(f"SELECT row_id, {_stripped('raw_text')} AS text FROM survey WHERE row_id IN (SELECT row_id FROM metadata_entity)", "row_id", "text")


@query(f"""SELECT row_id, token, "start", "end", arg_min(type, (s, e, type)) AS token_labels FROM ({_TEXT_TOKENS}) t JOIN ({_ENTITY_SPANS}) x USING (row_id) WHERE t."start" < x.e AND t."end" > x.s GROUP BY row_id, token, "start", "end" """)
def span_overlap_join(spark, sf_dir):
    rows = _metadata_spans(spark, sf_dir).withColumn("token_labels", spans.token_labels(F.col("tokens"), F.col("labels")))
    return rows.select("row_id", F.inline(F.arrays_zip("tokens", "token_labels"))).where("token_labels <> 'O'").select("row_id", "tokens.*", "token_labels")


@query(f"""SELECT row_id, token, arg_min(CASE WHEN "start" = s THEN 'B-' ELSE 'I-' END || type, (s, e, type)) AS bio FROM ({_TEXT_TOKENS}) t JOIN ({_ENTITY_SPANS}) x USING (row_id) WHERE t."start" >= x.s AND t."end" <= x.e GROUP BY row_id, place, token""")
def bio_encode(spark, sf_dir):
    rows = _metadata_spans(spark, sf_dir).withColumn("bio", spans.bio_labels(F.col("tokens"), F.col("labels")))
    return rows.select("row_id", F.inline(F.arrays_zip("tokens", "bio"))).where("bio <> 'O'").select("row_id", "tokens.token", "bio")


@query()
def token_f1(spark, sf_dir):
    names = lambda c: F.coalesce(F.transform(F.col(c)["metadata"], lambda m: F.struct(m["metadata_name"].alias("name"), F.coalesce(fn.key_text(m["metadata_type"]), F.lit("")).alias("type"))), F.array().cast("array<struct<name:string,type:string>>"))
    rows = _analysis_pairs(spark, sf_dir).select("text", fn.spaced_tokens(F.col("text")).alias("tokens"), *[F.array_sort(spans.located(F.col("text"), names(c))).alias(c) for c in ("gold", "predicted")])
    labels = rows.select(*[spans.token_labels(F.col("tokens"), F.col(c)).alias(c) for c in ("gold", "predicted")])
    return metrics.token_f1(labels, "gold", "predicted").select(_r(F.col("token_f1"), "token_f1"))


_RUNS = """SELECT user_id, event_type, conf, grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM (SELECT *, value / 100.0::DOUBLE AS conf, event_id AS grp FROM events)"""


@query("""SELECT user_id, type, count(*) AS entities, sum(tokens)::BIGINT AS tokens, round(max(confidence), 6) AS best FROM (
    SELECT user_id, island, type, count(*) AS tokens, avg(conf) AS confidence FROM (
      SELECT *, sum(CASE WHEN type IS NOT NULL AND (prev IS DISTINCT FROM type OR value >= 80) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
        SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (
          SELECT *, value / 100.0::DOUBLE AS conf, CASE WHEN value / 100.0::DOUBLE >= 0.2 THEN event_type END AS type FROM events))) WHERE type IS NOT NULL GROUP BY user_id, island, type) GROUP BY user_id, type""")
def bio_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.concat(F.when(F.col("value") >= 80, "B-").otherwise("I-"), F.col("event_type")).alias("label"), (F.col("value") / 100).alias("confidence"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    found = spans.bio_decode(e, "user_id", "at", threshold=0.2)
    return found.groupBy("user_id", "type").agg(F.count("*").alias("entities"), F.sum("tokens").alias("tokens"), _r(F.max("confidence"), "best"))


def _fold_sql(entries: str, most: int, budget: int) -> str:
    """(row_id, i) of the entries (row_id, i, size) that are taken one after the other while there is room."""
    return f"""WITH RECURSIVE e AS ({entries}), f(row_id, i, n, used, hit) AS (
        SELECT row_id, 0::BIGINT, 0, 0::BIGINT, false FROM e GROUP BY row_id UNION ALL
        SELECT f.row_id, e.i, n + (n < {most} AND used + size <= {budget})::INT, used + CASE WHEN n < {most} AND used + size <= {budget} THEN size ELSE 0 END, n < {most} AND used + size <= {budget} FROM f JOIN e ON e.row_id = f.row_id AND e.i = f.i + 1)
        SELECT e.row_id, (f.n - 1)::INT AS place, e.name FROM f JOIN e USING (row_id, i) WHERE f.hit"""


@query(_fold_sql(f"SELECT row_id, theme AS name, length(theme) AS size, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(theme_relevance_score, 0) DESC, length(theme) DESC, theme) AS i FROM theme_annotation WHERE {_stripped('theme')} <> ''", 3, 40))
def greedy_budget(spark, sf_dir):
    t = table(spark, sf_dir, "theme_annotation").where(~fn.is_missing(F.col("theme")))
    entry = F.struct(F.coalesce("theme_relevance_score", F.lit(0.0)).alias("confidence"), F.length("theme").alias("size"), F.col("theme").alias("name"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.coalesce("theme_relevance_score", F.lit(0.0))).alias("a"), (-F.length("theme")).alias("b"), "theme", entry.alias("e"))))
    rows = t.groupBy("row_id").agg(F.transform(ranked, lambda x: x["e"]).alias("entries"))
    return rows.select("row_id", F.posexplode(spans.greedy_budget(F.col("entries"), most=3, budget=40)).alias("place", "e")).select("row_id", "place", "e.name")


_BY_NAME = f"""SELECT row_id, metadata_name AS name, length(metadata_name) AS size, row_number() OVER (PARTITION BY row_id ORDER BY confidence DESC, length(metadata_name) DESC, item_no) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, lower({_stripped("coalesce(metadata_type, '')")}), lower({_stripped("metadata_name")}) ORDER BY confidence DESC, item_no) AS same FROM (
      SELECT *, coalesce(metadata_sentiment_score, 0) AS confidence FROM metadata_entity WHERE {_stripped("metadata_name")} <> '')) WHERE same = 1"""


@query(_fold_sql(_BY_NAME, 2, 24))
def entity_budget(spark, sf_dir):
    m = table(spark, sf_dir, "metadata_entity").where(~fn.is_missing(F.col("metadata_name")))
    entry = F.struct(F.coalesce("metadata_sentiment_score", F.lit(0.0)).alias("confidence"), F.length("metadata_name").alias("size"), F.col("metadata_name").alias("name"), F.coalesce("metadata_type", F.lit("")).alias("type"))
    rows = m.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    return rows.select("row_id", F.posexplode(spans.greedy_budget(spans.best_by_name(F.col("entries")), most=2, budget=24)).alias("place", "e")).select("row_id", "place", "e.name")


# Bags of words over typed themes: the sentiment is the label.
_DOCS = f"SELECT annotation_id, theme AS text, lower(trim(theme_sentiment)) AS label, {_HASHED.format('annotation_id::VARCHAR')} AS split FROM theme_annotation WHERE trim(theme) <> '' AND lower(trim(theme_sentiment)) IN ('positive','negative','neutral')"
_TOKENS = "SELECT label, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_'']+')) AS token FROM ({0}) WHERE split = 'train'".format(_DOCS)


def theme_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "theme_annotation").where(~fn.is_missing(F.col("theme")))
    rows = t.select(F.col("annotation_id").cast("string").alias("example_id"), F.col("theme").alias("text"), fn.sentiment(F.col("theme_sentiment")).alias("label")).where("label is not null")
    return profiles.hash_splits(rows)


@query(f"SELECT l.label, coalesce(count(d.label), 0) / greatest((SELECT count(*) FROM ({_DOCS}) WHERE split = 'train'), 1)::DOUBLE AS prior FROM (VALUES ('positive'), ('negative'), ('neutral')) l(label) LEFT JOIN (SELECT label FROM ({_DOCS}) WHERE split = 'train') d ON d.label = l.label GROUP BY l.label")
def bow_priors(spark, sf_dir):
    return bow.train(theme_docs(spark, sf_dir).where("split = 'train'"), LABELS).priors.select("label", "prior")


@query(f"SELECT label, token, count(*) AS n FROM ({_TOKENS}) GROUP BY label, token")
def bow_counts(spark, sf_dir):
    return bow.train(theme_docs(spark, sf_dir).where("split = 'train'"), LABELS).counts.select("label", "token", "n")


@query(f"SELECT DISTINCT token FROM ({_TOKENS})")
def bow_vocabulary(spark, sf_dir):
    return bow.train(theme_docs(spark, sf_dir).where("split = 'train'"), LABELS).counts.select("token").distinct()


_PREDICTED = f"""WITH docs AS ({_DOCS}), tokens AS ({_TOKENS}), cls AS (SELECT l.label, l.place, (SELECT count(*) FROM docs WHERE split = 'train' AND label = l.label) / greatest((SELECT count(*) FROM docs WHERE split = 'train'), 1)::DOUBLE AS prior,
      (SELECT count(*) FROM tokens WHERE label = l.label) AS total, greatest((SELECT count(DISTINCT token) FROM tokens), 1) AS v FROM (VALUES ('positive', 0), ('negative', 1), ('neutral', 2)) l(label, place)),
    cnt AS (SELECT label, token, count(*) AS n FROM tokens GROUP BY label, token), dt AS (SELECT annotation_id, token, count(*) AS times FROM (SELECT annotation_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_'']+')) AS token FROM docs WHERE split = 'val') GROUP BY annotation_id, token),
    sc AS (SELECT d.annotation_id, c.label, c.place, round(ln(greatest(any_value(c.prior), 1e-12::DOUBLE)) + coalesce(sum(CASE WHEN dt.token IS NOT NULL THEN dt.times * ln((coalesce(cnt.n, 0) + 1) / (c.total + c.v)::DOUBLE) END), 0), 9) AS score
      FROM (SELECT annotation_id FROM docs WHERE split = 'val') d CROSS JOIN cls c LEFT JOIN dt USING (annotation_id) LEFT JOIN cnt ON cnt.label = c.label AND cnt.token = dt.token GROUP BY d.annotation_id, c.label, c.place)
    SELECT annotation_id::VARCHAR AS example_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY score DESC, place) AS rn FROM sc) WHERE rn = 1"""


@query(_PREDICTED)
def bow_predict(spark, sf_dir):
    docs = theme_docs(spark, sf_dir)
    return bow.predict(bow.train(docs.where("split = 'train'"), LABELS), docs.where("split = 'val'"), "example_id").select("example_id", "predicted")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = profiles.classification_profile(LABELS)
    docs = theme_docs(spark, sf_dir)
    val = docs.where("split = 'val'")
    scored = profile.evaluate(val, profile.predict(profile.train(docs.where("split = 'train'")), val))
    return scored.select("examples", *[_r(F.col(c), c) for c in ("accuracy", "macro_f1", "json_schema_compliance", "val_metric")])


@query(f"""WITH p AS (SELECT d.label AS gold, x.predicted FROM ({_PREDICTED}) x JOIN ({_DOCS}) d ON d.annotation_id::VARCHAR = x.example_id), f AS (SELECT avg(CASE WHEN 2*tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END) AS macro_f1 FROM (
      SELECT (SELECT count(*) FROM p WHERE gold = l.label AND predicted = l.label) AS tp, (SELECT count(*) FROM p WHERE gold <> l.label AND predicted = l.label) AS fp, (SELECT count(*) FROM p WHERE gold = l.label AND predicted <> l.label) AS fn FROM (VALUES ('positive'), ('negative'), ('neutral')) l(label)))
    SELECT count(*) AS examples, round(avg((gold = predicted)::INT::DOUBLE), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1, 1.0::DOUBLE AS json_schema_compliance, round(any_value(macro_f1) * 0.8::DOUBLE + avg((gold = predicted)::INT::DOUBLE) * 0.2::DOUBLE, 6) AS val_metric FROM p, f""")
def bow_eval(spark, sf_dir):
    return flagship(spark, sf_dir)


_LEX = """SELECT phrase, arg_max(type, (n, type)) AS type FROM (SELECT phrase, type, count(*) AS n FROM (
    SELECT lower(trim(metadata_name)) AS phrase, lower(trim(metadata_type)) AS type FROM metadata_entity WHERE trim(metadata_name) <> '' AND trim(metadata_type) <> '') GROUP BY phrase, type) GROUP BY phrase"""


def _entity_spans(spark, sf_dir) -> DataFrame:
    m = table(spark, sf_dir, "metadata_entity").where(~fn.is_missing(F.col("metadata_name")) & ~fn.is_missing(F.col("metadata_type")))
    return m.select(F.col("metadata_name").alias("phrase"), fn.key_text(F.col("metadata_type")).alias("type"))


@query(_LEX)
def lexicon_train(spark, sf_dir):
    return lexicon.train(_entity_spans(spark, sf_dir))


# Occurrences of each phrase without overlaps, then of all phrases the longest first.
_LEX_HITS = f"""SELECT row_id, phrase, type, s, s + length(phrase) AS e, row_number() OVER (PARTITION BY row_id ORDER BY length(phrase) DESC, phrase, s) AS i FROM (
    SELECT row_id, phrase, type, unnest({_starts_sql("low", "phrase")}) AS s FROM (SELECT row_id, lower({_stripped("raw_text")}) AS low FROM survey WHERE raw_text IS NOT NULL) JOIN ({_LEX}) ON contains(low, phrase))"""


@query(f"""WITH RECURSIVE h AS ({_LEX_HITS}), f(row_id, i, taken) AS (SELECT row_id, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT, type VARCHAR)[] FROM h GROUP BY row_id UNION ALL
    SELECT f.row_id, h.i, CASE WHEN len(list_filter(taken, lambda t: h.s < t.e AND h.e > t.s)) = 0 THEN list_append(taken, {{'s': h.s::BIGINT, 'e': h.e::BIGINT, 'type': h.type}}) ELSE taken END FROM f JOIN h ON h.row_id = f.row_id AND h.i = f.i + 1)
    SELECT row_id, t.s::INT AS "start", t.e::INT AS "end", t.type AS type FROM (SELECT row_id, unnest(arg_max(taken, i)) AS t FROM f GROUP BY row_id)""")
def lexicon_predict(spark, sf_dir):
    docs = table(spark, sf_dir, "survey").select("row_id", fn.strip(F.col("raw_text")).alias("text"))
    return lexicon.predict(docs, "row_id", lexicon.train(_entity_spans(spark, sf_dir))).select("row_id", F.inline("spans"))


@query(f"""WITH e AS (SELECT row_id, nullif(lower({_stripped("emotion")}), '') AS name FROM theme_annotation)
    SELECT row_id, list_transform((SELECT list(DISTINCT name ORDER BY name) FROM e WHERE name IS NOT NULL), lambda v: coalesce(list_contains(own, v), false)::INT)::VARCHAR AS hot FROM (SELECT row_id, list(DISTINCT name) AS own FROM e GROUP BY row_id)""")
def vocabulary_multi_hot(spark, sf_dir):
    emotion = F.when(~fn.is_missing(F.col("emotion")), fn.key_text(F.col("emotion")))
    rows = table(spark, sf_dir, "theme_annotation").groupBy("row_id").agg(F.collect_set(emotion).alias("emotions"))
    return targets.with_multi_hot(rows, "emotions").select("row_id", F.concat(F.lit("["), F.concat_ws(", ", F.transform("hot", lambda x: x.cast("string"))), F.lit("]")).alias("hot"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as an experiment log, which grows with the data: value is the metric, props.k the compliance."""
    e = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double") / 100
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("experiment_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), F.col("event_type").alias("model_family"), (F.col("value") / 100).cast("string").alias("val_metric"), k.cast("string").alias("json_schema_compliance"), F.when(F.col("value") >= 50, "keep").otherwise("discard").alias("status"))


_LOG = "SELECT event_id AS seq, event_id::VARCHAR AS experiment_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, event_type AS model_family, value / 100.0::DOUBLE AS metric, (props->>'$.k')::DOUBLE / 100.0::DOUBLE AS compliance, CASE WHEN value >= 50 THEN 'KEEP' ELSE 'DISCARD' END AS status FROM events"


@query(f"SELECT row_number() OVER (ORDER BY metric DESC, compliance DESC, timestamp_utc DESC, seq)::INT AS rank, experiment_id, round(metric, 6) AS metric FROM ({_LOG}) ORDER BY rank LIMIT 20")
def leaderboard_top(spark, sf_dir):
    return tracker.leaderboard(runs(spark, sf_dir)).select("rank", "experiment_id", _r(F.col("metric"), "metric"))


@query(f"SELECT model_family, round(max(metric), 6) AS best_val_metric, arg_max(experiment_id, (metric, compliance, timestamp_utc, -seq)) AS best_experiment_id, count(*) AS num_experiments FROM ({_LOG}) GROUP BY model_family")
def best_by_family(spark, sf_dir):
    return tracker.by_family(runs(spark, sf_dir)).select("model_family", _r(F.col("best_val_metric"), "best_val_metric"), "best_experiment_id", "num_experiments")


@query(f"SELECT arg_max(experiment_id, (metric, compliance, timestamp_utc, -seq)) AS best_experiment_id, round(max(metric), 6) AS best_val_metric, count(*) AS total_experiments FROM ({_LOG})")
def experiment_summary(spark, sf_dir):
    return tracker.summary(runs(spark, sf_dir)).select("best_experiment_id", _r(F.col("best_val_metric"), "best_val_metric"), "total_experiments")


@query(f"SELECT seq, round(coalesce(b, 0), 6) AS best_before, CASE WHEN metric >= coalesce(b, 0) THEN 'keep' ELSE 'discard' END AS decision FROM (SELECT *, max(metric) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({_LOG}))")
def keep_discard(spark, sf_dir):
    return tracker.decisions(runs(spark, sf_dir)).select("seq", _r(F.col("best_before"), "best_before"), "decision")


@query(f"SELECT seq, round(max(metric) OVER (ORDER BY seq), 6) AS best_so_far FROM ({_LOG}) WHERE status = 'KEEP'")
def running_best(spark, sf_dir):
    return tracker.running_best(runs(spark, sf_dir)).select("seq", _r(F.col("best_so_far"), "best_so_far"))


@query(f"SELECT * FROM (SELECT seq, round(metric - lag(metric) OVER (ORDER BY seq), 6) AS delta FROM ({_LOG}) WHERE status = 'KEEP') WHERE delta IS NOT NULL")
def improvement_delta(spark, sf_dir):
    return tracker.improvements(runs(spark, sf_dir)).select("seq", _r(F.col("delta"), "delta"))


@query("""SELECT row_number() OVER (ORDER BY metric DESC, compliance DESC, timestamp_utc DESC, experiment_id)::INT AS rank, experiment_id, round(metric, 6) AS metric FROM (
    SELECT *, coalesce(CASE WHEN NOT isnan(m) THEN m END, 0) AS metric, coalesce(CASE WHEN NOT isnan(c) THEN c END, 0) AS compliance FROM (SELECT *, try_cast(val_metric AS DOUBLE) AS m, try_cast(json_schema_compliance AS DOUBLE) AS c FROM experiment_log)) ORDER BY rank LIMIT 20""")
def log_leaderboard(spark, sf_dir):
    log = table(spark, sf_dir, "experiment_log").withColumn("seq", F.col("experiment_id"))
    return tracker.leaderboard(log).select("rank", "experiment_id", _r(F.col("metric"), "metric"))


@query("""SELECT experiment_id, timestamp_utc, name, round(value, 6) AS value FROM (SELECT experiment_id, timestamp_utc, name, (j->>('$."' || name || '"'))::DOUBLE AS value FROM (
    SELECT experiment_id, timestamp_utc, j, unnest(json_keys(j)) AS name FROM (SELECT experiment_id, timestamp_utc, CASE WHEN json_valid(metrics_json) THEN metrics_json::JSON END AS j FROM experiment_log) WHERE json_type(j) = 'OBJECT'))""")
def log_metrics(spark, sf_dir):
    parsed = readers.with_parsed(table(spark, sf_dir, "experiment_log"))
    return parsed.select("experiment_id", "timestamp_utc", F.explode("metrics").alias("name", "value")).select("experiment_id", "timestamp_utc", "name", _r(F.col("value"), "value"))


@query("SELECT upper(trim(status)) AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM experiment_log)::DOUBLE, 6) AS share FROM experiment_log GROUP BY 1")
def outcome_counts(spark, sf_dir):
    return tracker.outcome_counts(table(spark, sf_dir, "experiment_log")).select("status", "n", _r(F.col("share"), "share"))


@query(f"""SELECT split, sum(n)::BIGINT AS examples, coalesce(sum(CASE WHEN id IS NULL THEN n END), 0)::BIGINT AS missing_ids, coalesce(sum(CASE WHEN id IS NOT NULL THEN n - 1 END), 0)::BIGINT AS duplicate_ids,
    coalesce(sum(CASE WHEN id IS NULL THEN n END), 0) = 0 AND coalesce(sum(CASE WHEN id IS NOT NULL THEN n - 1 END), 0) = 0 AS ok FROM (
    SELECT x.split, CASE WHEN trim(s.example_id) <> '' THEN s.example_id END AS id, count(*) AS n FROM ({_SPLIT}) x JOIN survey s USING (row_id) GROUP BY 1, 2) GROUP BY split""")
def preflight_report(spark, sf_dir):
    rows = survey_splits(spark, sf_dir).join(table(spark, sf_dir, "survey").select("row_id", "example_id"), "row_id")
    return profiles.preflight(rows)


@query(f"""WITH a AS (SELECT lower({_stripped("theme")}) AS label FROM theme_annotation), b AS (SELECT lower({_stripped("emotion")}) AS label FROM theme_annotation)
    SELECT domain, label FROM (SELECT 'union' AS domain, label FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', label FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'theme only', label FROM (FROM a EXCEPT FROM b)) WHERE label <> ''""")
def set_operations(spark, sf_dir):
    t = table(spark, sf_dir, "theme_annotation")
    a, b = t.select(fn.key_text(F.col("theme")).alias("label")), t.select(fn.key_text(F.col("emotion")).alias("label"))
    named = lambda df, name: df.select(F.lit(name).alias("domain"), "label")
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "both")).unionByName(named(a.subtract(b), "theme only")).where("label <> ''")


@query("""WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f(user_id, i, ema) AS (SELECT user_id, i, 0.05::DOUBLE * value FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.95::DOUBLE * f.ema + 0.05::DOUBLE * s.value FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
    SELECT user_id, max(i)::INT AS steps, round(arg_max(ema, i), 6) AS ema FROM f GROUP BY user_id""")
def loss_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return tracker.loss_trend(e, "user_id", "at", "value").select("user_id", "steps", _r(F.col("ema"), "ema"))


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS probability FROM embeddings""")
def softmax_argmax(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", fn.argmax(F.col("v")).alias("best"), _r(F.array_max(fn.softmax(F.col("v"))), "probability"))


@query("SELECT form_key, count(*) AS records, count(raw_text) AS texts, max(row_id) AS newest FROM survey GROUP BY form_key")
def records_by_form(spark, sf_dir):
    return table(spark, sf_dir, "survey").groupBy("form_key").agg(F.count("*").alias("records"), F.count("raw_text").alias("texts"), F.max("row_id").alias("newest"))
