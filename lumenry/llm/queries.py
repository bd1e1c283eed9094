"""Queries of the corpus operators over a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .alike import count_signs, plain_forms, survey_texts
from .canonical import map_items, map_values, typed_values
from .copies import survey_copies
from .encoding import decode, encode, token_counts
from .garbled import repaired, train
from .languages import label_code, label_stretches, mislabelled
from .languages import train as train_languages
from .overlap import CONTAINED, class_overlaps, members, overlaps, report, split_of
from .packing import fill, pack_documents
from .personal import personal_data
from .sentences import sentence_units, survey_and_sentences
from .sentences import train as train_sentences


# SQL of the queries that it can express on whole tables.
_BARE = r"lower(regexp_replace(raw_text, '[\s\p{Z}\p{P}\p{C}]+', '', 'g'))"
_FORM = rf"replace(CASE WHEN {_BARE} <> '' THEN {_BARE} ELSE lower(regexp_replace(raw_text, '[\s\p{{Z}}\p{{C}}]+', '', 'g')) END, 'ß', 'ss')"
_TEXTS = r"raw_text IS NOT NULL AND regexp_replace(raw_text, '[\s\p{Z}\p{C}]+', '', 'g') <> ''"
_SPLIT = """CASE WHEN trim(coalesce(split, '')) <> '' THEN CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN lower(trim(split)) IN ('test', 'holdout') THEN 'test' END
    WHEN ('0x' || substr(md5(coalesce(example_id, printf('example-%06d', row_id))), 1, 8))::BIGINT / 4294967295::DOUBLE < 0.2::DOUBLE THEN 'eval' ELSE 'train' END"""
# A response as the sorted values of its fields, whatever their order and layout; what doesn't parse without white space.
_RESPONSE = r"""SELECT row_id, raw_text, CASE WHEN json_valid(low) THEN 'j' || (SELECT string_agg(fullkey || '=' || coalesce(atom::VARCHAR, type), chr(10) ORDER BY fullkey, atom::VARCHAR) FROM json_tree(CASE WHEN json_valid(low) THEN low ELSE 'null' END))
    ELSE 't' || regexp_replace(low, '\s+', '', 'g') END AS response FROM (SELECT row_id, raw_text, replace(lower(response_text), 'ß', 'ss') AS low FROM survey)"""
_COPIES = f"SELECT row_id, min(row_id) OVER same AS first_row_id, count(*) OVER same AS copies FROM (SELECT row_id, {_FORM} AS form, response FROM ({_RESPONSE}) WHERE {_TEXTS}) WINDOW same AS (PARTITION BY form, response)"
SQL = {
    "p5_members": f"SELECT row_id AS id, split = 'train' AS trained, min(row_id) OVER (PARTITION BY form) AS class_id FROM (SELECT row_id, {_SPLIT} AS split, {_FORM} AS form FROM survey WHERE {_TEXTS}) WHERE split IS NOT NULL",
    "p7_found": f"SELECT first_row_id, row_id FROM ({_COPIES}) WHERE first_row_id <> row_id",
    "p7_copy_counts": f"SELECT first_row_id, copies FROM ({_COPIES}) WHERE first_row_id = row_id",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "canonical_label")
    items = typed_values(table(spark, sf_dir, "theme_annotation"), table(spark, sf_dir, "metadata_entity"))
    named = labels.select("field_name", F.col("label_name").alias("value"))
    typed = items.join(named, ["field_name", "value"], "left_anti")
    return map_items(typed, labels).select("field_name", "item_id", "label_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = typed_values(table(spark, sf_dir, "theme_annotation"), table(spark, sf_dir, "metadata_entity"))
    unmatched = map_values(items, table(spark, sf_dir, "canonical_label")).where("label_id = 0")
    return items.join(unmatched, ["field_name", "value"]).groupBy("field_name", "value").agg(F.count("*").alias("items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = survey_and_sentences(table(spark, sf_dir, "survey"), table(spark, sf_dir, "sentence_sentiment"))
    return sentence_units(texts, ["origin", "item_id"], train_sentences(texts)).select("origin", "item_id", "start_char", "end_char")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "survey").select("row_id", F.col("raw_text").alias("text"))
    return personal_data(rows, "row_id").select("row_id", F.inline("pieces"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "survey").select("row_id", F.col("raw_text").alias("text"))
    return personal_data(rows, "row_id").select("row_id", "redacted")


def _plain_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = survey_texts(table(spark, sf_dir, "survey"), table(spark, sf_dir, "theme_annotation"))
    return plain_forms(texts, ["origin", "item_id", "phrase_no"], count_signs(texts))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_survey(spark, sf_dir).where("disguised").select("origin", "item_id", "phrase_no")


def p4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_survey(spark, sf_dir).select("origin", "item_id", "phrase_no", "plain")


def _split() -> Column:
    return split_of(F.col("split"), F.col("example_id"), F.col("row_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "survey"), "row_id", "raw_text", _split())
    return found.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    survey = table(spark, sf_dir, "survey")
    records = survey.select(F.col("row_id").alias("id"), _split().alias("split"), "source").where("split <> 'train'")
    return report(overlaps(survey, "row_id", "raw_text", _split()), records)


def p5_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    survey = table(spark, sf_dir, "survey")
    return class_overlaps(survey, "row_id", "raw_text", members(survey, "row_id", "raw_text", _split()))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(table(spark, sf_dir, "survey"), "row_id", "raw_text", _split())


def p5_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "survey"), "row_id", "raw_text", _split(), of_eval=CONTAINED, of_train=0.0)


def _survey_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "survey").select("row_id", F.col("raw_text").alias("text"), label_code(F.col("language")).alias("label"))
    sentences = train_sentences(rows)
    return label_stretches(rows, "row_id", train_languages(rows, sentences), sentences)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(_survey_languages(spark, sf_dir), "row_id").drop("confidence")


def p6_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survey_languages(spark, sf_dir).select("row_id", "label", F.inline("stretches"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survey_copies(table(spark, sf_dir, "survey"))
    return found.where(F.col("row_id") != F.col("first_row_id")).select("first_row_id", "row_id")


def p7_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survey_copies(table(spark, sf_dir, "survey"))
    return found.where(F.col("row_id") == F.col("first_row_id")).select("first_row_id", "copies")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ids")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_documents(counts, table(spark, sf_dir, "container_spec"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p9_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repaired(docs, "doc_id", "text", train(docs, "doc_id", "text")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repaired(docs, "doc_id", "text", train(docs, "doc_id", "text")).where("garbled").select("doc_id", "restored")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_plain": p4_plain, "p5_found": p5_found, "p5_report": p5_report, "p5_class_pairs": p5_class_pairs, "p5_members": p5_members, "p5_contained": p5_contained, "p6_found": p6_found, "p6_stretches": p6_stretches, "p7_found": p7_found, "p7_copy_counts": p7_copy_counts, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_restored": p10_restored}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
