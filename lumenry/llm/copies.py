"""Records that differ only in formatting, collapsed over dictionary-encoded columns.

Every distinct value of a column is canonicalised once and gets the smallest record id that bears its
canonical form as an integer identifier; records become sorted (field, value) integer tuples, and the
tuples are grouped. Texts travel once, to be made distinct; afterwards only digests and integers do.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_json
from ..sources.tables import cut_lineage
from .textform import bare, folded, is_blank

NO_VALUE = -1


def canonical_json(c: Column) -> Column:
    """JSON without layout, letter case and field order; what doesn't parse keeps everything but white space and case."""
    # Fields whose names differ only in letter case can't be one object once they are folded, so such a value is folded afterwards.
    parsed = F.coalesce(F.to_json(parse_json(folded(c))), F.to_json(parse_json(c)))
    return F.coalesce(F.concat(F.lit("j"), folded(parsed)), F.concat(F.lit("t"), folded(F.regexp_replace(c, r"\s+", ""))))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def value_ids(df: DataFrame, id_column: str, column: str, canonical: Callable[[Column], Column]) -> DataFrame:
    """(digest, value_id): the dictionary of one column, a row for each distinct value as stored."""
    distinct = (
        df.where(F.col(column).isNotNull())
        .select(F.col(id_column).alias("id"), F.col(column).alias("value"))
        .groupBy("value")
        .agg(F.min("id").alias("id"))
        .select("id", _digest(F.col("value")).alias("digest"), _digest(canonical(F.col("value"))).alias("form"))
    )
    distinct = cut_lineage(distinct)  # digests and integers of distinct values: both uses read them, and no text travels twice
    forms = distinct.groupBy("form").agg(F.min("id").alias("value_id"))
    return distinct.join(forms, "form").select("digest", "value_id")


def collapse(df: DataFrame, id_column: str, columns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(row_id, first_row_id, copies): each record with the smallest id of its group and the group's size.

    Nulls equal nulls. Records with equal ids count as copies of each other. An empty table gives no rows.
    Only the named columns are read, whatever others df has. Groups are joined by one small row each, so a
    group of any size is split over tasks by the adaptive skew handling of the join's other side.
    """
    tuples = df.select(F.col(id_column).alias("row_id"), *[_digest(F.col(c)).alias(f"digest_{i}") for i, c in enumerate(columns)])
    for i, (column, canonical) in enumerate(columns.items()):
        entries = value_ids(df, id_column, column, canonical).select(F.col("digest").alias(f"digest_{i}"), F.col("value_id").alias(f"value_{i}"))
        # Nulls, which may be a third of all rows, don't meet in a join.
        known = tuples.where(F.col(f"digest_{i}").isNotNull()).join(entries, f"digest_{i}")
        tuples = known.drop(f"digest_{i}").unionByName(tuples.where(F.col(f"digest_{i}").isNull()).withColumn(f"value_{i}", F.lit(NO_VALUE).cast(entries.schema[f"value_{i}"].dataType)).drop(f"digest_{i}"))
    pairs = F.array_sort(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"value_{i}").alias("value")) for i in range(len(columns))]))
    tuples = tuples.select("row_id", pairs.alias("record"))
    groups = tuples.groupBy("record").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))
    return tuples.join(groups, "record").select("row_id", "first_row_id", "copies")


def survey_copies(survey: DataFrame) -> DataFrame:
    """Copies among survey records with text: same text and same response up to formatting."""
    readable = survey.where(~is_blank(F.col("raw_text"))).select("row_id", "raw_text", "response_text")
    return collapse(readable, "row_id", {"raw_text": bare, "response_text": canonical_json})
