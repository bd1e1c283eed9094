"""Training targets: vocabularies over the whole table, multi-hot vectors, class ids and padded labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SENTIMENTS, multi_hot, padded, strip
from ..sources.tables import cut_lineage

__all__ = ["multi_hot", "padded", "vocabulary", "numbered", "with_multi_hot", "with_sentiment_id", "dataset_summary"]


def vocabulary(df: DataFrame, labels: str, known: Sequence[str] = ()) -> DataFrame:
    """(vocabulary): the sorted distinct labels of an array column together with known ones, in one row. Labels are a closed set, so it is small."""
    found = df.select(F.explode(labels).alias("label")).select(strip(F.col("label")).alias("label")).where("label <> ''")
    return found.agg(F.array_sort(F.array_union(F.collect_set("label"), F.array(*map(F.lit, known)).cast("array<string>"))).alias("vocabulary"))


def numbered(labels: DataFrame) -> DataFrame:
    """(label, place): the distinct labels of a column `label`, numbered from 0 in their order.

    They are sorted by ranges, each in a task of its own; a row a range is all that meets in one.
    """
    ordered = labels.where("label <> ''").distinct().repartitionByRange("label").sortWithinPartitions("label").withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(ordered).select("label", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("within"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("label", (F.col("before") + F.col("within")).cast("int").alias("place"))


def with_multi_hot(df: DataFrame, labels: str, known: Sequence[str] = ()) -> DataFrame:
    """Adds `hot`: 1 for each label of the row, 0 for each other one of the vocabulary, in its order.

    Rows meet the vocabulary in a join, so it may be of any size; nulls and blanks in a row's labels are left out.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.explode(F.array_distinct(F.transform(labels, strip))).alias("label")).where("label <> ''")
    extra = df.sparkSession.createDataFrame([(x,) for x in known], "label string")
    places = cut_lineage(numbered(each.select("label").unionByName(extra)))
    own = each.join(places, "label").groupBy("_row").agg(F.collect_list("place").alias("_places"))
    all_places = F.sequence(F.lit(0), F.lit(size - 1)) if (size := places.count()) else F.array().cast("array<int>")
    hot = F.transform(all_places, lambda i: F.coalesce(F.array_contains("_places", i), F.lit(False)).cast("int"))
    return rows.join(own, "_row", "left").withColumn("hot", hot).drop("_row", "_places")


def with_sentiment_id(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("sentiment_id", (F.array_position(F.array(*map(F.lit, SENTIMENTS)), F.col(label)) - 1).cast("int"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """(split, examples, themes, emotions, entity_types) of normalised examples: counts and sorted distinct names."""
    a = F.col("analysis")
    kinds = {"themes": a["main_themes"]["theme"], "emotions": a["main_themes"]["emotion"], "entity_types": a["metadata"]["metadata_type"]}
    none = F.array().cast("array<struct<kind:string,name:string>>")
    named = lambda kind, path: F.coalesce(F.transform(path, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))), none)
    each = [named(kind, path) for kind, path in kinds.items()]
    found = df.select(F.col("split").alias("of"), F.inline(F.concat(*each))).distinct()
    sets = found.groupBy("of").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(kind) for kind in kinds])
    counts = df.groupBy("split").agg(F.count("*").alias("examples"))
    return counts.join(sets, F.col("split").eqNullSafe(F.col("of")), "left").select("split", "examples", *[F.coalesce(kind, F.array().cast("array<string>")).alias(kind) for kind in kinds])
