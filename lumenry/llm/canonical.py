"""Freely typed values mapped to the nearest entry of a reference list, with built-in SQL functions only.

A partition-based pigeonhole join: a reference string that may differ by k edits is cut into k + 1 segments,
one of which must stand unchanged in the typed string, shifted by at most k places. So substrings of the
typed strings join segments on equality, and only those pairs are verified by levenshtein. Values without a
verified partner are reported through an anti-join.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek small letters that look like Latin ones, and what they look like.
ALIKE_FROM = "аеорсухіјѕһԁԛԝвнкмтαβεικνορτυχγ"
ALIKE_TO = "aeopcyxijshdqwbhkmtabeikvoptuxy"
# Digits and signs typed in place of letters.
DIGIT_FROM, DIGIT_TO = "0134578@$", "oieastbas"

NONE = 0


def _plain_letters() -> tuple[str, str]:
    """Full-width signs and accented Latin letters with their plain forms, by Unicode decomposition."""
    wide = [chr(c) for c in range(0xFF01, 0xFF5F)]
    accented = [chr(c) for c in range(0xC0, 0x250) if chr(c).islower()]
    pairs = [(c, unicodedata.normalize("NFKD", c).lower()[0]) for c in wide + accented]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


def folded_words(c: Column) -> Column:
    """Lower-case words without accents, invisible signs, look-alikes and punctuation. camelCase splits."""
    visible = F.regexp_replace(c, r"[\p{Cf}\p{Mn}]", "")
    split = F.regexp_replace(visible, r"(\p{Ll})(\p{Lu})(?=\p{Ll}{2})", "$1 $2")
    plain = F.translate(F.translate(F.lower(split), *_plain_letters()), ALIKE_FROM, ALIKE_TO)
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}@$]+", " "), " "), lambda w: w != "")


def _letters(words: Column) -> Column:
    """Words with a letter, digits in them read as letters; a number by itself is numbering, not spelling."""
    spelled = F.filter(words, lambda w: w.rlike(r"\p{L}") | (F.length(w) > 3))
    return F.transform(spelled, lambda w: F.when(w.rlike(r"[0-9@$]"), F.translate(w, DIGIT_FROM, DIGIT_TO)).otherwise(w))


def edits(length: Column) -> Column:
    """Edits that a reference string of this length may differ by."""
    return F.when(length <= 4, 1).when(length <= 7, 2).otherwise(3)


def reference_forms(labels: DataFrame) -> DataFrame:
    """(field_name, label_id, form, sorted_form): each name of each entry, folded."""
    names = F.explode(F.concat(F.array("label_name"), F.coalesce("also_known", F.array().cast("array<string>"))))
    words = folded_words(F.col("name"))
    rows = labels.select("field_name", "label_id", names.alias("name")).where("name is not null").select("field_name", "label_id", words.alias("words"))
    return rows.select("field_name", "label_id", F.concat_ws("", "words").alias("form"), F.concat_ws("", F.array_sort("words")).alias("sorted_form")).where("form <> ''").dropDuplicates(["field_name", "label_id", "form"])


def _forms(values: DataFrame) -> DataFrame:
    """(field_name, value, form, sorted, spare): spellings to look up. Those that leave out a word, or change the
    order, may differ by one edit less."""
    words = values.select("field_name", "value", _letters(folded_words(F.col("value"))).alias("w"))
    n = F.size("w")
    joined = lambda a: F.concat_ws("", a)
    form = lambda text, is_sorted, cost: F.struct(text.alias("form"), F.lit(is_sorted).alias("sorted"), F.lit(cost).alias("cost"))
    options = F.array(
        form(joined("w"), False, 0),
        form(F.when(n > 1, joined(F.reverse("w"))), False, 1),
        form(F.when(n > 1, joined(F.array_sort("w"))), True, 1),
        form(F.when(n > 1, joined(F.slice("w", 2, F.greatest(n - 1, F.lit(0))))), False, 1),
        form(F.when(n > 1, joined(F.slice("w", 1, F.greatest(n - 1, F.lit(0))))), False, 1),
        form(F.when(n > 2, joined(F.slice("w", 1, F.greatest(n - 2, F.lit(0))))), False, 1),
    )
    return words.select("field_name", "value", F.inline(options)).where("form is not null and form <> ''").groupBy("field_name", "value", "form", "sorted").agg(F.min("cost").alias("cost"))


def map_values(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(field_name, value, label_id, distance) for each distinct (field_name, value): the nearest entry, or 0 and null.

    The nearest is the one of fewest edits, a spelling in the given order before a rearranged one, the smallest
    label_id last. Null values are left out; blank ones and ones without letters map to 0. An empty list maps
    all to 0. Long values match nothing, as lengths may differ by no more than the edits.
    """
    values = values.select("field_name", "value").where("value is not null").distinct()
    references = reference_forms(labels)
    sides = references.select("field_name", "label_id", F.inline(F.array(F.struct(F.col("form").alias("reference"), F.lit(False).alias("sorted")), F.struct(F.col("sorted_form").alias("reference"), F.lit(True).alias("sorted")))))
    length = F.length("reference")
    k = edits(length)
    # Segment i of k + 1: the first ones as long as the floor, the last ones one longer.
    bounds = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct((F.floor(i * length / (k + 1))).cast("int").alias("at"), (F.floor((i + 1) * length / (k + 1)) - F.floor(i * length / (k + 1))).cast("int").alias("n")))
    segments = sides.select("*", k.alias("k"), F.inline(bounds)).select("*", F.expr("substring(reference, at + 1, n)").alias("segment"))
    # The places at which each segment may stand, so that the join is on the substring and on its place.
    placed = segments.select("*", F.explode(F.sequence(F.greatest(F.col("at") - F.col("k"), F.lit(0)), F.col("at") + F.col("k"))).alias("place"))
    sizes = segments.groupBy("field_name", "sorted").agg(F.collect_set("n").alias("sizes"), F.max(F.length("reference") + F.col("k")).alias("longest"))
    forms = _forms(values)
    places = forms.join(sizes, ["field_name", "sorted"]).where(F.length("form") <= F.col("longest"))
    cut = places.select("field_name", "value", "form", "sorted", "cost", F.explode("sizes").alias("n")).where(F.length("form") >= F.col("n"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.length("form") - F.col("n"))).alias("place")).select("*", F.expr("substring(form, place + 1, n)").alias("segment"))
    near = cut.join(placed, ["field_name", "sorted", "n", "segment", "place"]).where(F.abs(F.length("form") - F.length("reference")) <= F.col("k"))
    pairs = near.select("field_name", "value", "form", "cost", "reference", "label_id", "k").distinct()
    verified = pairs.select("*", F.levenshtein("form", "reference").alias("distance")).where(F.col("distance") <= F.greatest(F.col("k") - F.col("cost"), F.lit(0)))
    rank = F.struct((F.col("distance") * 2 + F.col("cost")).alias("rank"), "label_id", "distance")
    best = verified.groupBy("field_name", "value").agg(F.min(rank).alias("best")).select("field_name", "value", "best.label_id", "best.distance")
    unmatched = values.join(best, ["field_name", "value"], "left_anti")
    return best.unionByName(unmatched.select("field_name", "value", F.lit(NONE).cast("bigint").alias("label_id"), F.lit(None).cast("int").alias("distance")))


def typed_values(themes: DataFrame, entities: DataFrame) -> DataFrame:
    """(field_name, item_id, value) of the three typed fields; nulls and blanks left out."""
    emotion = themes.select(F.lit("emotion").alias("field_name"), F.col("annotation_id").alias("item_id"), F.col("emotion").alias("value"))
    theme = themes.select(F.lit("theme").alias("field_name"), F.col("annotation_id").alias("item_id"), F.col("theme").alias("value"))
    kind = entities.select(F.lit("metadata_type").alias("field_name"), F.col("entity_id").alias("item_id"), F.col("metadata_type").alias("value"))
    return theme.unionByName(emotion).unionByName(kind).where(F.col("value").isNotNull() & (F.regexp_replace("value", r"[\s\p{Z}]+", "") != ""))


def map_items(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(field_name, item_id, value, label_id, distance) of every item: values are mapped once and joined back."""
    return items.join(map_values(items, labels), ["field_name", "value"]).select("field_name", "item_id", "value", "label_id", "distance")
