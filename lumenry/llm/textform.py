"""Column expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, punctuation, controls and invisible format characters; letters, marks, digits and symbols stay.
SEPARATORS = r"[\s\p{Z}\p{P}\p{C}]+"


def folded(c: Column) -> Column:
    """Letter case removed; sharp s becomes ss, as its capital form does."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def bare(c: Column) -> Column:
    """Text without case, white space and punctuation; a text of nothing else keeps its punctuation."""
    return F.when(c.rlike(r"[^\s\p{Z}\p{P}\p{C}]"), folded(F.regexp_replace(c, SEPARATORS, ""))).otherwise(folded(F.regexp_replace(c, r"[\s\p{Z}\p{C}]+", "")))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\p{C}]")
