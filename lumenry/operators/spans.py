"""Character spans, token labels, and the greedy choices among them. All stay within a row: nothing is shuffled but islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import key_text

SPANS = "array<struct<start:int,end:int,type:string>>"


def token_labels(tokens: Column, spans: Column) -> Column:
    """The type of the first span that overlaps each token (start, end), in span order; 'O' for none."""
    return F.transform(tokens, lambda t: F.coalesce(F.get(F.filter(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])), F.lit(0))["type"], F.lit("O")))


def bio_labels(tokens: Column, spans: Column) -> Column:
    """B- or I- with the type of the first span that contains each token; 'O' for none; null for a token without width."""

    def label(t: Column) -> Column:
        span = F.get(F.filter(spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"])), F.lit(0))
        inside = F.concat(F.when(t["start"] == span["start"], "B-").otherwise("I-"), span["type"])
        return F.when(t["end"] > t["start"], F.coalesce(inside, F.lit("O")))

    return F.transform(tokens, label)


def located(text: Column, names: Column) -> Column:
    """(start, end, type) where each (name, type) first stands in the text; names that don't are left out."""
    spans = F.transform(names, lambda n: F.struct((F.call_function("instr", text, n["name"]) - 1).alias("start"), (F.call_function("instr", text, n["name"]) - 1 + F.length(n["name"])).alias("end"), n["type"].alias("type")))
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]))


def bio_decode(tokens: DataFrame, key: str, order: str, threshold: float = 0.80) -> DataFrame:
    """(key, island, type, start, end, confidence, tokens) from rows (key, order, start, end, label, confidence).

    An entity ends at a token without width or label, of low confidence, labelled 'O' or of another type, and
    where a new one begins. Windows are by key, so its tokens are one task's: a document's, not the corpus's.
    """
    w = W.partitionBy(key).orderBy(order)
    kept = (F.col("end") > F.col("start")) & (F.col("confidence") >= threshold) & F.col("label").rlike("^[BI]-.")
    kind = F.when(F.coalesce(kept, F.lit(False)), F.substring("label", 3, 1 << 20))
    marked = tokens.withColumn("type", kind)
    fresh = F.col("type").isNotNull() & (F.col("label").startswith("B-") | ~F.lag("type").over(w).eqNullSafe(F.col("type")))
    islands = marked.withColumn("island", F.sum(fresh.cast("int")).over(w)).where("type is not null")
    return islands.groupBy(key, "island", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("confidence").alias("confidence"), F.count("*").alias("tokens"))


def greedy_budget(entries: Column, most: int = 10, budget: int = 256) -> Column:
    """Entries (confidence, size, name and others) in the given order while fewer than `most` and within the budget of sizes; what is too large is passed over."""
    start = F.struct(F.slice(entries, 1, 0).alias("taken"), F.lit(0).alias("used"))

    def step(state: Column, e: Column) -> Column:
        fits = (F.size(state["taken"]) < most) & (state["used"] + e["size"] <= budget)
        more = F.struct(F.concat(state["taken"], F.array(e)).alias("taken"), (state["used"] + e["size"]).alias("used"))
        return F.when(fits, more).otherwise(state)

    return F.aggregate(entries, start, step)["taken"]


def best_by_name(entries: Column) -> Column:
    """Entries (confidence, size, name, type), of equal type and name but for case the one of highest confidence, the first on
    ties; then by confidence and size, both descending, equal ones in their order."""
    key = lambda e: F.struct(key_text(e["type"]).alias("type"), key_text(e["name"]).alias("name"))
    placed = F.transform(entries, lambda e, i: F.struct((-e["confidence"]).alias("a"), i.alias("place"), key(e).alias("key"), e.alias("e")))
    ordered = F.array_sort(placed)
    keys = F.transform(ordered, lambda x: x["key"])
    kept = F.filter(ordered, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    ranked = F.array_sort(F.transform(kept, lambda x: F.struct(x["a"].alias("a"), (-x["e"]["size"]).alias("b"), x["place"].alias("place"), x["e"].alias("e"))))
    return F.transform(ranked, lambda x: x["e"])


def greedy_nonoverlap(candidates: Column) -> Column:
    """Spans (start, end, type) in the given order, each unless it overlaps one taken before; sorted."""
    fold = F.aggregate(candidates, F.array().cast(SPANS), lambda taken, c: F.when(F.exists(taken, lambda t: (c["start"] < t["end"]) & (c["end"] > t["start"])), taken).otherwise(F.concat(taken, F.array(c))))
    return F.array_sort(fold)
