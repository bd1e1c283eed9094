"""String and array expressions of the text evaluation operators. Offsets count code points from 0."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "negative", "neutral")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once and named once, however often body uses it: plans stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_text(c: Column) -> Column:
    """Labels as they are compared: stripped and in lower case."""
    return F.lower(strip(c))


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def is_missing_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_float(c: Column, fallback: float = 0.0) -> Column:
    """A number from text; the fallback for what is none, and for NaN, which has no rank."""
    value = F.expr("NULL").cast("double") if c is None else c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(fallback))


def sentiment(c: Column) -> Column:
    """A known sentiment label, else null."""
    return let(key_text(c), lambda label: F.when(label.isin(*SENTIMENTS), label))


def sentiment_or_neutral(c: Column) -> Column:
    return F.coalesce(sentiment(c), F.lit("neutral"))


def md5_bucket(c: Column) -> Column:
    """The first 32 bits of the MD5 digest as a share of their range."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def hash_split(example_id: Column, test: float = 0.1, val: float = 0.1) -> Column:
    bucket = md5_bucket(example_id)
    return F.when(bucket < test, "test").when(bucket < test + val, "val").otherwise("train")


def named_split(c: Column) -> Column:
    """train, val or test by name or synonym; null for a blank or unknown one."""
    name = key_text(c)
    return F.when(name.isin("train", "training"), "train").when(name.isin("val", "valid", "validation", "dev"), "val").when(name.isin("test", "holdout"), "test")


def split_or_hash(c: Column, example_id: Column) -> Column:
    """The named split, the hashed one where no name is given, null for an unknown name."""
    return F.when(is_missing(c), hash_split(example_id)).otherwise(named_split(c))


def example_id_or_ordinal(example_id: Column, ordinal: Column) -> Column:
    return F.coalesce(F.when(~is_missing(example_id), example_id), F.format_string("example-%06d", ordinal))


def stable_id(prefix: str, split: Column, *parts: Column) -> Column:
    """prefix-split-digest of the parts, where a row has no id of its own."""
    return F.concat(F.lit(f"{prefix}-"), split, F.lit("-"), F.substring(F.md5(F.concat_ws(":", split, *parts)), 1, 12))


def find_start(text: Column, needle: Column) -> Column:
    """Where the needle first stands; -1 if nowhere."""
    return F.instr(text, needle) - 1 if isinstance(needle, str) else F.call_function("instr", text, needle) - 1


def source_cased(text: Column, snippet: Column) -> Column:
    """The stretch of the text that equals the snippet but for case; null if there is none."""
    at = F.call_function("instr", F.lower(text), F.lower(strip(snippet)))
    return F.when((at > 0) & (strip(snippet) != ""), F.substring(text, at, F.length(strip(snippet))))


def aligned_phrase(text: Column, phrase: Column) -> Column:
    return F.coalesce(source_cased(text, phrase), strip(phrase))


def phrase_for_label(text: Column, label: Column) -> Column:
    return F.coalesce(source_cased(text, label), F.substring(strip(text), 1, 80))


def simple_sentences(text: Column) -> Column:
    """Runs up to a full stop, exclamation or question mark, stripped; empty ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]?"), F.lit(0)), strip), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9_']+"), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """(token, start, end) of each run between white space; null for a null text.

    In Arrow batches, one pass over each text: the built-in functions give no places of matches, and sums of the
    lengths before each of them take a number of steps that is quadratic in the tokens.
    """

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def tokens(texts: pa.Array) -> pa.Array:
        counts, found, starts, ends = [], [], [], []
        for t in texts.to_pylist():
            before = len(found)
            for m in re.finditer(r"\S+", t or ""):
                found.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
            counts.append(None if t is None else len(found) - before)
        return _lists(counts, [pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["token", "start", "end"])

    return tokens(text)


def _lists(counts: list[int | None], columns: list[pa.Array], names: list[str]) -> pa.Array:
    """Lists of so many structs each, of columns that hold those of all lists in a row; null for None."""
    offsets, total = [], 0
    for n in counts:
        offsets.append(None if n is None else total)
        total += n or 0
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.StructArray.from_arrays(columns, names))


def all_spans(text: Column, phrase: Column) -> Column:
    """(start, end) of all occurrences regardless of case, left to right, without overlaps."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array, phrases: pa.Array) -> pa.Array:
        counts, starts, ends = [], [], []
        for low, needle in zip(texts.to_pylist(), phrases.to_pylist()):
            n = 0
            at = low.find(needle) if low is not None and needle else -1
            while at >= 0:
                n += 1
                starts.append(at)
                ends.append(at + len(needle))
                at = low.find(needle, at + len(needle))
            counts.append(None if low is None or needle is None else n)
        return _lists(counts, [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])

    return spans(F.lower(text), F.lower(phrase))


def extract_json(text: Column) -> Column:
    """From the first opening to the last closing brace, else the whole text; '' for a blank one."""
    bare = strip(text)
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(is_missing(text), "").when(found != "", found).otherwise(bare)


def parse_json(c: Column) -> Column:
    """The JSON value of the whole text (variant); null where it is malformed or something follows the value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return let(wrapped, lambda w: F.when(F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant")))


def multi_hot(vocabulary: Column, labels: Column) -> Column:
    return F.transform(vocabulary, lambda v: F.array_contains(labels, v).cast("int"))


def padded(ids: Column, length: int, fill: int = -100) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def softmax(logits: Column) -> Column:
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    parts = F.struct(powers.alias("powers"), F.lit(0).alias("none"))
    summed = let(parts, lambda p: F.struct(p["powers"].alias("powers"), F.aggregate(p["powers"], F.lit(0.0), lambda a, b: a + b).alias("total")))
    return let(summed, lambda s: F.transform(s["powers"], lambda x: x / s["total"]))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def argmax(values: Column) -> Column:
    """The place of the largest value, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def truncated(c: Column, longest: int = 45) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def experiment_id(run_tag: Column, index: Column, registry_id: Column, stamp: Column) -> Column:
    return F.format_string("%s_%04d_%s_%s", run_tag, index, registry_id, stamp)


def decoder_prompt(text: Column, template: str, instructions: str = "") -> Column:
    """The template with the text in place of {raw_text}, and the instructions on a line of their own."""
    before, _, after = template.partition("{raw_text}")
    return F.concat(F.lit(before), text, F.lit(after + (f"\n{instructions}\n" if instructions else "")))


def valid_entity_text(c: Column, least: int = 3) -> Column:
    return (F.length(c) >= least) & c.rlike(r"[\p{L}\p{N}]") & ~c.rlike(r"^\p{Nd}+$")
