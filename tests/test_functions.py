import hashlib

from pyspark.sql import functions as F

from lumenry.functions import text as fn


def value(spark, column, **cells):
    names = list(cells)
    kinds = ", ".join(f"{n} {'array<double>' if isinstance(v, list) else 'string'}" for n, v in cells.items())
    return spark.createDataFrame([tuple(cells[n] for n in names)], kinds).select(column.alias("v")).first()["v"]


def test_strip_knows_unicode_spaces(spark):
    assert value(spark, fn.strip(F.col("a")), a="　 x y \n") == "x y"


def test_missing(spark):
    assert [value(spark, fn.is_missing(F.col("a")), a=x) for x in (None, "", " \t", "x")] == [True, True, True, False]


def test_hash_split_equals_python(spark):
    ids = [f"sv-{i:09d}" for i in range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", fn.hash_split(F.col("id")).alias("s")).collect()
    for r in rows:
        b = int(hashlib.md5(r["id"].encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert r["s"] == ("test" if b < 0.1 else "val" if b < 0.2 else "train")


def test_named_splits(spark):
    names = {"train": "train", " Training ": "train", "VALID": "val", "dev": "val", "validation": "val", "Holdout": "test", "other": None}
    for name, want in names.items():
        assert value(spark, fn.split_or_hash(F.col("a"), F.lit("x")), a=name) == want
    assert value(spark, fn.split_or_hash(F.col("a"), F.lit("x")), a=" ") in ("train", "val", "test")


def test_spans_are_code_points(spark):
    assert value(spark, fn.find_start(F.col("a"), F.col("b")), a="a😀bc", b="bc") == 2
    spans = value(spark, fn.all_spans(F.col("a"), F.col("b")), a="Aa😀aA.aa", b="aa")
    assert [(s["start"], s["end"]) for s in spans] == [(0, 2), (3, 5), (6, 8)]
    assert value(spark, fn.all_spans(F.col("a"), F.col("b")), a="x.y(x.", b="x.") == [(0, 2), (4, 6)]
    assert value(spark, fn.all_spans(F.col("a"), F.col("b")), a="abc", b="") == []


def test_tokens_with_offsets(spark):
    tokens = value(spark, fn.spaced_tokens(F.col("a")), a="  ab 　c\nd😀 ")
    text = "  ab 　c\nd😀 "
    assert [(t["token"], t["start"], t["end"]) for t in tokens] == [("ab", 2, 4), ("c", 6, 7), ("d😀", 8, 10)]
    assert all(text[t["start"] : t["end"]] == t["token"] for t in tokens)


def test_extract_json(spark):
    got = [value(spark, fn.extract_json(F.col("a")), a=x) for x in ('so: {"a":{}} ok', " none ", "", None, "{x\ny}")]
    assert got == ['{"a":{}}', "none", "", "", "{x\ny}"]


def test_source_case(spark):
    assert value(spark, fn.source_cased(F.col("a"), F.col("b")), a="The Help Desk", b=" help desk ") == "Help Desk"
    assert value(spark, fn.aligned_phrase(F.col("a"), F.col("b")), a="The", b=" desk ") == "desk"


def test_softmax_and_argmax(spark):
    p = value(spark, fn.softmax(F.col("a")), a=[1.0, 3.0, 3.0])
    assert abs(sum(p) - 1) < 1e-9 and value(spark, fn.argmax(F.col("a")), a=[1.0, 3.0, 3.0]) == 1


def test_safe_float(spark):
    assert [value(spark, fn.safe_float(F.col("a")), a=x) for x in ("0.5", "x", None, "nan")] == [0.5, 0.0, 0.0, 0.0]
