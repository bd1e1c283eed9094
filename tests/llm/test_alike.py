import unicodedata

from pyspark.sql import functions as F

from lumenry.llm import alike


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("plain", F.lit("clash"))
    return {r["text"]: r["plain"] for r in alike.plain_forms(df.drop("plain"), ["id"], alike.count_signs(df)).collect()}


def test_all_composed_letters_have_one_form_however_they_are_typed(spark):
    composed = [c for c in map(chr, [*range(0xC0, 0x2000), *range(0x3040, 0x3100), *range(0xAC00, 0xD7A4, 37)]) if unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFC", c) == c]
    apart = [unicodedata.normalize("NFD", c) for c in composed]
    got = forms(spark, [*composed, *apart])
    assert len(composed) > 900
    assert [(c, got[c], got[a]) for c, a in zip(composed, apart) if got[c] != got[a]] == []


def test_marks_in_any_number_and_order_compose(spark):
    want = {"e\u0302\u0301": "\u1ebf", "\u00ea\u0301": "\u1ebf", "a\u0323\u0302": "\u1ead", "a\u0302\u0323": "\u1ead", "\uff83\uff9e": "\u30c7", "\u1112\u1161\u11ab": "\ud55c", "\ud558\u11ab": "\ud55c", "\u212b": "\u00c5"}
    assert forms(spark, list(want)) == want
    kept = ["\u0915\u093c\u093e", "\u0651\u064e", "\u0627\u0644\u0634\u0651\u064e\u0645\u0633", "\u0e17\u0e35\u0e48"]
    assert forms(spark, kept) == {t: t for t in kept}
