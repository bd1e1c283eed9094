from lumenry.operators import normalize
from lumenry.plans import catalogue


def written(spark, folder, **tables):
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_vocabulary_holds_all_emotions_and_every_row(spark, tmp_path):
    rows = [(1, "Joy"), (1, "fury"), (2, " FURY "), (3, None), (4, " ")]
    d = written(spark, tmp_path, theme_annotation=(rows, "row_id bigint, emotion string"), canonical_label=([("joy",)], "label_name string"))
    got = {r["row_id"]: r["hot"] for r in catalogue.vocabulary_multi_hot(spark, d).collect()}
    assert got == {1: "[1, 1]", 2: "[1, 0]", 3: "[0, 0]", 4: "[0, 0]"}


def test_set_operations_keep_labels_of_any_signs(spark, tmp_path):
    rows = [("Follow-up 2", "joy"), ("配送", "配送"), ("n/a.", " "), ("Café", None)]
    d = written(spark, tmp_path, theme_annotation=(rows, "theme string, emotion string"))
    got = {tuple(r) for r in catalogue.set_operations(spark, d).collect()}
    only = {"follow-up 2", "n/a.", "café"}
    assert got == {("union", x) for x in only | {"配送", "joy"}} | {("both", "配送")} | {("theme only", x) for x in only}


def test_scores_compare_gold_analyses_with_predictions(spark, monkeypatch):
    theme = lambda t: (t, "positive", 0.5, 1.0, "joy", "positive", 1.0, ["x"])
    entity = lambda kind, name: (kind, name, "neutral", 0.1)
    gold = ("positive", 0.9, [theme("Price"), theme("Staff")], [], [entity("Team", "desk"), entity("Place", "Dunford")])
    part = ("positive", 0.9, [theme(" price ")], [], [entity("Team", "desk"), entity("Team", "slow")])
    rows = [("e", "1", "The desk in Dunford was slow", gold, part), ("e", "2", "The desk in Dunford", gold, None)]
    pairs = spark.createDataFrame(rows, f"experiment_id string, id string, text string, gold {normalize.ANALYSIS}, predicted {normalize.ANALYSIS}")
    monkeypatch.setattr(catalogue, "_analysis_pairs", lambda spark, d: pairs)
    assert catalogue.set_f1(spark, "").first()[0] == round((2 / 3 + 0) / 2, 6)
    assert tuple(catalogue.span_prf(spark, "").first()) == (0.5, 0.25, round(2 / 6, 6))
    # tokens: one of four gold labels is met, one label is too many
    assert catalogue.token_f1(spark, "").first()[0] == round(2 / (2 + 1 + 3), 6)


def test_alignment_counts_a_key_in_each_of_its_splits(spark, tmp_path):
    survey = [(1, "a", "train"), (2, " a", "val"), (3, "a", "val"), (4, "b", "val")]
    prediction = [("a", True, 1, 1)]
    d = written(spark, tmp_path, survey=(survey, "row_id bigint, example_id string, split string"), prediction=(prediction, "example_id string, is_valid_json boolean, written_at int, prediction_id int"))
    got = {r["split"]: (r["examples"], r["matched"], r["missing"], r["invalid"]) for r in catalogue.alignment_by_split(spark, d).collect()}
    assert got == {"train": (1, 1, 0, 0), "val": (2, 1, 1, 1)}
