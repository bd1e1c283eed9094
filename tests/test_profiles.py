import json

import pytest
from pyspark.sql import functions as F

from lumenry.operators import align, bow, lexicon, metrics, predictions, spans, tracker
from lumenry.plans import profiles
from lumenry.sources import readers, tables, writers

RECORD = {"experiment_id": "e1", "model_registry_id": "m", "hf_model_name": "h", "model_family": "decoder", "val_metric": 0.5, "json_schema_compliance": 1}


def payload(label, **more):
    return json.dumps({"text_analysis": {"overall_sentiment": label, "sentiment_score": 0.5, **more}})


def survey_csv(path, rows):
    cell = lambda x: '"' + x.replace('"', '""') + '"'
    path.write_text("example_id,split,raw_text,response_text\n" + "\n".join(",".join(map(cell, r)) for r in rows), encoding="utf-8")
    return str(path)


def test_an_analysis_file_is_evaluated_against_its_split(spark, tmp_path):
    data = survey_csv(tmp_path / "s.csv", [("a", "val", "Fine.", payload("positive")), ("b", "val", "Bad.", payload("negative")), ("c", "val", "So so.", payload("neutral")), ("d", "train", "x", payload("negative"))])
    lines = [{"example_id": "a", "prediction": json.loads(payload("negative"))}, {"example_id": " a ", "prediction": json.loads(payload("positive"))}, {"example_id": "b", "prediction": json.loads(payload("negative")), "is_valid_json": False}, {"example_id": None, "prediction": {}}, {"example_id": "z", "prediction": {}}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    profile = profiles.analysis_profile()
    scores, counts = profiles.evaluate_file(spark, profile, str(tmp_path / "p.jsonl"), "val", data)
    assert counts == {"prediction_rows": 5, "unkeyed": 1, "duplicates": 1, "matched": 2, "extra": 1, "examples": 3, "missing": 1, "invalid": 2}
    assert scores["json_schema_compliance"] == pytest.approx(1 / 3) and scores["overall_sentiment_macro_f1"] == pytest.approx(1 / 4)
    for split in ("test", "other"):
        with pytest.raises(ValueError):
            profiles.evaluate_file(spark, profile, str(tmp_path / "p.jsonl"), split, data)


def test_predictions_go_to_a_file_and_back(spark, tmp_path):
    (tmp_path / "t.csv").write_text('example_id,split,raw_text,labels\n1,train,the help desk,"[{""start"":4,""end"":13,""type"":""T""}]"\n2,val,a Help Desk here,"[{""start"":2,""end"":11,""type"":""T""}]"\n')
    config = {"input_fields": ["t"], "target_field": "y", "label_space": ["a", "b"], "val_metric": {"accuracy": 1}, "metrics": ["accuracy"]}
    (tmp_path / "g.config.json").write_text(json.dumps(config))
    (tmp_path / "g.csv").write_text("example_id,split,t,y\n1,train,good,a\n2,train,bad,b\n3,val,good,a\n4,val,bad,b\n")
    data = survey_csv(tmp_path / "s.csv", [("a", "val", "Fine.", payload("positive")), ("b", "train", "Good.", payload("positive"))])
    for profile, path in ((profiles.tagging_profile(), tmp_path / "t.csv"), (profiles.config_profile(str(tmp_path / "g.csv")), tmp_path / "g.csv"), (profiles.analysis_profile(), data)):
        context = profiles.task_context(profile.profile_id, "val", "run", "e", str(path), str(tmp_path))
        target = profiles.predict_to_file(spark, profile, context, "family", str(tmp_path))
        scores, counts = profiles.evaluate_file(spark, profile, target, "val", str(path))
        assert counts["missing"] == counts["invalid"] == 0 and scores["json_schema_compliance"] == 1.0, profile.profile_id
        assert scores.get("accuracy", 1.0) == scores.get("typed_f1", 1.0) == scores.get("overall_sentiment_macro_f1", 1.0) == 1.0


def test_the_last_prediction_of_an_id_counts(spark):
    examples = spark.createDataFrame([("1", "a"), ("2", "b")], "example_id string, label string")
    given = spark.createDataFrame([(0, "1", "b", True), (1, "1", "a", True), (2, "2", "b", True), (3, "2", "b", False)], "ordinal int, example_id string, predicted string, is_valid_json boolean")
    r = profiles.score_labels(examples, given, ["a", "b"], {"accuracy": 1.0}).first()
    assert (r["accuracy"], r["json_schema_compliance"]) == (0.5, 0.5)
    spans_ = "array<struct<start:int,end:int,type:string>>"
    gold = spark.createDataFrame([("1", "ab cd", [(0, 2, "X")])], f"example_id string, text string, labels {spans_}")
    twice = spark.createDataFrame([(0, "1", [(3, 5, "X")]), (1, "1", [(0, 2, "X")])], f"ordinal int, example_id string, spans {spans_}")
    assert profiles.score_spans(gold, twice).first()["typed_f1"] == 1.0
    bad = twice.withColumn("spans", F.when(F.col("ordinal") == 0, F.col("spans")))
    assert [profiles.score_spans(gold, bad).first()[c] for c in ("typed_f1", "json_schema_compliance")] == [0.0, 0.0]


def test_validation_report(spark, tmp_path):
    data = survey_csv(tmp_path / "s.csv", [("a", "val", "Fine.", payload("positive")), ("a", "val", "Fine.", payload("positive"))])
    profile = profiles.analysis_profile()
    report = profiles.validated(spark, profile, " VAL ", data)
    assert not report.ok and report.errors == ("repeated ids: 1",) and report.warnings == ("the train split is empty",)
    assert "summary_split_examples: 2" in profiles.formatted(report) and "error: repeated ids: 1" in profiles.formatted(report)
    assert profiles.validated(spark, profile, "test", data).errors == ("no examples in split test",)
    assert profiles.validated(spark, profile, "other", data).errors[0].startswith("unknown split")
    assert profiles.validated(spark, profile, "val", str(tmp_path / "none.csv")).errors[0].startswith("no such file")
    (tmp_path / "bad.csv").write_text("x\n1\n")
    assert profiles.validated(spark, profile, "val", str(tmp_path / "bad.csv")).errors[0].startswith("loading failed")
    assert profiles.default_path("tagging", None, str(tmp_path)) is None and profiles.default_path("x", "p") == "p"
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "generic_task.csv").write_text("a\n")
    assert profiles.default_path("generic", None, str(tmp_path)).endswith("generic_task.csv")
    assert "raw_text" in profiles.dataset_contract()["aliases"]


def test_log_is_appended_read_and_ranked(spark, tmp_path):
    path, board = str(tmp_path / "log"), str(tmp_path / "board")
    assert readers.read_log(spark, path).count() == 0 and readers.best_metric(readers.read_log(spark, path)) == 0.0 and readers.read_leaderboard(spark, board) == {}
    for i, m in enumerate((0.5, 0.75, 0.25)):
        writers.append_log(spark, path, RECORD | {"experiment_id": f"e{i}", "val_metric": m, "notes": 'a\t"b"\nc', "metrics": {"x": m}, "config": {"lr": "1"}}, board)
    log = readers.read_log(spark, path)
    assert [r["experiment_id"] for r in log.orderBy("seq").collect()] == ["e0", "e1", "e2"] and log.first()["notes"] == 'a "b"\nc'
    assert readers.best_metric(log) == 0.75
    found = readers.read_leaderboard(spark, board)
    assert [x["experiment_id"] for x in found["leaders"]] == ["e1", "e0", "e2"] and found["by_family"]["decoder"]["num_experiments"] == 3 and found["total_experiments"] == 3
    assert [r["metrics"] for r in readers.with_parsed(log).orderBy("seq").collect()] == [{"x": 0.5}, {"x": 0.75}, {"x": 0.25}]
    broken = spark.createDataFrame([("[]", ""), ("{", None), ('{"a":1}', '{"b":"c"}')], "metrics_json string, config_json string")
    assert [tuple(r) for r in readers.with_parsed(broken).select("metrics", "config").collect()] == [({}, {}), ({}, {}), ({"a": 1.0}, {"b": "c"})]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        writers.append_log(spark, str(tmp_path / "other"), RECORD)


def test_records_take_defaults_and_need_their_fields():
    assert writers.record_of(RECORD)["status"] == "completed" and writers.record_of(RECORD | {"run_tag": "r"})["run_tag"] == "r"
    with pytest.raises(ValueError, match="json_schema_compliance"):
        writers.record_of({k: v for k, v in RECORD.items() if k != "json_schema_compliance"})


def test_nulls_stay_in_prediction_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", None, False)], "example_id string, prediction struct<label:string>, is_valid_json boolean")
    writers.write_predictions(df, str(tmp_path / "p"))
    r = readers.read_predictions(spark, str(tmp_path / "p")).first()
    assert (r["example_id"], r["payload"], r["is_valid_json"]) == ("a", None, False)


def test_models_are_stored_and_loaded(spark, tmp_path):
    model = bow.train(spark.createDataFrame([("good", "p"), ("bad", "n")], "text string, label string"), ["n", "p"])
    bow.save(model, str(tmp_path / "bow"))
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")
    assert {r["id"]: r["predicted"] for r in bow.predict(bow.load(spark, str(tmp_path / "bow")), docs, "id").collect()} == {1: "p", 2: "n"}
    lex = lexicon.train(spark.createDataFrame([("Desk", "T")], "phrase string, type string"))
    lexicon.save(lex, str(tmp_path / "lex"))
    assert [tuple(r) for r in lexicon.load(spark, str(tmp_path / "lex")).collect()] == [("desk", "T")]
    assert lexicon.load(spark, str(tmp_path / "none")).count() == lexicon.load(spark, None).count() == 0
    seen = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, None)], "at int, type string")
    assert tuple(lexicon.top_label(seen, "at").first()) == ("b", 2)


def test_both_ways_of_the_lexicon_agree(spark, monkeypatch):
    import random

    rng = random.Random(6)
    parts = ["ab", "abc", "bca", "a", "cab ", "b", "é", "長い"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(parts).upper() for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(99, None)], "id int, text string")
    lex = spark.createDataFrame([("ab", "1"), ("abcab", "2"), ("a", "3"), ("bca", "4"), ("cc", "5"), ("長", "6")], "phrase string, type string")
    as_set = lambda df: {(r["id"], tuple(tuple(s) for s in r["spans"])) for r in df.collect()}
    by_automaton = as_set(lexicon.predict(docs, "id", lex))
    monkeypatch.setattr(lexicon, "HELD", 3)
    assert as_set(lexicon.predict(docs, "id", lex)) == by_automaton and len(by_automaton) == 61
    assert as_set(lexicon.predict(docs, "id", lex.limit(0))) == {(i, ()) for i in [*range(60), 99]}


def test_budget_takes_the_best_of_equal_names(spark):
    kind = "array<struct<confidence:double,size:int,name:string,type:string>>"
    df = spark.createDataFrame([([(0.5, 4, "Desk", "T"), (0.9, 4, " desk", "t "), (0.9, 6, "Office", "T"), (0.9, 4, "DESK", "T"), (0.1, 3, "new", "A")],), ([],)], f"e {kind}")
    got = [[(e["name"], e["confidence"]) for e in r[0]] for r in df.select(spans.best_by_name(F.col("e"))).collect()]
    assert got == [[("Office", 0.9), (" desk", 0.9), ("new", 0.1)], []]
    assert [[e["name"] for e in r[0]] for r in df.select(spans.greedy_budget(F.col("e"), 3, 9)).collect()] == [["Desk", " desk"], []]


def test_only_what_is_invalid_is_asked_for_again(spark):
    examples = spark.createDataFrame([(str(i), "text") for i in range(4)], "example_id string, raw_text string")
    asked = []

    def attempt(left, number):
        asked.append(left.count())
        good = F.col("example_id").cast("int") <= number
        return left.select("example_id", F.when(good, F.lit(payload("positive"))).otherwise("broken").alias("payload"))

    got = {r["example_id"]: (r["is_valid_json"], r["validation_error"] is None) for r in profiles.retried(attempt, examples, 3).collect()}
    assert asked == [4, 3, 2] and got == {"0": (True, True), "1": (True, True), "2": (True, True), "3": (False, False)}


def test_registry_rows(spark):
    specs = [profiles.ModelSpec("a", "decoder", {"batch_size": 2}), profiles.ModelSpec("b", "encoder")]
    rows = {r["registry_id"]: r["defaults"] for r in profiles.registry_rows(spark, specs, {"decoder": {"batch_size": 4, "lr": 0.1}}).collect()}
    assert rows == {"a": {"batch_size": "2", "lr": "0.1"}, "b": {}}
    with pytest.raises(ValueError, match="other"):
        profiles.validate_registry(specs, ("decoder", "other"))


def test_training_envelope(spark):
    kind = "s array<struct<sentence:string>>, label string, score double, m array<string>, t array<string>"
    r = spark.createDataFrame([([("A.",), ("B.",)], "positive", 1.5, ["m"], [])], kind).select(predictions.training_envelope(*map(F.col, ("s", "label", "score", "m", "t"))).alias("p")).first()["p"]["text_analysis"]
    assert [tuple(s) for s in r["sentence_sentiments"]] == [("A.", "positive", 1.0), ("B.", "positive", 1.0)] and r["sentiment_score"] == 1.0


def test_steps_within_the_time_budget(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([100.0, 3.0, 3.0, 3.0, 3.0])], "k string, i int, seconds double")
    assert [r["i"] for r in tracker.within_budget(rows, "k", "i", "seconds", 6.0).orderBy("i").collect()] == [0, 1, 2]


def test_label_scores_equal_the_single_metrics(spark):
    pairs = spark.createDataFrame([("x", g, p, v) for g, p, v in [("a", "a", True), ("a", "b", True), ("b", "invalid", False), ("c", "c", True)]] + [("y", "a", "a", True)], "e string, g string, p string, v boolean")
    got = {r["e"]: r.asDict() for r in metrics.label_scores(pairs, "g", "p", "v", ["e"]).collect()}
    for f, name in ((metrics.macro_f1(pairs, "g", "p", ["e"]), "macro_f1"), (metrics.accuracy(pairs, "g", "p", ["e"]), "accuracy"), (metrics.compliance(pairs, "v", ["e"]), "json_schema_compliance")):
        for r in f.collect():
            assert got[r["e"]][name] == pytest.approx(r[name])


def test_cut_tables_are_dropped(spark):
    import os

    kept = tables.cut_lineage(spark.range(3))
    path = tables._CUTS[-1][1]
    assert kept.count() == 3 and os.path.exists(path)
    tables._CUTS, rest = tables._CUTS[-1:], tables._CUTS[:-1]
    tables.drop_cuts()
    tables._CUTS += rest
    assert not os.path.exists(path)


def test_unique_last_without_an_order_takes_the_last_row(spark):
    rows = align.keyed(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "id string, v int").coalesce(1), "id")
    assert [r["v"] for r in align.unique_last(rows).collect()] == [2]


def test_a_large_lexicon_meets_only_texts_that_hold_its_phrases(spark, monkeypatch):
    import random

    rng = random.Random(8)
    stem = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    # Many phrases share each beginning of four signs, so a text that holds a beginning holds few of its phrases.
    phrases = sorted({rng.choice(["norv", "casm", "wexm"]) + stem(rng.randint(1, 20)) for _ in range(3000)} | {"a 長い", "é", "norv"})
    lex = spark.createDataFrame([(p, str(i % 5)) for i, p in enumerate(phrases)], "phrase string, type string")
    texts = [" ".join([rng.choice(["norv", "casm", "wexm"]) + stem(25), *(rng.choice(phrases).upper() for _ in range(5)), "x" * i]) for i in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (200, ""), (201, None)], "id int, text string")
    as_set = lambda df: {(r["id"], tuple(tuple(s) for s in r["spans"])) for r in df.collect()}
    want = as_set(lexicon.predict(docs, "id", lex))
    monkeypatch.setattr(lexicon, "HELD", 3)

    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    assert as_set(lexicon.predict(docs, "id", lex)) == want and len(want) == 202
    assert shuffled() - before < 30_000
    monkeypatch.setattr(lexicon, "PIECE", 50)  # texts in pieces give the same, and so does a filter that all passes
    monkeypatch.setattr(lexicon, "BITS", 1)
    assert as_set(lexicon.predict(docs, "id", lex)) == want
