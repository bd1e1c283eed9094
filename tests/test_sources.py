import json

import pytest

from lumenry.plans import profiles
from lumenry.sources import readers, writers
from lumenry.streaming import live


def test_survey_csv(spark, tmp_path):
    payload = json.dumps({"overall_sentiment": "positive", "sentiment_score": 0.5})
    cell = '"' + payload.replace('"', '""') + '"'
    (tmp_path / "survey.csv").write_text(f'﻿id,text,analysis,other\na1," first\nline ",{cell},x\n,second,"not json",y\n', encoding="utf-8")
    rows = sorted(readers.read_survey(spark, str(tmp_path / "survey.csv")).collect(), key=lambda r: r["example_id"])
    assert [(r["example_id"], r["raw_text"], r["is_valid"]) for r in rows] == [("a1", "first\nline", True), ("example-000001", "second", False)]
    with pytest.raises(Exception, match="not valid"):
        readers.read_survey(spark, str(tmp_path / "survey.csv"), strict=True).collect()
    (tmp_path / "bad.csv").write_text("id,other\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_survey(spark, str(tmp_path / "bad.csv"))


def test_prediction_lines(spark, tmp_path):
    lines = ['{"example_id":"a","prediction":{"x":1}}', "", "not json", "[1,2]", '{"example_id":null,"prediction":null}', '{"example_id":"b","x":2}', '{"example_id":"c","prediction":{},"is_valid_json":false}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    rows = sorted(readers.read_predictions(spark, str(tmp_path / "p.jsonl")).collect(), key=lambda r: r["ordinal"])
    assert [(r["ordinal"], r["example_id"], r["is_valid_json"]) for r in rows] == [(0, "a", True), (2, None, False), (3, None, False), (4, None, False), (5, "b", True), (6, "c", False)]
    assert json.loads(rows[4]["payload"])["x"] == 2 and "line 3" in rows[1]["error"]


def test_log_round_trip(spark, tmp_path):
    record = {"experiment_id": "e", "model_registry_id": "m", "hf_model_name": "h", "model_family": "d", "val_metric": 0.123456789, "json_schema_compliance": 1, "status": "keep", "notes": "a\tb", "metrics": {"b": 1, "a": 2}}
    writers.append_log(spark, str(tmp_path / "log"), record)
    row = readers.read_log(spark, str(tmp_path / "log")).first()
    assert (row["val_metric"], row["notes"], row["metrics_json"]) == ("0.12345679", "a b", '{"a":2,"b":1}')
    with pytest.raises(ValueError):
        writers.log_row({"experiment_id": "e"})
    (tmp_path / "log.tsv").write_text("\t".join(readers.COLUMNS) + "\r\n" + "\t".join("x" for _ in readers.COLUMNS) + "\r\n")
    assert readers.read_log(spark, str(tmp_path / "log.tsv")).count() == 1 and readers.read_log(spark, str(tmp_path / "none.tsv")).count() == 0
    (tmp_path / "other.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        readers.read_log(spark, str(tmp_path / "other.tsv"))


def test_config(tmp_path):
    good = {"task_kind": "classification", "input_fields": ["t"], "target_field": "y", "label_space": ["a", "b"], "metrics": ["macro_f1", "accuracy"], "val_metric": {"macro_f1": 3, "accuracy": 1}}
    (tmp_path / "x.config.json").write_text(json.dumps(good))
    assert readers.load_config(str(tmp_path / "x.csv")).weights == {"macro_f1": 0.75, "accuracy": 0.25}
    for change in ({"label_space": ["a"]}, {"metrics": ["other"]}, {"val_metric": {"macro_f1": -1}}, {"val_metric": {}}):
        (tmp_path / "x.config.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError):
            readers.load_config(str(tmp_path / "x.csv"))


def test_tagging_and_generic_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('split,raw_text,labels\nTrain , hello you,"[{""start"":0,""end"":5,""type"":""G""}]"\n')
    row = readers.read_tagging(spark, str(tmp_path / "t.csv")).first()
    assert row["split"] == "train" and row["example_id"].startswith("tag-train-") and [tuple(x) for x in row["labels"]] == [(0, 5, "G")]
    (tmp_path / "g.csv").write_text("split,a,b,y\ntrain,one,two,p\n")
    config = readers.GenericConfig(("a", "b"), "y", ("p", "n"))
    assert readers.read_generic(spark, str(tmp_path / "g.csv"), config).first()["text"] == "one two"
    (tmp_path / "g.csv").write_text("split,a,b,y\ntrain,one,two,zzz\n")
    with pytest.raises(Exception, match="bad row"):
        readers.read_generic(spark, str(tmp_path / "g.csv"), config).collect()


def test_dataset_path(tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.resolve_dataset(folder=str(tmp_path))
    (tmp_path / "only.csv").write_text("a\n")
    assert readers.resolve_dataset(folder=str(tmp_path)).endswith("only.csv")


def test_key_values(spark):
    df = spark.createDataFrame([(0, "a: 1"), (1, "no colon"), (2, "a: x:2")], "ordinal int, value string")
    assert [tuple(r) for r in readers.key_values(df).collect()] == [("a", "x:2")]


def test_experiment_loop(spark, tmp_path):
    rows = [(str(i), "train" if i < 8 else "val", "good one" if i % 2 else "bad one", "p" if i % 2 else "n") for i in range(12)]
    spark.createDataFrame(rows, "example_id string, split string, text string, label string").write.parquet(str(tmp_path / "d"))
    profile = profiles.classification_profile(["n", "p"])
    specs = [profiles.ModelSpec("a", "decoder"), profiles.ModelSpec("b", "encoder")]
    records = profiles.run_experiments(spark, profile, str(tmp_path / "d"), specs, 2, "t")
    assert [r["status"] for r in records] == ["keep", "keep"] and records[0]["val_metric"] == 1.0
    assert profiles.run_experiments(spark, profile, str(tmp_path / "nothing"), specs, 1, "t")[0]["status"] == "crash"
    assert profiles.run_experiments(spark, profile, "", specs, 1, "t", dry_run=True)[0]["status"] == "dry_run"
    with pytest.raises(KeyError):
        profiles.get_profile(profiles.registry(profile), "x")
    with pytest.raises(ValueError):
        profiles.validate_registry([specs[0], specs[0]])


def test_tagging_cycle(spark):
    rows = [("1", "train", "the help desk", [(4, 13, "T")]), ("2", "val", "a Help Desk here", [(2, 11, "T")])]
    df = spark.createDataFrame(rows, "example_id string, split string, text string, labels array<struct<start:int,end:int,type:string>>")
    profile = profiles.tagging_profile()
    val = df.where("split = 'val'")
    scores = profile.evaluate(val, profile.predict(profile.train(df.where("split = 'train'")), val)).first()
    assert [scores[c] for c in ("typed_f1", "span_f1", "token_f1", "val_metric")] == pytest.approx([1.0] * 4)


def test_preflight(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), (" ", "train"), ("b", "val")], "example_id string, split string")
    got = {r["split"]: (r["missing_ids"], r["duplicate_ids"], r["ok"]) for r in profiles.preflight(df).collect()}
    assert got == {"train": (1, 1, False), "val": (0, 0, True)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"experiment_id":"e1","model_family":"d","status":"completed","val_metric":"0.5"}\n{"experiment_id":"e2","model_family":"d","status":"crash","val_metric":"0.9"}\nbroken\n')
    q = live.best_by_family(live.state_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("best").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("best").collect()] == [("d", 0.5, "e1", 1)]
