import pytest
from pyspark.sql import functions as F

from lumenry.functions.text import spaced_tokens
from lumenry.operators import align, bow, lexicon, metrics, normalize, predictions, spans, targets, tracker


def python_macro_f1(pairs):
    labels = {x for p in pairs for x in p}
    scores = []
    for c in labels:
        tp, fp, fn = (sum(t(g, p) for g, p in pairs) for t in (lambda g, p: g == p == c, lambda g, p: p == c != g, lambda g, p: g == c != p))
        scores.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
    return sum(scores) / len(scores) if scores else 0


@pytest.mark.parametrize("pairs", [[], [("a", "a")], [("a", "b"), ("b", "b"), ("c", "invalid")], [("a", "a"), ("a", "missing"), ("b", "a")]])
def test_macro_f1(spark, pairs):
    df = spark.createDataFrame(pairs, "g string, p string")
    assert metrics.macro_f1(df, "g", "p").first()[0] == pytest.approx(python_macro_f1(pairs))
    assert metrics.accuracy(df, "g", "p").first()[0] == pytest.approx(sum(a == b for a, b in pairs) / len(pairs) if pairs else 0)


def test_macro_f1_over_a_fixed_label_space(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "zzz")], "g string, p string")
    assert metrics.macro_f1_fixed(df, "g", "p", ["a", "b", "c"]).first()[0] == pytest.approx(1 / 3)


def test_set_scores(spark):
    df = spark.createDataFrame([([], []), (["x"], []), (["x", "y", "y"], ["y"])], "g array<string>, p array<string>")
    assert metrics.sample_set_f1(df, "g", "p").first()[0] == pytest.approx((1 + 0 + 2 / 3) / 3)
    assert metrics.micro_prf(df, "g", "p").first()["f1"] == pytest.approx(2 / 4)
    none = df.where("size(g) = 0")
    assert metrics.micro_prf(none, "g", "p").first()["f1"] == 0 and metrics.micro_prf(none, "g", "p", empty=1.0).first()["f1"] == 1


def test_token_f1(spark):
    df = spark.createDataFrame([(["A", "O", "B"], ["A", "B", "A"])], "g array<string>, p array<string>")
    assert metrics.token_f1(df, "g", "p").first()[0] == pytest.approx(2 / (2 + 2 + 1))
    assert metrics.token_f1(df.limit(0), "g", "p").first()[0] == 1


def test_composite(spark):
    row = spark.range(1).select(metrics.composite({"a": F.lit(0.5)}, {"a": 3, "b": 1}).alias("v")).first()
    assert row["v"] == pytest.approx(0.375)
    with pytest.raises(ValueError):
        metrics.composite({}, {"a": 0.0})


def test_alignment_keeps_references_and_takes_the_last(spark):
    refs = align.keyed(spark.createDataFrame([("a",), (" b ",), ("c",)], "example_id string"), "example_id").select("key")
    preds = align.keyed(spark.createDataFrame([("a", 1, "x"), (" a", 2, "y"), ("z", 3, "z"), (None, 4, "n"), (" ", 5, "n")], "example_id string, ord int, p string"), "example_id")
    last = align.last_by_key(preds, ["key"], [F.col("ord")])
    got = {r["key"]: (r["p"], r["matched"]) for r in align.aligned(refs, last).collect()}
    assert got == {"a": ("y", True), "b": (None, False), "c": (None, False)}
    assert align.alignment_counts(preds, refs).first().asDict() == {"prediction_rows": 5, "unkeyed": 2, "duplicates": 1, "matched": 1, "extra": 1}


def test_outer_labels(spark):
    a, b = spark.createDataFrame([("s", "x"), ("t", "y")], "k string, label string"), spark.createDataFrame([("s", "x"), ("u", "y")], "k string, label string")
    assert {tuple(r) for r in align.outer_labels(a, b, ["k"]).collect()} == {("s", "x", "x"), ("t", "y", "missing"), ("u", "missing", "y")}


def analysis(spark, payload, text="great help desk"):
    return normalize.with_analysis(spark.createDataFrame([(text, payload)], "t string, p string"), "t", "p").first()


FULL = '{"text_analysis":{"overall_sentiment":" Positive ","sentiment_score":0.9,"other":1,"main_themes":[{"theme":" Support ","theme_sentiment":"positive","theme_sentiment_score":0.8,"emotion":"joy","emotion_sentiment":"neutral","theme_associated_phrases":["help desk"," "]}],"sentence_sentiments":[],"metadata":[]}}'


def test_payload_of_the_present_shape(spark):
    r = analysis(spark, FULL)
    assert r["is_valid"] and r["analysis"]["overall_sentiment"] == "positive"
    theme = r["analysis"]["main_themes"][0]
    assert (theme["theme"], theme["theme_relevance_score"], theme["theme_associated_phrases"]) == ("Support", 1.0, ["help desk"])


def test_payload_of_older_shapes(spark):
    r = analysis(spark, '{"overall_sentiment":{"label":"negative","score":0.2},"themes":[{"theme":"Price"},{"theme":"Staff","sentiment":"neutral"}],"emotions":[{"emotion":"anger"},{"emotion":"joy","intensity":0.4}],"metadata_entities":[{"type":"Team","text":"desk","sentiment":"neutral"}],"sentence_sentiments":[{"start":0,"end":5,"sentiment":"neutral","score":0.5}]}')
    a = r["analysis"]
    assert (a["overall_sentiment"], a["sentiment_score"]) == ("negative", 0.2)
    assert [(t["theme"], t["emotion"], t["theme_sentiment"]) for t in a["main_themes"]] == [("Price", "anger", "negative"), ("Staff", "joy", "neutral")]
    assert a["main_themes"][1]["emotion_intensity_score"] == 0.4 and not r["is_valid"]  # themes without phrases
    assert a["metadata"][0]["metadata_type"] == "Team" and a["sentence_sentiments"][0]["sentence"] == "great"


@pytest.mark.parametrize("payload", [None, "", "not json", "[1,2]", '{"overall_sentiment":"positive"}', '{"overall_sentiment":"great"}', '{"overall_sentiment":"positive","sentiment_score":1.2}', '{"overall_sentiment":"positive","sentiment_score":"abc!"}x'])
def test_bad_payloads_are_marked(spark, payload):
    assert analysis(spark, payload)["is_valid"] is False


def test_phrase_offsets(spark):
    r = analysis(spark, '{"overall_sentiment":"positive","main_themes":[{"theme":"a","theme_associated_phrases":[{"start":6,"stop":10}]}]}')
    assert r["analysis"]["main_themes"][0]["theme_associated_phrases"] == ["help"]


def test_tag_labels(spark):
    df = spark.createDataFrame([('[{"start":5,"end":9,"type":"B"},{"start_char":0,"end_char":2,"entity_type":" A "},{"start":-1,"end":2,"type":"C"},{"start":3,"end":3,"type":"C"},{"start":1,"end":2,"type":" "}]',), ("nope",), (None,)], "l string")
    assert [[tuple(s) for s in r[0]] for r in df.select(normalize.tag_labels(F.col("l"))).collect()] == [[(0, 2, "A"), (5, 9, "B")], [], []]
    bad = spark.createDataFrame([('{"labels":[{"start":0,"end":2,"type":"A"},{"start":3,"end":1,"type":"A"}]}',)], "l string")
    assert bad.select(normalize.predicted_tags(F.col("l"))).first()[0] is None


def test_spans_and_tokens(spark):
    df = spark.createDataFrame([("ab cd ef", [(0, 5, "X"), (4, 8, "Y")])], f"t string, s {spans.SPANS}").withColumn("k", spaced_tokens(F.col("t")))
    assert df.select(spans.token_labels(F.col("k"), F.col("s"))).first()[0] == ["X", "X", "Y"]
    assert df.select(spans.bio_labels(F.col("k"), F.col("s"))).first()[0] == ["B-X", "I-X", "I-Y"]


def test_bio_decode(spark):
    rows = [(1, i, i, i + 1, label, c) for i, (label, c) in enumerate([("B-A", 0.9), ("I-A", 0.9), ("I-A", 0.5), ("I-A", 0.9), ("B-A", 0.9), ("I-B", 0.9), ("O", 1.0), (None, 0.9)])]
    df = spark.createDataFrame(rows, "key int, pos int, start int, end int, label string, confidence double")
    got = sorted((r["type"], r["start"], r["end"]) for r in spans.bio_decode(df, "key", "pos").collect())
    assert got == [("A", 0, 2), ("A", 3, 4), ("A", 4, 5), ("B", 5, 6)]


def test_greedy_folds(spark):
    df = spark.createDataFrame([([(0.9, 200, "a"), (0.8, 100, "b"), (0.7, 50, "c")],)], "e array<struct<confidence:double,size:int,name:string>>")
    assert [e["name"] for e in df.select(spans.greedy_budget(F.col("e"))).first()[0]] == ["a", "c"]
    df = spark.createDataFrame([([(4, 9, "a"), (0, 5, "b"), (9, 10, "c")],)], f"c {spans.SPANS}")
    assert [s["type"] for s in df.select(spans.greedy_nonoverlap(F.col("c"))).first()[0]] == ["a", "c"]


def test_naive_bayes(spark):
    train = spark.createDataFrame([("good good", "p"), ("bad", "n"), ("good", "p")], "text string, label string")
    model = bow.train(train, ["n", "p", "x"])
    docs = spark.createDataFrame([(1, "good day"), (2, "bad"), (3, ""), (4, None)], "id int, text string")
    assert {r["id"]: r["predicted"] for r in bow.predict(model, docs, "id").collect()} == {1: "p", 2: "n", 3: "p", 4: "p"}


def test_lexicon(spark):
    gold = spark.createDataFrame([("Help Desk", "T"), ("help desk ", "A"), ("desk", "X"), ("", "Y"), (None, "Y")], "phrase string, type string")
    lex = lexicon.train(gold)
    assert {r["phrase"]: r["type"] for r in lex.collect()} == {"help desk": "T", "desk": "X"}
    docs = spark.createDataFrame([(1, "The HELP desk, a desk."), (2, "none"), (3, None), (4, "Bigdesks")], "id int, text string")
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in lexicon.predict(docs, "id", lex).collect()}
    assert got == {1: [(4, 13, "T"), (17, 21, "X")], 2: [], 3: [], 4: [(3, 7, "X")]}


def log(spark, rows):
    return spark.createDataFrame([(i, f"e{i}", f"2026-01-0{i + 1}", f, m, "1.0", s) for i, (f, m, s) in enumerate(rows)], "seq int, experiment_id string, timestamp_utc string, model_family string, val_metric string, json_schema_compliance string, status string")


def test_tracker(spark):
    rows = log(spark, [("d", "0.5", "keep"), ("", "0.4", "discard"), ("d", "0.5", "Keep "), ("e", "nan", "crash"), ("e", "0.7", "keep")])
    assert [r["experiment_id"] for r in tracker.leaderboard(rows, 3).orderBy("rank").collect()] == ["e4", "e2", "e0"]
    assert {r["model_family"]: (r["best_experiment_id"], r["num_experiments"]) for r in tracker.by_family(rows).collect()} == {"d": ("e2", 2), "unknown": ("e1", 1), "e": ("e4", 2)}
    assert [r["decision"] for r in tracker.decisions(rows).orderBy("seq").collect()] == ["keep", "discard", "keep", "discard", "keep"]
    assert [r["best_so_far"] for r in tracker.running_best(rows).orderBy("seq").collect()] == [0.5, 0.5, 0.7]
    assert [round(r["delta"], 6) for r in tracker.improvements(rows).orderBy("seq").collect()] == [0.0, 0.2]
    assert tracker.summary(rows).first()["best_experiment_id"] == "e4" and tracker.summary(rows.limit(0)).first()["total_experiments"] == 0


def test_loss_trend(spark):
    losses = [1.0, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(losses)], "k string, i int, v double")
    r = tracker.loss_trend(df, "k", "i", "v", patience=2).first()
    ema = 0.0
    for x in losses:
        ema = 0.95 * ema + 0.05 * x
    assert r["ema"] == pytest.approx(ema) and r["best"] == 0.5 and r["stopped"]


def test_logs_and_long_series_need_no_single_task(spark):
    import random

    rng = random.Random(4)
    values = [rng.random() for _ in range(3000)]
    rows = log(spark, [("d", str(v), rng.choice(["keep", "discard"])) for v in values]).repartition(7)
    got = tracker.decisions(rows).orderBy("seq").collect()
    assert [r["best_before"] for r in got] == [max(values[:i], default=0.0) for i in range(3000)]
    kept = [float(r["val_metric"]) for r in rows.where("status = 'keep'").orderBy("seq").collect()]
    assert [r["best_so_far"] for r in tracker.running_best(rows).orderBy("seq").collect()] == [max(kept[: i + 1]) for i in range(len(kept))]
    assert [r["delta"] for r in tracker.improvements(rows).orderBy("seq").collect()] == [b - a for a, b in zip(kept, kept[1:])]
    for f in (tracker.decisions, tracker.running_best, tracker.improvements):
        plan = f(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert all("block#" in line for line in plan.splitlines() if "Window [" in line), plan
    df = spark.createDataFrame([(k, i, v + (2 - i / 2000 if k == "a" else 1)) for k in ("a", "b") for i, v in enumerate(values)] + [("c", 0, 1.0)], "k string, i int, v double")
    plan = tracker.loss_trend(df, "k", "i", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(at" not in plan and "RepartitionByExpression" in plan
    for patience in (20, 700, 5000):
        found = {r["k"]: r for r in tracker.loss_trend(df, "k", "i", "v", patience=patience).collect()}
        for k, own in {"a": [v + (2 - i / 2000) for i, v in enumerate(values)], "b": [v + 1 for v in values], "c": [1.0]}.items():
            ema, best, stale, stopped = 0.0, float("inf"), 0, False
            for x in own:
                ema, stale = 0.95 * ema + 0.05 * x, 0 if x < best - 5e-4 else stale + 1
                best, stopped = x if stale == 0 else best, stopped or stale >= patience
            r = found[k]
            assert (r["steps"], r["best"], r["stale"], r["stopped"]) == (len(own), best, stale, stopped) and r["ema"] == pytest.approx(ema)


def test_dataset_summary_takes_distinct_names_before_gathering(spark):
    theme = lambda t, e: (t, "positive", 0.5, 1.0, e, "positive", 1.0, ["x"])
    a = ("positive", 0.9, [theme("Price", "joy"), theme("Staff", "joy")], [], [("Team", "desk", "neutral", 0.1)])
    df = spark.createDataFrame([("train", a), ("train", a), ("val", ("positive", 0.9, [], [], []))], f"split string, analysis {normalize.ANALYSIS}")
    out = targets.dataset_summary(df)
    assert sorted(tuple(r) for r in out.collect()) == [("train", 2, ["Price", "Staff"], ["joy"], ["Team"]), ("val", 1, [], [], [])]
    assert "flatten" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_targets(spark):
    df = spark.createDataFrame([(["b", " a "],), (["c"],), ([],)], "l array<string>")
    assert targets.vocabulary(df, "l", ["z"]).first()[0] == ["a", "b", "c", "z"]
    assert sorted(r["hot"] for r in targets.with_multi_hot(df, "l").collect()) == [[0, 0, 0], [0, 0, 1], [1, 1, 0]]


def test_scores_of_analyses(spark):
    kind = f"id string, text string, gold {normalize.ANALYSIS}, predicted {normalize.ANALYSIS}"
    theme = lambda t, e: (t, "positive", 0.5, 1.0, e, "positive", 1.0, ["x"])
    gold = ("positive", 0.9, [theme("Price", "joy")], [("One.", "positive", 0.5)], [("Team", "desk", "neutral", 0.1)])
    rows = [("1", "One. the desk", gold, gold), ("2", "One. the desk", gold, None)]
    got = metrics.score_analyses(spark.createDataFrame(rows, kind)).first().asDict()
    assert got["overall_sentiment_macro_f1"] == pytest.approx((2 / 3 + 0) / 2) and got["sentence_sentiment_accuracy"] == 0.5
    assert (got["metadata_span_precision"], got["metadata_span_recall"], got["metadata_typed_f1"]) == pytest.approx((1.0, 0.5, 2 / 3))
    assert (got["theme_f1"], got["emotion_f1"], got["json_schema_compliance"]) == (0.5, 0.5, 0.5)
    want = sum(w * got[k] for k, w in metrics.ANALYSIS_WEIGHTS.items())
    assert got["val_metric"] == pytest.approx(want)


def test_assembled_predictions(spark):
    kind = f"text string, label string, score double, themes {normalize.ANALYSIS.split('main_themes:')[1].split(',sentence_sentiments')[0]}, metadata array<struct<metadata_type:string,metadata_name:string,metadata_sentiment:string,metadata_sentiment_score:double>>"
    rows = [("The Help Desk. Good!", "Fine", 1.7, [("Support", None, None, None, None, None, None, ["help desk"]), (" ", None, None, None, None, None, None, None)], [(None, "HELP", None, None), ("T", " ", None, None)])]
    p = predictions.assembled(spark.createDataFrame(rows, kind)).first()["prediction"]
    assert (p["overall_sentiment"], p["sentiment_score"], [s["sentence"] for s in p["sentence_sentiments"]]) == ("neutral", 1.0, ["The Help Desk.", "Good!"])
    assert [(t["theme"], t["emotion"], t["theme_associated_phrases"]) for t in p["main_themes"]] == [("Support", "neutral", ["Help Desk"])]
    assert [(m["metadata_type"], m["metadata_name"]) for m in p["metadata"]] == [("Entity", "Help")]


def test_chosen_probabilities(spark):
    df = spark.createDataFrame([([0.2, 0.6, 0.7],), ([0.1, 0.3, 0.3],), ([],)], "p array<double>")
    assert [r[0] for r in df.select(predictions.chosen(F.col("p"))).collect()] == [[1, 2], [1], []]
