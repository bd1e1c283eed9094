import os
import random

import pytest
from pyspark.sql import functions as F

from lumenry.llm import alike, canonical, copies, encoding, garbled, languages, overlap, packing, personal, sentences

LABELS = [(1, "theme", "Delivery time", ["Shipping speed"]), (2, "theme", "Billing", None), (3, "emotion", "joy", [])]
LABEL_KIND = "label_id bigint, field_name string, label_name string, also_known array<string>"


def mapped(spark, values, labels=LABELS):
    df = spark.createDataFrame([("theme", v) for v in values], "field_name string, value string")
    return {r["value"]: r["label_id"] for r in canonical.map_values(df, spark.createDataFrame(labels, LABEL_KIND)).collect()}


def test_canonical_values(spark):
    want = {"delivery  TIME": 1, "Speed Shipping": 1, "Dеlivеry time": 1, "De​livery_time": 1, "1. Dlivrey time!!": 1, "ｂｉｌｌｉｎｇ": 2, "B1ll1ng": 2, "my billing": 2, "Lottery": 0, "???": 0, "": 0, "x" * 5000: 0}
    assert mapped(spark, [*want, None, "Billing"]) == want | {"Billing": 2}


def test_canonical_values_without_a_list(spark):
    assert mapped(spark, ["a"], []) == {"a": 0}
    assert mapped(spark, []) == {}


def test_pigeonhole_join_equals_brute_force(spark):
    rng = random.Random(3)
    names = ["delivery", "customer support", "packaging", "warranty terms", "joy", "fear"]
    labels = [(i, "theme", n, []) for i, n in enumerate(names, 1)]
    typed = []
    for n in names:
        for _ in range(40):
            s = list(n.replace(" ", ""))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "e"])
            typed.append("".join(s))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    def best(v):
        hits = []
        for i, n in enumerate(names, 1):
            b = n.replace(" ", "")
            d = distance(v, b)
            if d <= (1 if len(b) <= 4 else 2 if len(b) <= 7 else 3):
                hits.append((d, i))
        return min(hits)[1] if hits else 0

    assert mapped(spark, typed, labels) == {v: best(v) for v in typed}


@pytest.fixture(scope="module")
def sentence_model(spark):
    texts = ["The desk was slow.\nWe waited for two hours!", "They came at 5 p.m. on Monday. We left early.", "See No. 4 of the list. The end was good.", "We met St. Brim today.\nThe desk was closed."] * 30
    return sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_sentences(spark, sentence_model):
    cut = lambda t: [t[a:b] for a, b in sentences.split(t, sentence_model)]
    assert cut(" We left early. The desk was slow!\n- an item\n\n") == ["We left early.", "The desk was slow!", "- an item"]
    assert cut('He said "Why now? We close." and left.') == ['He said "Why now? We close." and left.']
    assert cut("It is 4.5 of v2.1.0 at shop.example.org now.") == ["It is 4.5 of v2.1.0 at shop.example.org now."]
    assert cut("買った。「明日。」と言う。次は？") == ["買った。", "「明日。」と言う。", "次は？"]
    assert cut("") == cut(" \n ") == []
    assert len(cut("The desk was slow. " * 3000)) == 3000
    df = spark.createDataFrame([(1, None), (1, "A b. We left."), (2, "")], "id int, text string").withColumn("start_char", F.lit("x"))
    assert [tuple(r) for r in sentences.sentence_units(df, ["id"], sentence_model).collect()] == [(1, 0, 0, 4), (1, 1, 5, 13)]
    empty = sentences.train(df.limit(0))
    assert sentences.sentence_units(df.limit(0), ["id"], empty).count() == 0


def test_posteriors_equal_enumeration(sentence_model):
    line = "We met St. Brim. We left at 5 p.m. The desk was slow. A. B. See it."
    between = sentences.gaps(line, True)
    got = sentences.posteriors(between, sentence_model)
    import itertools
    import math

    weights = [0.0] * len(between)
    total = 0.0
    for events in itertools.product((0, 1), repeat=len(between)):
        s = sum(sentence_model.odds(*left, stop, *right) for e, (_, _, left, stop, right) in zip(events, between) if e)
        s += sum(sentence_model.short for i in range(len(between) - 1) if events[i] and events[i + 1] and between[i + 1][0] - between[i][1] < 4)
        w = math.exp(s)
        total += w
        weights = [x + w * e for x, e in zip(weights, events)]
    assert got == pytest.approx([w / total for w in weights], abs=1e-9)


PII = [
    ("Write to ann.b+c@mail.example.org, or ann at post dot example dot org.", [("email", "ann.b+c@mail.example.org"), ("email", "ann at post dot example dot org")]),
    ("Please call me back on +44 (20) 7946-0123 ext. 7, order 2025-936-6432.", [("phone", "+44 (20) 7946-0123 ext. 7")]),
    ("My name is Ann Lee-Gray and order 2024-111-2222 is late.", [("person_name", "Ann Lee-Gray")]),
    ("Send it to Flat 2, 14 Old Mill Lane, Dunford please.", [("street_address", "Flat 2, 14 Old Mill Lane, Dunford")]),
    ("ID on file: 903-36-0887, but", [("id_number", "903-36-0887")]),
    ("担当は山田太郎さんです。", [("person_name", "山田太郎")]),
    ("Ask for Mrs. A​nn Lee, tel. ５５５ 0１23 456", [("person_name", "A​nn Lee"), ("phone", "５５５ 0１23 456")]),
    ("See shop.example.org, order 4711/B, in Dunford at 5 p.m.", []),
]


@pytest.mark.parametrize("text,want", PII)
def test_personal_data(text, want):
    found = personal.Finder().find(text)
    assert [(k, text[a:b]) for a, b, k in found] == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "Mail a.b@c.example now"), (1, None), (2, ""), (3, "x" * 100000)], "id int, text string")
    got = [(r["id"], len(r["pieces"]), r["redacted"]) for r in personal.personal_data(df, "id").collect()]
    assert sorted(got, key=str)[:3] == sorted([(1, 1, "Mail [EMAIL] now"), (1, 0, None), (2, 0, "")], key=str) and len(got) == 4


def test_look_alikes(spark):
    same = ["日本（東京）、　次", "naïve “quote” — dash\t\n", "👩‍💻 ❤️", "Это русский текст и IT-отдел", "n.º 5", ""]
    changed = {"no break": "no break", "café": "café", "ｗｉｄｅ １２": "wide 12", "pаyраl": "paypal", "soft­hyphen": "softhyphen", "a　b": "a b", "Oжидaниe": "Ожидание", "x​y": "xy", "です": "です"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*same, *changed, None])], "id int, text string")
    signs = alike.count_signs(df.where("text is not null"))
    got = {r["text"]: (r["plain"], r["disguised"]) for r in alike.plain_forms(df, ["id"], signs).collect()}
    assert got == {t: (t, False) for t in same} | {t: (p, True) for t, p in changed.items()} | {None: (None, False)}
    assert alike.plain_forms(df.limit(0), ["id"], signs).count() == 0


def test_union_find_is_transitive():
    classes = alike.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        classes.union(a, b)
    assert sorted(sorted(m) for m in classes.members()) == [["a", "b", "c", "d"], ["x", "y"]]


def words(rng, n):
    return [rng.choice(["alpha", "bravo", "cedar", "delta", "ember", "flint", "grove", "heath", "inlet", "jetty", "knoll", "larch"]) + str(rng.randrange(50)) for _ in range(n)]


def test_cross_split_overlap(spark):
    rng = random.Random(1)
    base = [words(rng, 60) for _ in range(30)]
    rows, want = [], set()
    for i, w in enumerate(base):
        rows.append((i, " ".join(w), "train"))
    for i, w in enumerate(base[:10]):
        edited = list(w)
        for k in rng.sample(range(60), 4):
            edited[k] = "changed"
        rows += [(100 + i, " ".join(edited), "val"), (200 + i, "  ".join(w).upper() + "!", "test")]
        want |= {(i, 100 + i), (i, 200 + i)}
    rows += [(300, " ".join(base[11][:12] + words(rng, 48)), "val"), (301, None, "val"), (302, " ", "test"), (303, "short text", "train"), (304, "Short text.", "val"), (305, base[3][0], "other")]
    rows += [(400 + i, " ".join(base[20]), "train") for i in range(5)] + [(410, " ".join(base[20]), "val")]
    want |= {(303, 304), (20, 410)} | {(400 + i, 410) for i in range(5)}
    df = spark.createDataFrame(rows, "id bigint, text string, split string")
    kind = F.when(F.col("split").isin("train", "val", "test"), F.col("split"))
    assert {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "id", "text", kind).collect()} == want
    assert overlap.overlaps(df.limit(0), "id", "text", kind).count() == 0


def test_overlap_is_compared_on_all_5_grams(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(40)}" for _ in range(50)] for _ in range(40)]
    rows = [(i, " ".join(w), "train") for i, w in enumerate(base)]
    for i, w in enumerate(base[:20]):
        edited = list(w)
        for k in (8, 17, 26, 35):  # misspelt words are the rarest, and spoil twenty 5-grams
            edited[k] = f"odd{i}x{k}"
        rows.append((100 + i, " ".join(edited), "val"))
        rows.append((200 + i, " ".join([f"new{i}x{k}" for k in range(25)] + w), "test"))  # moved by half its length
    short = ["we waited six days for this", "the desk was closed again on monday morning", "nobody answered"]
    rows += [(300 + i, t, "train") for i, t in enumerate(short)]
    rows += [(310, "we waited six dyas for this", "val"), (311, "the desk was closed on monday morning", "val"), (312, "nobody answerd", "val")]
    df = spark.createDataFrame(rows, "id bigint, text string, split string")
    want = {(i, 100 + i) for i in range(20)} | {(i, 200 + i) for i in range(20)} | {(300, 310), (301, 311)}
    assert {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(df, "id", "text", F.col("split")).collect()} == want


def test_language_stretches(spark, sentence_model):
    seen = {
        "en": ["The order was late and the staff were kind to us.", "We waited for the help desk through the whole week.", "This is what they said when we asked about the price."],
        "de": ["Die Bestellung kam zu spät und das Personal war nett.", "Wir haben die ganze Woche auf den Kundendienst gewartet.", "Das ist es, was sie über den Preis gesagt haben."],
        "fr": ["La commande est arrivée en retard et le personnel était gentil.", "Nous avons attendu toute la semaine le service.", "C'est ce qu'ils ont dit quand nous avons demandé le prix."],
        "es": ["El pedido llegó tarde y el personal fue amable con nosotros.", "Esperamos toda la semana la línea de ayuda.", "Esto es lo que dijeron cuando preguntamos por el precio."],
        "pt": ["A encomenda chegou tarde e os funcionários foram simpáticos.", "Esperámos toda a semana pela linha de apoio.", "Foi isto que disseram quando perguntámos pelo preço."],
    }
    rows = [(i, t + " " + t2, code) for code, ts in seen.items() for i, (t, t2) in enumerate(zip(ts * 5, ts[1:] * 6))]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    model = languages.train(df, sentence_model)
    tests = [(1, "The staff were late.\nDas Personal war nett zu uns.", "en"), (2, "Мы ждали заказ.", None), (3, "We waited for the order.", "en"), (4, None, None), (5, "12 !?", None), (6, "我们等了一个星期。配送时间太慢了。", "en")]
    found = languages.label_stretches(spark.createDataFrame(tests, "id bigint, text string, label string"), "id", model, sentence_model)
    got = sorted((r["id"], r["start_char"], r["end_char"], r["lang_code"]) for r in languages.mislabelled(found, "id").collect())
    assert got == [(1, 0, 20, "en"), (1, 21, 50, "de"), (2, 0, 15, "ru"), (6, 0, 17, "zh")]
    assert languages.train(df.limit(0), sentence_model).names == []


def test_label_spellings(spark):
    names = {"en-GB": "en", " Deutsch ": "de", "zh_Hans": "zh", "español": "es", "por": "pt", "und": None, "": None, None: None, "unknown": None}
    df = spark.createDataFrame([(n,) for n in names], "l string")
    assert [r[0] for r in df.select(languages.label_code(F.col("l"))).collect()] == list(names.values())


def test_copies(spark):
    rows = [
        (5, "Hello, World!", '{"a": 1, "b": "X"}'), (3, "hello world", ' {"b":"x","a":1} '), (4, "HELLO WORLD", '{"a":1,"b":"y"}'), (6, "Straße", None), (7, "STRASSE.", None),
        (8, None, None), (9, " ", None), (10, "???", "{cut"), (11, "??\n?", "{CUT"), (12, "?!", "{cut"), (13, "hello world", '{"a":1,"b":"X"} more'),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, raw_text string, response_text string").withColumn("value", F.lit(1))
    got = {r["row_id"]: (r["first_row_id"], r["copies"]) for r in copies.survey_copies(df).collect()}
    assert got == {5: (3, 2), 3: (3, 2), 4: (4, 1), 6: (6, 2), 7: (6, 2), 10: (10, 2), 11: (10, 2), 12: (12, 1), 13: (13, 1)}
    assert copies.survey_copies(df.limit(0)).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(encoding.FOLDER, f"{encoding.VOCABULARY}.json")), reason="no vocabulary file")
TEXTS = ["", None, "Hello  world's\n\n 12345 a.b", "ａ日本語のテキスト。 ไทยภาษา हिन्दी", "<|endoftext|> ​👩‍💻", " " * 50, "é" * 300, "word " * 2000, "龍喚士 裏覚醒 ーティ"]


def best_fit(sizes, capacity):
    """Containers that best fit decreasing needs, item by item."""
    free = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free)


@needs_vocabulary
def test_encoding_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(os.path.join(encoding.FOLDER, f"{encoding.VOCABULARY}.json"))
    tool.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df, "doc_id", "text").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == tool.encode(t or "", add_special_tokens=False).ids
        assert tool.decode(got[i], skip_special_tokens=False) == (t or "")
    counts = {r["doc_id"]: r["tokens"] for r in encoding.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 7, 7, 7, 33, 60, 99, 100, 101, 250]) for _ in range(800)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(900, None), (901, -3), (5, 7)], "doc_id bigint, tokens bigint")
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (3, "c", None), (4, "d", 0)], "spec_id bigint, spec_name string, capacity_tokens bigint")
    rows = packing.pack_documents(items, specs).collect()
    for spec, capacity in ((1, 100), (2, 64)):
        mine = [r for r in rows if r["spec_id"] == spec]
        held, total = {}, {}
        for r in mine:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["size"]
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
            assert r["piece_no"] == 0 or sizes[r["doc_id"]] > capacity
        assert max(held.values()) <= capacity and sum(held.values()) == sum(sizes) + 7
        assert all(total[i] == s + (7 if i == 5 else 0) for i, s in enumerate(sizes)) and {900, 901} <= set(total)
        assert len([h for h in held.values() if h]) == best_fit([p for s in [*sizes, 7] for p in [capacity] * (s // capacity) + [s % capacity]], capacity)
    assert {r["spec_id"] for r in rows} == {1, 2}
    assert packing.pack_documents(items.limit(0), specs).count() == 0 and packing.pack_documents(items, specs.limit(0)).count() == 0


def test_planned_slots_cover_all_ranks():
    lengths = {7: 1000, 3: 10, 50: 4, 0: 9}
    slots, containers = packing.plan(lengths, 50)
    for length, n in lengths.items():
        ranks = sorted(r for size, first, items, _ in slots if size == length for r in range(first, first + items))
        assert ranks == (list(range(n)) if length else [])
    assert containers == max(c + n for _, _, n, c in slots)


def test_garbled(spark):
    clean = ["Die Rücksendung kam beschädigt an, für 12 € „bitte warten“.", "La garantía es pequeña y la guía está rota.", "Заказ лежит уже шесть дней, и горячая линия опять не работает.", "配送時間はとても遅いです。返品ラベルが届きません。", "The £5 desk — “closed” again."]
    rows = [(i, t) for i, t in enumerate(clean * 60)]
    wrong = {1000: clean[0].encode().decode("cp1252", "replace").replace("�", "\x9d"), 1001: clean[1].encode().decode("latin-1"), 1002: clean[2].encode().decode("cp1251", "ignore"), 1003: clean[2].encode("cp1251").decode("latin-1"), 1004: clean[1].encode("cp1252").decode("utf-8", "replace"), 1005: "Fine so far.\n" + clean[1].encode().decode("latin-1").encode().decode("latin-1")}
    df = spark.createDataFrame([*rows, *wrong.items(), (2000, None), (2001, "")], "doc_id bigint, text string").withColumn("garbled", F.lit("x"))
    model = garbled.train(df, "doc_id", "text")
    got = {r["doc_id"]: r for r in garbled.repaired(df, "doc_id", "text", model).collect()}
    assert {i for i, r in got.items() if r["garbled"]} == set(wrong)
    assert got[1001]["restored"] == clean[1] and got[1003]["restored"] == clean[2] and got[1005]["restored"] == "Fine so far.\n" + clean[1]
    assert got[2000]["restored"] is None and got[2001]["restored"] == ""
    assert garbled.repaired(df.limit(0), "doc_id", "text", garbled.train(df.limit(0), "doc_id", "text")).count() == 0


def test_texts_garbled_by_any_decoder_are_told_and_found(spark):
    clean = ["Die Rücksendung kam beschädigt an, für 12 € „bitte warten“.", "La garantía es pequeña y la guía está rota.", "Заказ лежит уже шесть дней, и горячая линия опять не работает.", "配送時間はとても遅いです。返品ラベルが届きません。"]

    def shown(text, name):
        if name in garbled.MULTI:
            return text.encode().decode(name, "replace")
        signs = {b: chr(c) for c, b in garbled._tables()[garbled.SINGLE.index(name)][1].items()}
        return "".join(chr(b) if b < 0x80 else signs[b] for b in text.encode())

    assert not garbled.has_chain(clean).any()
    for name in garbled.SINGLE + garbled.MULTI:
        assert garbled.has_chain([shown(t, name) for t in clean]).all(), name
    # a third of the non-ASCII texts come from one source that garbles them
    rows = [(i, t) for i, t in enumerate(clean * 60)]
    wrong = [(1000 + i, shown(t, name)) for name in ("mac_roman", "koi8_r", "cp437", "cp850") for i, t in enumerate(clean * 30, 1000 * garbled.SINGLE.index(name))]
    df = spark.createDataFrame(rows + wrong, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in garbled.repaired(df, "doc_id", "text", garbled.train(df, "doc_id", "text")).collect()}
    assert {i for i, r in got.items() if r["garbled"]} == {i for i, _ in wrong}
    assert all(got[i]["restored"] == clean[i % 4] for i, _ in wrong)


def test_margin_is_validated_on_all_held_out_records_which_are_then_counted(spark, monkeypatch):
    clean = ["La garantía es pequeña y la guía está rota.", "Заказ лежит уже шесть дней, и горячая линия опять не работает."]
    # long texts: what tells lies beyond the first 1000 characters
    df = spark.createDataFrame([(i, "x " * 600 + clean[i % 2]) for i in range(20000)], "doc_id bigint, text string").repartition(8)
    seen = []
    validated = garbled._validated_margin
    monkeypatch.setattr(garbled, "_validated_margin", lambda held_out, model: seen.append((held_out.count(), model.points.sum())) or validated(held_out, model))
    model = garbled.train(df, "doc_id", "text")
    (held, counted), = seen
    assert held > 300 and model.points.sum() > counted
    assert model.points.sum() == sum(len(t) + 1 for t in ("x " * 600 + clean[0], "x " * 600 + clean[1])) * 10000
    errors, cases = garbled.errors_by_margin(["x " * 600 + t for t in clean] * 200 + ["plain", None], model)
    assert cases == 800 and errors[garbled.MARGINS.index(model.margin)] == min(errors) == 0


@needs_vocabulary
def test_long_words_are_encoded_as_wholes_and_decoded(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(os.path.join(encoding.FOLDER, f"{encoding.VOCABULARY}.json"))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8000)), "".join(rng.choice(["the", "delivery", "tion", "inter", "national", "e"]) for _ in range(3000)), "a" * 20000, "." * 3000 + "=" * 3000, "пример" * 2000, "0123456789" * 900]
    df = spark.createDataFrame([*enumerate(words), (90, None), (91, "")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    made = encoding.encode(df, "doc_id", "text")
    assert {r["doc_id"]: r["ids"] for r in made.collect()} == {i: tool.encode(w, add_special_tokens=False).ids for i, w in enumerate(words)} | {90: [], 91: []}
    assert {r["doc_id"]: r["text"] for r in encoding.decode(made, "doc_id", "ids").collect()} == dict(enumerate(words)) | {90: "", 91: ""}
    odd = spark.createDataFrame([(1, None), (2, [10**9]), (3, [])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in encoding.decode(odd, "doc_id", "ids").collect()} == {1: None, 2: None, 3: ""}


def test_buckets_of_ranks_cut_slots_and_lose_none():
    slots, _ = packing.plan({7: 1000, 3: 400, 50: 4, 20: 77, 11: 130}, 50)
    cut, width = packing.bucketed(slots)
    whole = sorted((length, rank + i, container + i) for length, rank, items, container in slots for i in range(items))
    assert sorted((length, rank + i, container + i) for length, _, rank, items, container in cut for i in range(items)) == whole
    assert all(rank // width[length] == bucket == (rank + items - 1) // width[length] for length, bucket, rank, items, _ in cut)


def test_fill_is_reported_against_the_least_number_of_containers(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([60, 40, 50, 50, 30, 250, 0])], "doc_id bigint, tokens bigint")
    specs = spark.createDataFrame([(1, "a", 100)], "spec_id bigint, spec_name string, capacity_tokens bigint")
    r = packing.fill(packing.pack_documents(items, specs), specs).first()
    assert (r["containers"], r["tokens"], r["least"], r["fullest"], r["filled"]) == (5, 480, 5, 100, 0.96)


def test_copies_with_many_nulls_and_field_names_that_differ_in_case(spark):
    rows = [(i, "Same text", None) for i in range(200)] + [(300, "same text", '{"a": 1, "A": 2}'), (301, "SAME TEXT", '{"A":2,"a":1}'), (302, "same text", '{"A":1,"a":2}')]
    df = spark.createDataFrame(rows, "row_id bigint, raw_text string, response_text string")
    got = {r["row_id"]: (r["first_row_id"], r["copies"]) for r in copies.survey_copies(df).collect()}
    assert got == {i: (0, 200) for i in range(200)} | {300: (300, 2), 301: (300, 2), 302: (302, 1)}


def test_confidence_of_a_script_is_its_share_of_the_letters():
    assert languages.script_share("Мы ждали", "ru") == 1.0 and languages.script_share("Мы abcd", "ru") == 2 / 6
    assert languages.script_share("日本ですabc", "ja") == 4 / 7 and languages.script_share("", "th") == 0.0
