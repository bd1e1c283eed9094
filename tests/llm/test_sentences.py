import itertools
import math
import random

import pytest

from lumenry.llm import sentences

ENGLISH = [f"{s} {p}" for s in ("we", "they", "the staff", "nobody", "my order", "the desk") for p in ("waited for hours", "left early", "was slow", "answered the phone", "came on monday", "was closed")]
ARABIC = ["انتظرنا ساعات طويلة", "لم يرد أحد", "كان الموظف لطيفا", "وصل الطلب متأخرا", "المكتب مغلق اليوم", "نحن سعداء بالخدمة"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(400):
        texts.append(" ".join(rng.choice(ENGLISH).capitalize() + rng.choice(".!") for _ in range(rng.randint(1, 4))))
        texts.append(" ".join(rng.choice(ARABIC) + rng.choice(".!") for _ in range(3)))
    return sentences.train(spark.createDataFrame([(t,) for t in texts], "text string"))


def cut(text, model):
    return [text[a:b] for a, b in sentences.split(text, model)]


@pytest.mark.parametrize("parts", [["we waited for hours", "we left early", "nobody answered the phone", "the desk was closed"], ["انتظرنا ساعات طويلة", "لم يرد أحد", "المكتب مغلق اليوم"], ["my order came on monday"], ["Delivery"]])
def test_text_without_marks_is_split_between_words(model, parts):
    assert cut(" ".join(parts), model) == parts
    assert cut("\n".join(f" {p} " for p in parts), model) == parts


def test_lines_with_marks_or_signs_are_not_split_at_spaces(model):
    assert cut("We waited for hours we left early.", model) == ["We waited for hours we left early."]
    assert cut("- nobody: we left early 12 %", model) == ["- nobody: we left early 12 %"]


def test_posteriors_between_words_equal_enumeration(model):
    ids = [sentences.word_id(w) for w in "we left early the desk was slow nobody".split()]
    steps, last = model.words.steps(ids)
    total, marginal = 0.0, [0.0] * len(steps)
    for events in itertools.product((0, 1), repeat=len(steps)):
        states = (1, *events)
        w = math.exp(sum(steps[i][states[i]][states[i + 1]] for i in range(len(steps))) + last[states[-1]])
        total += w
        marginal = [m + w * e for m, e in zip(marginal, events)]
    assert model.words.posteriors(ids) == pytest.approx([m / total for m in marginal], abs=1e-9)
    # gaps are coupled: what one word after a boundary costs depends on the boundary
    assert any(abs((s[0][1] - s[0][0]) - (s[1][1] - s[1][0])) > 0.1 for s in steps)


@pytest.mark.parametrize("size", [297, 301, 5000])
def test_quotations_of_any_length_stay_in_their_sentence(model, size):
    inside = ("We left early. The desk was closed. " * (size // 36 + 1))[: size - 1].strip() + "."
    for a, b in ('""', "“”", "()"):
        text = f"They said {a}{inside}{b} and left."
        assert cut(text, model) == [text]


def test_long_words_without_spaces(model):
    text = "x" * 50000 + ". We left early."
    assert cut(text, model) == ["x" * 50000 + ".", "We left early."]
