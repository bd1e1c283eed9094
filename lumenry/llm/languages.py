"""The language of each stretch of a text, told family first.

Scripts and, within Latin script, a family classifier narrow the choice; one-versus-one linear support
vector machines over character trigrams then separate the languages of the family. They are trained on a
bounded sample of labelled rows, whose wrong labels a first round of training weeds out. Sentences are
labelled, and runs of sentences of one language make a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import codepoints, mix
from .sentences import Model as SentenceModel
from .sentences import split

# Spellings of the languages, by ISO 639 codes, English and own names.
SPELLINGS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語 jp",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 cn",
    "th": "th tha thai ไทย ภาษาไทย",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ar": "ar ara arabic العربية عربي",
}
MISSING = ("", "und", "unknown")
FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es", "pt"), "han": ("zh", "ja")}
TOLD_BY_SCRIPT = ("ru", "ja", "th", "hi", "ar")
#: Rows of each label that the classifiers are fitted on, at most.
SAMPLE = 300
FEATURES = 1 << 16
EPOCHS, PENALTY = 60, 1e-4
#: A sentence less certain than this takes the language of its neighbours if they agree.
#: so does one at either end of a text if it is less certain than DOUBTFUL.
UNSURE, DOUBTFUL = 0.75, 0.6
CHUNK = 1000

_SCRIPTS = {"ja": "[぀-ヿｦ-ﾟ]", "han": "[㐀-鿿豈-﫿]", "th": "[ก-๛]", "hi": "[ऀ-ॿ]", "ar": "[؀-ۿݐ-ݿ]"}
_SCRIPTS = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_CYRILLIC_WORD = re.compile(r"(?<![A-Za-z])[Ѐ-ӿ]+(?![A-Za-z])")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_WORD = re.compile(r"[^\W\d_]+")
_OWN_CYRILLIC = re.compile("[бвгджзийклмнптфцчшщъыьэюяё]")


def label_code(c: Column) -> Column:
    """The code of a language label in any spelling; null if it names none of the languages."""
    name = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    base = F.regexp_replace(name, r"[-_].*$", "")
    codes = F.create_map(*[F.lit(x) for code, words in SPELLINGS.items() for w in words.split() for x in (w, code)])
    return F.coalesce(codes[name], codes[base])


def script_of(text: str) -> str:
    """A language whose script tells it, or the family that its script leaves: latin or han; '' without letters."""
    counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    latin = len(_LATIN.findall(text))
    if counts["ja"] and counts["ja"] * 12 >= counts["han"]:
        counts["ja"], counts["han"] = counts["ja"] + counts["han"], 0
    best = max(counts, key=counts.get)
    # Names and addresses in Latin letters stand in texts of all scripts.
    if counts[best] >= 3 and counts[best] * 4 >= latin:
        return best
    words = [w for w in _CYRILLIC_WORD.findall(text.lower()) if len(w) > 1 and _OWN_CYRILLIC.search(w)]
    if words and (len(words) * 3 >= len(_WORD.findall(text)) or not latin):
        return "ru"
    return "latin" if latin else best if counts[best] else ""


def script_share(text: str, code: str) -> float:
    """The share of a text's letters that are of the language's own script."""
    counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()} | {"latin": len(_LATIN.findall(text)), "ru": len(_CYRILLIC.findall(text))}
    own = counts[code] + (counts["han"] if code == "ja" else 0)
    return own / max(1, sum(counts.values()))


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts in a row, and the text of each: trigrams of letters, words set off by spaces."""
    cps, starts = codepoints([f" {t.lower()} " for t in texts])
    letters = cps >= 0x41
    cps = np.where(letters & (cps != 0x60), cps, 0x20).astype(np.uint64)
    with np.errstate(over="ignore"):
        grams = mix(cps[:-2] * np.uint64(0x1F123BB5) + cps[1:-1] * np.uint64(0x2545F4914F6CDD1D) + cps[2:] * np.uint64(0x9E3779B97F4A7C15))
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    keep = (text_of[:-2] == text_of[2:]) & (cps[1:-1] != 0x20)
    return (grams[keep] & np.uint64(FEATURES - 1)).astype(np.int64), text_of[:-2][keep]


def fit_svm(features: np.ndarray, text_of: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine, by averaged subgradient steps on the hinge loss."""
    n = len(signs)
    size = np.sqrt(np.maximum(np.bincount(text_of, minlength=n), 1))
    w, b, total, total_b = np.zeros(FEATURES), 0.0, np.zeros(FEATURES), 0.0
    balance = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum()))
    for epoch in range(EPOCHS):
        margin = signs * (np.bincount(text_of, w[features], minlength=n) / size + b)
        pull = np.where(margin < 1, signs * balance, 0)
        step = 8.0 / (1 + 0.1 * epoch)
        w = w * (1 - step * PENALTY) + step * np.bincount(features, (pull / size)[text_of], minlength=FEATURES)
        b += step * 0.1 * pull.sum()
        total, total_b = total + w, total_b + b
    return total / EPOCHS, total_b / EPOCHS


@dataclass
class Model:
    """Classifiers: of the Latin families, and of each pair of languages within a family."""

    names: list[tuple[str, str]]
    weights: np.ndarray
    intercepts: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """(text, classifier): how far each text lies on the side of the classifier's first name."""
        if not texts:
            return np.zeros((0, len(self.names)))
        features, text_of = _trigrams(texts)
        size = np.sqrt(np.maximum(np.bincount(text_of, minlength=len(texts)), 1))
        return np.stack([np.bincount(text_of, self.weights[i][features], minlength=len(texts)) / size + self.intercepts[i] for i in range(len(self.names))], axis=1)

    def decide(self, margins: np.ndarray, script: str) -> tuple[str, float]:
        at = {name: m for name, m in zip(self.names, margins)}
        sure = 1.0
        family = script
        if script == "latin":
            m = at.get(("germanic", "romance"), 0.0)
            family, sure = ("germanic" if m >= 0 else "romance"), _confidence(abs(m))
        votes = {x: 0.0 for x in FAMILIES[family]}
        for (a, b), m in at.items():
            if a in votes and b in votes:
                votes[a] += _confidence(m)
                votes[b] += _confidence(-m)
        best = max(votes, key=votes.get)
        return best, sure * votes[best] / max(1, len(votes) - 1)


def _confidence(margin: float) -> float:
    return float(1 / (1 + np.exp(-3.0 * margin)))


def train(rows: DataFrame, sentences: SentenceModel) -> Model:
    """The classifiers of a sample of the rows with `text` and `label`, the code that its label names.

    At most SAMPLE rows of each label are taken, by hash of their text, so that equal tables give equal models.
    """
    wanted = sorted({x for f in FAMILIES.values() for x in f})
    rank = F.xxhash64("text")
    share = rows.where(F.col("label").isin(wanted) & (F.length("text") > 0)).groupBy("label").agg(F.count("*").alias("n")).collect()
    # A hash threshold takes about twice the sample without sorting the rows; the sample is cut from that.
    limits = {r["label"]: min(1.0, 2.0 * SAMPLE / r["n"]) for r in share}
    if not limits:
        return Model([], np.zeros((0, FEATURES)), np.zeros(0))
    limit = F.create_map(*[F.lit(x) for code, p in limits.items() for x in (code, p)])
    drawn = rows.where(F.col("label").isin(wanted) & (F.length("text") > 0)).where(F.pmod(rank, F.lit(1 << 30)) < limit[F.col("label")] * (1 << 30)).select("text", "label", rank.alias("rank"))
    by_label: dict[str, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["rank"], r["text"])):  # about 2 * SAMPLE rows of each label
        by_label.setdefault(r["label"], [])
        if len(by_label[r["label"]]) < SAMPLE:
            by_label[r["label"]].append(r["text"])
    texts, labels = [], []
    for label, sample in by_label.items():
        for text in sample:
            for a, b in split(text, sentences):
                if script_of(text[a:b]) in ("latin", "han", "ja"):
                    texts.append(text[a:b])
                    labels.append(label)
    names = [("germanic", "romance"), *((a, b) for f in FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :])]
    side = lambda label, name: label == name or label in FAMILIES.get(name, ())
    fitted = [(name, *_fit_clean(texts, np.array([side(x, name[0]) for x in labels]), np.array([side(x, name[1]) for x in labels]))) for name in names]
    return Model([x[0] for x in fitted], np.stack([x[1] for x in fitted]), np.array([x[2] for x in fitted]))


def _fit_clean(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, float]:
    """Fits twice: what the first fit puts clearly on the other side was labelled wrongly."""
    kept = np.flatnonzero(first | second)
    if not first.any() or not second.any():
        return np.zeros(FEATURES), float(first.any()) - float(second.any())
    for _ in range(2):
        mine = [texts[i] for i in kept]
        signs = np.where(first[kept], 1.0, -1.0)
        features, text_of = _trigrams(mine)
        w, b = fit_svm(features, text_of, signs)
        size = np.sqrt(np.maximum(np.bincount(text_of, minlength=len(mine)), 1))
        kept = kept[signs * (np.bincount(text_of, w[features], minlength=len(mine)) / size + b) > -0.1]
    return w, b


def _stretches(units: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Runs of sentences of one language. Sentences without letters, and unsure ones between neighbours that agree, join them."""
    known = [u for u in units if u[2]]
    if not known:
        return []
    codes = [(code, sure) for _, _, code, sure in units]
    for i, (code, sure) in enumerate(codes):
        before = next((c for c, _ in reversed(codes[:i]) if c), "")
        after = next((c for c, _ in codes[i + 1 :] if c), "")
        if not code:
            codes[i] = (before or after, UNSURE)
        elif (before or after) and (sure < UNSURE and before == after or sure < DOUBTFUL and not (before and after)):
            codes[i] = (before or after, sure)
    found: list[list] = []
    for (start, end, _, _), (code, sure) in zip(units, codes):
        if found and found[-1][2] == code:
            found[-1][1] = end
            found[-1][3].append(sure)
        else:
            found.append([start, end, code, [sure]])
    return [(a, b, code, float(np.mean(sure))) for a, b, code, sure in found]


def identify(texts: list[str], model: Model, sentences: SentenceModel) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, code, confidence) of the stretches of each text."""
    places = [split(t, sentences) if t else [] for t in texts]
    scripts = [[script_of(t[a:b]) for a, b in spans] for t, spans in zip(texts, places)]
    asked = [(i, k) for i, row in enumerate(scripts) for k, s in enumerate(row) if s in ("latin", "han")]
    margins = model.margins([texts[i][slice(*places[i][k])] for i, k in asked])
    told = {at: model.decide(m, scripts[at[0]][at[1]]) for at, m in zip(asked, margins)}
    found = [_stretches([(a, b, *told.get((i, k), (s, 1.0 if s else 0.0))) for k, ((a, b), s) in enumerate(zip(spans, scripts[i]))]) for i, spans in enumerate(places)]
    # Where the script decides, its share of the letters is the confidence.
    by_script = lambda i, a, b, code, sure: script_share(texts[i][a:b], code) if code in TOLD_BY_SCRIPT and sure == 1.0 else sure
    return [[(a, b, code, by_script(i, a, b, code, sure)) for a, b, code, sure in row] for i, row in enumerate(found)]


def label_stretches(rows: DataFrame, key: str, model: Model, sentences: SentenceModel) -> DataFrame:
    """(key, label, stretches) of each row, which has key, `text` and `label`.

    Null, empty and blank texts, and texts without letters, have no stretches. Equal keys are equal rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model, sentences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64())]))
        names = ("start_char", "end_char", "lang_code", "confidence")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [x for i in range(0, len(texts), CHUNK) for x in identify(texts[i : i + CHUNK], *shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("label"), pa.array([[dict(zip(names, s)) for s in x] for x in found], kind)], [key, "label", "stretches"])

    kept = rows.select(key, "text", "label")
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, label string, stretches array<struct<start_char: int, end_char: int, lang_code: string, confidence: double>>")


def mislabelled(labelled: DataFrame, key: str) -> DataFrame:
    """(key, start_char, end_char, lang_code, confidence) of rows without a label, with a wrong one or of several languages."""
    single = F.size("stretches") == 1
    right = single & F.col("label").isNotNull() & (F.col("stretches")[0]["lang_code"] == F.col("label"))
    return labelled.where((F.size("stretches") > 0) & ~F.coalesce(right, F.lit(False))).select(key, F.inline("stretches"))
