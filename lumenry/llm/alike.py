"""Texts that look the same brought to one plain form.

Look-alike classes are the connected components, by union-find, of code points and short strings that
Unicode or a table of look-alike letters relates. The most frequent member in the corpus represents a class,
within each script, so that every script keeps its own words. A multi-pattern automaton finds all other
members in a text and they are rewritten greedily, longest first. Then letters with any number of marks, voiced
kana and conjoining Hangul are composed, as far as Unicode has one character for them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import codepoints

# Letters of other scripts that look like Latin ones, capital and small.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXYQWaesijopcyxhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγ", "ABEZHIKMNOPTYXaikvopuxy"))
# Signs without width, and spaces that a plain space stands for.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SPACES = "               　"
#: Blocks whose characters are forms of others: ligatures, presentation and width forms, letters of mathematics, radicals.
FORMS = ((0x2F00, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE), (0x1D400, 0x1D7FF), (0x24B6, 0x24E9), (0x2160, 0x217F))
POINTS = 0x110000
#: A word of Latin letters between Cyrillic ones is a disguised one only up to this length; names in Latin letters are longer.
SHORT = 3


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> list[list[str]]:
        found: dict[str, list[str]] = {}
        for s in self.parent:
            found.setdefault(self.find(s), []).append(s)
        return list(found.values())


@functools.lru_cache(maxsize=65536)
def script(s: str) -> str:
    name = unicodedata.name(s[0], "")
    return next((k for k in ("LATIN", "CYRILLIC", "GREEK") if k in name), "")


def count_signs(texts: DataFrame) -> DataFrame:
    """(sign, n): how often each code point, and each code point with a following mark, occurs in all rows of `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, pairs = np.zeros(POINTS, np.int64), {}
        marks = np.zeros(POINTS, bool)
        marks[[c for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) == "Mn"]] = True
        for batch in batches:
            cps, _ = codepoints([t + "\n" for t in batch.column(0).to_pylist() if t])
            if not len(cps):
                continue
            cps = cps.astype(np.int64)
            points += np.bincount(cps, minlength=POINTS)
            at = np.flatnonzero(marks[cps[1:]])
            for pair, n in zip(*np.unique((cps[at] << 21) + cps[at + 1], return_counts=True)):
                pairs[int(pair)] = pairs.get(int(pair), 0) + int(n)
        at = [c for c in np.flatnonzero(points).tolist() if not 0xD800 <= c < 0xE000]
        signs = [chr(c) for c in at] + [chr(p >> 21) + chr(p & 0x1FFFFF) for p in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(signs, pa.string()), pa.array([*points[at].tolist(), *pairs.values()], pa.int64())], ["sign", "n"])

    return texts.select("text").mapInArrow(count, "sign string, n bigint").groupBy("sign").agg(F.sum("n").alias("n"))


def _form(c: str) -> str:
    return unicodedata.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in FORMS) else c


def _is_composed(sign: str, composed: str) -> bool:
    """Whether the second is one character for the first, which is several or stands for the same as the second."""
    return len(composed) < len(sign) or (len(composed) == len(sign) == 1 and composed != sign)


def look_alikes(signs: dict[str, int]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Rewrites that hold everywhere, and of letters the representative in each script.

    signs: frequencies, at most one for each code point and marked code point, so its size is Unicode's at most.
    """
    classes = Classes()
    for sign in signs:
        if len(sign) == 1:
            classes.union(sign, _form(sign))
        composed = unicodedata.normalize("NFC", sign)
        if _is_composed(sign, composed):
            classes.union(sign, composed)
    for table in (CYRILLIC, GREEK):
        for a, b in table.items():
            classes.union(a, b)
    for c in SPACES:
        classes.union(c, " ")
    classes.union("‑", "-")
    everywhere, by_script = {c: "" for c in INVISIBLE}, {}
    for group in classes.members():
        if len(group) == 1:
            continue
        parts: dict[str, list[str]] = {}
        for s in group:
            parts.setdefault(script(s), []).append(s)
        plain = {}
        for name, same in parts.items():
            # A form never represents its class, however frequent: only what stands for itself does.
            own = [s for s in same if all(_form(c) == c for c in s) and s not in SPACES and s != "‑" and unicodedata.normalize("NFC", s) == s] or same
            best = plain[name] = max(own, key=lambda s: (signs.get(s, 0), s.isascii(), -ord(s[0])))
            everywhere |= {s: best for s in same if s not in own}
        if len([p for p in plain if p]) > 1:
            for s in plain.values():
                by_script[s] = {k: v for k, v in plain.items() if k}
    for sign in signs:  # strings that only compose, without any class of their own
        composed = unicodedata.normalize("NFC", sign)
        if _is_composed(sign, composed):
            everywhere[sign] = everywhere.get(composed, composed)
    return everywhere, by_script


def _is_cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" or c >= "\U00020000" or "＀" <= c <= "／"


def _is_emoji(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or c in "️‍⃣#*0123456789"


class Rewriter:
    def __init__(self, everywhere: dict[str, str], by_script: dict[str, dict[str, str]]):
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        for s, plain in everywhere.items():
            self.automaton.add_word(s, (s, plain))
        self.automaton.make_automaton()
        self.single = {s for s in everywhere if len(s) == 1}
        self.marks = regex.compile(r"\p{Mn}")
        self.odd = regex.compile("[" + "".join(map(regex.escape, sorted(self.single))) + r"]|[^\W\d_]\p{Mn}")
        self.letters = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}]+")
        self.foreign = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
        self.latin = regex.compile(r"\p{Latin}")
        self.by_script = by_script
        self.parts = regex.compile(r"[^\p{M}]?\p{M}+|[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]")

    def _keeps(self, text: str, start: int, s: str) -> bool:
        """Whether a sign is plain where it stands."""
        before, after = text[start - 1] if start else "", text[start + len(s)] if start + len(s) < len(text) else ""
        if s == "‍":
            return bool(before and after) and ((_is_emoji(before) and _is_emoji(after)) or unicodedata.combining(before) == 9)
        if s == "‌":
            return bool(before) and unicodedata.combining(before) == 9
        if s == "　" or ("＀" <= s <= "･" and unicodedata.category(s)[0] in "PS"):
            return any(c and (_is_cjk(c) or (s != "　" and c in "。、」』")) for c in (before, after)) or (s != "　" and any(map(_is_cjk, text)))
        return False

    def signs(self, text: str) -> str:
        """Rewrites what is plain nowhere."""
        if not self.odd.search(text):
            return text
        out, done = [], 0
        for end, (s, plain) in self.automaton.iter_long(text):
            start = end + 1 - len(s)
            if not self._keeps(text, start, s):
                out += [text[done:start], plain]
                done = end + 1
        return "".join([*out, text[done:]]) if out else text

    def words(self, text: str) -> str:
        """Rewrites letters of another script than their word's."""
        if not self.foreign.search(text):
            return text
        found = [(m.start(), m[0], {script(c) for c in m[0]} - {""}) for m in self.letters.finditer(text)]
        goals = [self._goal(word, scripts) for _, word, scripts in found]
        out, done = [], 0
        for i, (start, word, scripts) in enumerate(found):
            goal = goals[i]
            if goal == "?":
                around = [next((g for g in goals[i + 1 : i + 2]), None), goals[i - 1] if i else None]
                own = next(iter(scripts)) if len(scripts) == 1 else ""
                attached = (start and (text[start - 1].isdigit() or text[start - 1] in "/-") and self._coded(text, start)) or self._code_after(text, start + len(word))
                if own == "LATIN":
                    goal = "CYRILLIC" if around == ["CYRILLIC"] * 2 and not attached and (len(word) == 1 or len(word) <= SHORT and word.islower()) else own
                elif own:
                    goal = "LATIN" if attached or ("LATIN" in around and "CYRILLIC" not in around and "GREEK" not in around) else own
                else:
                    goal = "CYRILLIC" if "CYRILLIC" in around and "LATIN" not in around else "LATIN"
            plain = "".join(self.by_script.get(c, {}).get(goal, c) for c in word)
            if plain != word:
                out += [text[done:start], plain]
                done = start + len(word)
        return "".join([*out, text[done:]]) if out else text

    @staticmethod
    def _coded(text: str, start: int) -> bool:
        return text[start - 1].isdigit() or (start > 1 and text[start - 2].isdigit())

    @staticmethod
    def _code_after(text: str, end: int) -> bool:
        rest = text[end : end + 2]
        return rest[:1].isdigit() or (rest[:1] in ("-", "/") and rest[1:].isdigit())

    def _goal(self, word: str, scripts: set[str]) -> str:
        """The script that all letters of the word can be of; '?' if more than one."""
        can = [g for g in ("LATIN", "CYRILLIC", "GREEK") if all(script(c) in ("", g) or g in self.by_script.get(c, {}) for c in word)]
        if len(scripts) == 1 and len(can) == 1:
            return can[0]
        can = [g for g in can if g != "GREEK" or scripts == {"GREEK"}]
        if not can:
            return max(scripts, key=lambda s: sum(script(c) == s for c in word), default="")
        return can[0] if len(can) == 1 else "?"

    def composed(self, text: str) -> str:
        """Composes what Unicode has one character for. Nothing is taken apart, and marks that stay keep their order."""
        if unicodedata.is_normalized("NFC", text):
            return text

        def one(m) -> str:
            whole = unicodedata.normalize("NFC", m[0])
            return whole if len(whole) < len(m[0]) else m[0]

        return self.parts.sub(one, text)

    def plain(self, text: str) -> str:
        return text if text.isascii() else self.composed(self.words(self.composed(self.signs(text))))


def plain_forms(df: DataFrame, keys: list[str], signs: DataFrame) -> DataFrame:
    """(keys, text, plain, disguised) of each row of df, which has the keys and `text`.

    Null texts come out with a null form and as not disguised; empty ones stay empty. Equal keys are equal
    rows; columns besides these are left out.
    """
    counts = {r["sign"]: r["n"] for r in signs.collect()}  # bounded by Unicode, not by the corpus
    shared = df.sparkSession.sparkContext.broadcast(look_alikes(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Rewriter(*shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = [t if t is None else tool.plain(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string()), pa.array([f != t for f, t in zip(forms, texts)])], [*batch.schema.names, "plain", "disguised"])

    rows = df.select(*keys, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, plain string, disguised boolean")


def survey_texts(survey: DataFrame, themes: DataFrame) -> DataFrame:
    """(origin, item_id, phrase_no, text) of raw texts and theme phrases."""
    raw = survey.select(F.lit("raw_text").alias("origin"), F.col("row_id").alias("item_id"), F.lit(-1).alias("phrase_no"), F.col("raw_text").alias("text"))
    phrases = themes.select(F.lit("phrase").alias("origin"), F.col("annotation_id").alias("item_id"), F.posexplode("theme_associated_phrases").alias("phrase_no", "text"))
    return raw.unionByName(phrases)
