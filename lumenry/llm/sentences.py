"""Sentence boundaries in many languages by a hidden-event n-gram language model.

The events are boundary tokens in the gaps between words. Where a line has closing marks, or spaces next to
scripts that are written without full stops, these are its gaps; in a line without any mark, every space is one.
At line breaks a boundary is certain. The model of marks is trained on the corpus without labels, by expectation maximisation: the words around certain
boundaries, line starts and line ends, tell first how likely a boundary token follows the word before a gap
and precedes the word after it, and the gaps themselves then refine it. Lines without marks are read by a word
n-gram model with boundary tokens among the words (`Words`): a word depends on the word before it, and the second
of a sentence on the boundary too, which couples neighbouring gaps. Forward-backward over the gaps of a line gives
posteriors, and those above one half are boundaries.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

#: A table keeps the events of at least this share of its gaps, so it has no more than its inverse of entries.
RAREST = 5e-6
#: Weight of the coarser event classes, in gaps.
BACKOFF = 3.0
ITERATIONS = 5
#: Marks that at first are taken to end sentences wherever they stand: exclamation, question, ellipsis, ideographic and Indic stops.
STRONG = ("x", "c", "e")

_UNSTOPPED = "฀-๿຀-໿က-႟ក-៿"
_GAP = re.compile(rf"[.!?…。！？｡।॥؟۔]+[\"'”’»」』）)\]]*|(?<=[{_UNSTOPPED}])\s+(?=\S)|(?<=\S)\s+(?=[{_UNSTOPPED}])")
_CLOSED = re.compile(r"[.!?…。！？｡।॥؟۔]+[\"'”’»」』）)\]]*$")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_QUOTED = re.compile(r'"[^"]+"|“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|「[^「」]+」|『[^『』]+』|\([^()]+\)|（[^（）]+）')
_WORD = re.compile(r"\w+(?:['’-]\w+)*")
_FIRST = re.compile(r"[^\W\d_]+|\d|\S")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿豈-﫿" + _UNSTOPPED + "]")
_TRAILING = re.compile("[☀-➿\ufe0f\u200d\U0001f000-\U0001faff]+\\s*[.!?…]+")
_LETTER = re.compile(r"[^\W\d_]")
_UNMARKED = re.compile(r"[^\W\d_](?:[\w\s'’\u0900-\u0dff-])*$")
_DIGITS = re.compile(r"\d+")
_LEAD = re.compile(r"^\W+")


def _left(line: str, start: int, stop: str) -> tuple[str, str]:
    """The word before a gap, and its class."""
    begin = start
    while begin and not line[begin - 1].isspace():
        begin -= 1
    word = line[begin:start]
    if not word:
        return "", "none"
    if _IDEOGRAPH.match(word[-1]):
        return word[-3:], f"script{ord(word[-1]) >> 7}"
    word = _DIGITS.sub("0", _LEAD.sub("", word).lower())
    if word.isdigit():
        return "0", "number-first" if not line[:begin].strip() else "number"
    kind = "dotted" if "." in word else "one" if len(word) == 1 else "two" if len(word) == 2 else "short" if len(word) <= 4 else "word"
    return word, kind if word[-1:].isalnum() else "sign"


def _shape(word: str) -> str:
    """The class of a word after a gap."""
    if word == "0":
        return "number"
    if _IDEOGRAPH.match(word[0]):
        return f"script{ord(word[0]) >> 7}"
    return f"{word[0]}{ord(word[1]) >> 9}" if word[0] in "Aaxn" and word[1:2].isalpha() else "sign"


def _right(line: str, at: int, cased: bool) -> tuple[str, str]:
    """The word after a gap, and its class."""
    m = _FIRST.match(line, at)
    if not m:
        return "", "none"
    word = m[0]
    if word.isdigit():
        return "0", "number"
    if _IDEOGRAPH.match(word[0]):
        return word[:2], f"script{ord(word[0]) >> 7}"
    if not word[0].isalpha():
        follows = line[at + 1 : at + 2]
        return word[0] + ("A" if follows.isupper() else "a" if follows.islower() else ""), "sign"
    case = ("A" if word[0].isupper() else "a" if word[0].islower() else "x") if cased else "n"
    return case + word.lower(), f"{case}{ord(word[0]) >> 9}"


def _stop(mark: str) -> str:
    """The class of a closing mark with what closes after it."""
    bare = mark.rstrip("\"'”’»」』）)]")
    kind = "s" if not bare.strip() else "e" if bare.startswith(("...", "…")) else "p" if bare == "." else "x" if bare[-1] in "!?؟！？" else "c"
    closing = mark[len(bare) :]
    return kind + ("b" if closing and closing[-1] in "）)]" else "q" if closing else "")


def lines(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of each line with other than white space, without the white space around it."""
    for m in _LINE.finditer(text):
        line = m[0].rstrip()
        if line:
            bare = line.lstrip()
            yield m.start() + len(line) - len(bare), bare


def gaps(line: str, cased: bool) -> list[tuple[int, int, tuple[str, str], str, tuple[str, str]]]:
    """(end, next, left, stop, right) of each gap of a line that a boundary token could fill."""
    inside = [m.span() for m in _QUOTED.finditer(line)]
    opened = [a for a, _ in inside]
    found = []
    for m in _GAP.finditer(line):
        start, end = m.span()
        mark = m[0]
        spaced = mark.isspace()
        if spaced:
            end = start
        after = m.end()
        while after < len(line) and line[after].isspace():
            after += 1
        quoted = bisect_left(opened, end) - 1
        if after >= len(line) or (quoted >= 0 and end < inside[quoted][1]):
            continue
        if spaced and (found and found[-1][1] == after or not _LETTER.search(line, 0, start)):
            continue
        if not spaced and after == end:
            # Without a space, only after marks of scripts that take none, or before a capital that opens no name or address.
            follows = line[after]
            if mark[0] not in "。！？｡।॥؟" and not ((follows.isupper() or _IDEOGRAPH.match(follows)) and start and line[start - 1].isalnum() and not _addressed(line, start)):
                continue
        if m_after := _TRAILING.match(line, after):  # a sign before the last mark belongs to the sentence with it
            if m_after.end() > after:
                continue
        found.append((end, after, _left(line, start, mark), _stop(mark), _right(line, after, cased)))
    return found


def _addressed(line: str, at: int) -> bool:
    """Whether the unspaced stretch around a place is an address, a version or an initialism."""
    a, b = line.rfind(" ", 0, at) + 1, line.find(" ", at)
    word = line[a : b if b >= 0 else len(line)]
    return "@" in word or "://" in word or (at - a <= 1 and word[:1].isupper())


#: Cells of the tables of `Words`, of pairs of words and of single ones: they don't grow with the corpus.
PAIR_CELLS, WORD_CELLS = 1 << 18, 1 << 16
#: What a word's own counts are smoothed by, in words; and what a sentence's second word's are, in sentences.
SMOOTH, SMOOTH_SECOND = 5.0, 5.0
#: Stands for the end of a sentence among words.
END = 0


def word_id(word: str) -> int:
    return zlib.crc32(_DIGITS.sub("0", word.lower()).encode("utf-8", "surrogatepass")) or 1


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = word_id(word)
        return found


def _pair_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B)) >> np.uint64(7)


def _pair_cell(a: int, b: int) -> int:
    return ((a * 0x9E3779B1 + b * 0x85EBCA6B & 0xFFFFFFFFFFFFFFFF) >> 7) % PAIR_CELLS


class Words:
    """A word n-gram model with boundary tokens, counted on lines with marks, as if these were not written.

    pairs: neighbouring words within sentences; seconds: the first two words of sentences; ends, starts, uses: of words.
    """

    TABLES = {"pairs": PAIR_CELLS, "seconds": PAIR_CELLS, "ends": WORD_CELLS, "starts": WORD_CELLS, "uses": WORD_CELLS}

    def __init__(self) -> None:
        for name, size in self.TABLES.items():
            setattr(self, name, np.zeros(size, np.int64))

    def count(self, marked: list[tuple[str, list]]) -> None:
        """Adds lines with marks, each with its gaps. At line ends and strong marks a boundary is certain; at other marks nothing is counted."""
        ids_of, ids, sizes, sure, certain = _Ids(), [], [], [], []
        for line, between in marked:
            begin, known = 0, True
            for end, after, _, stop, _ in [*between, (len(line), len(line), None, "x", None)]:
                words = _WORD.findall(line[begin:end])
                if words:
                    ids += map(ids_of.__getitem__, words)
                    sizes.append(len(words))
                    sure.append(stop in STRONG)
                    certain.append(known)
                begin, known = after, stop in STRONG
        if not sizes:
            return
        w, ends, ended, begun = np.array(ids, np.uint64), np.cumsum(sizes), np.array(sure), np.array(certain)
        first, last = (ends - sizes)[begun], ends[ended] - 1
        inner = np.ones(len(w), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        single = np.array(sizes)[begun] == 1
        second = np.where(single, np.uint64(END), w[np.minimum(first + 1, len(w) - 1)])
        for table, cells in ((self.pairs, _pair_cells(w[at], w[at + 1])), (self.uses, w[np.concatenate([at, last])]), (self.ends, w[last]), (self.starts, w[first]), (self.seconds, _pair_cells(w[first], second))):
            table += np.bincount((cells % np.uint64(len(table))).astype(np.int64), minlength=len(table))

    def ready(self) -> Words:
        self._uses, self._ends, self._starts = max(1.0, float(self.uses.sum())), float(self.ends.sum()), float(self.starts.sum())
        return self

    def _alone(self, w: int) -> float:
        return (self.uses[w % WORD_CELLS] + 0.5) / (self._uses + 0.5 * WORD_CELLS)

    def follows(self, a: int, b: int) -> float:
        """The probability of b, or of a boundary, after a word a within a sentence."""
        own = self._ends / self._uses if b == END else self._alone(b)
        n = self.ends[a % WORD_CELLS] if b == END else self.pairs[_pair_cell(a, b)]
        return (n + SMOOTH * own) / (self.uses[a % WORD_CELLS] + SMOOTH)

    def second(self, a: int, b: int) -> float:
        """The same after a sentence's first word."""
        return (self.seconds[_pair_cell(a, b)] + SMOOTH_SECOND * self.follows(a, b)) / (self.starts[a % WORD_CELLS] + SMOOTH_SECOND)

    def begins(self, w: int) -> float:
        return (self.starts[w % WORD_CELLS] + SMOOTH * self._alone(w)) / (self._starts + SMOOTH)

    def steps(self, ids: list[int]) -> tuple[list, tuple[float, float]]:
        """Of each gap [boundary before the word before it][boundary in it] what the model gives it, and of the end after the last word."""
        log = lambda p: math.log(max(p, 1e-300))
        found = []
        for a, b in zip(ids, ids[1:]):
            opening = log(self.begins(b))
            found.append(((log(self.follows(a, b)), log(self.follows(a, END)) + opening), (log(self.second(a, b)), log(self.second(a, END)) + opening)))
        return found, (log(self.follows(ids[-1], END)), log(self.second(ids[-1], END)))

    def posteriors(self, ids: list[int]) -> list[float]:
        """The probability of a boundary in each gap between words of a line, by forward-backward; its ends are boundaries."""
        steps, last = self.steps(ids)
        forward = [(-math.inf, 0.0)]
        for no, yes in steps:
            f = forward[-1]
            forward.append((_sum(f[0] + no[0], f[1] + yes[0]), _sum(f[0] + no[1], f[1] + yes[1])))
        backward = [last]
        for no, yes in reversed(steps):
            f = backward[-1]
            backward.append((_sum(no[0] + f[0], no[1] + f[1]), _sum(yes[0] + f[0], yes[1] + f[1])))
        odds = [a[0] + b[0] - a[1] - b[1] for a, b in zip(forward[1:], reversed(backward[:-1]))]
        return [1 / (1 + math.exp(min(d, 700))) for d in odds]


def _sum(a: float, b: float) -> float:
    """The logarithm of the sum of what a and b are the logarithms of."""
    top, low = (a, b) if a >= b else (b, a)
    return top if low == -math.inf else top + math.log1p(math.exp(low - top))


def unmarked(line: str) -> list[tuple[int, int, int]]:
    """(start, end, id) of the words of a line that is written without marks, in a script with spaces between words; else none.

    Without marks is a line in which nothing but spaces, hyphens and apostrophes parts words: lists and figures have other signs.
    """
    if _IDEOGRAPH.search(line) or not _UNMARKED.match(line):
        return []
    return [(*m.span(), word_id(m[0])) for m in _WORD.finditer(line)]


@dataclass
class Model:
    """Log-odds of a boundary token after the word before a gap, and by how much the word after it changes them."""

    left: dict[tuple[str, str], float] = field(default_factory=dict)
    right: dict[tuple[str, str], float] = field(default_factory=dict)
    prior: float = 1.0
    short: float = -2.0
    words: Words | None = None

    def odds(self, word: str, kind: str, stop: str, following: str, shape: str) -> float:
        left = self.left.get((word, stop))
        if left is None:
            left = self.left.get((kind, stop), -0.5 if stop.endswith("q") else self.prior)  # sentences go on after what they quote
        right = self.right.get((following, _mark(stop)))
        if right is None:
            right = self.right.get((shape, _mark(stop)), -2.0 if shape[:1] == "a" else 0.0)
        return left + right


def _mark(stop: str) -> str:
    """Whether a gap is a space or follows a mark: what words follow boundaries doesn't depend on the mark."""
    return "s" if stop[:1] == "s" else "m"


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


_EVENTS = "word string, kind string, stop string, following string, shape string, place string, n bigint"


def count_events(texts: DataFrame) -> DataFrame:
    """How often each surrounding occurs at gaps, and beside certain boundaries: line starts and line ends. All rows of `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            seen: Counter = Counter()
            marked = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                cased = text != text.lower() and text != text.upper()
                for _, line in lines(text):
                    seen["", "", "", *_right(line, 0, cased), "start"] += 1
                    m = _CLOSED.search(line)
                    stop, start = (_stop(m[0]), m.start()) if m else ("s", len(line))
                    seen[*_left(line, start, stop), stop, "", "", "end"] += 1
                    between = gaps(line, cased)
                    if m and not _IDEOGRAPH.search(line):
                        marked.append((line, between))
                    if not between:
                        seen["", "", "", "", "", "short" if len(line) < 12 else "long"] += 1
                    for _, _, left, stop, right in between:
                        seen[*left, stop, *right, "gap"] += 1
            words.count(marked)
            yield rows_of([(*k, n) for k, n in seen.items()])
        for name in Words.TABLES:
            table = getattr(words, name)
            yield rows_of([(str(cell), "", "", "", "", name, int(table[cell])) for cell in np.flatnonzero(table).tolist()])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 6 else pa.string()) for i, c in enumerate(columns)], ["word", "kind", "stop", "following", "shape", "place", "n"])

    return texts.select("text").mapInArrow(count, _EVENTS).groupBy("word", "kind", "stop", "following", "shape", "place").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> Model:
    """The model of all rows of `text`, by expectation maximisation over the counted events.

    It starts from how words are spread over certain boundaries against gaps. An empty table gives a model
    that puts a boundary at every gap but before small letters.
    """
    events = cut_lineage(count_events(texts))
    totals = {r["place"]: r["n"] for r in events.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    short = math.log((totals.get("short", 0) + 1) / (totals.get("short", 0) + totals.get("long", 0) + 20))
    words = Words()
    names = list(Words.TABLES)
    table_no = F.array_position(F.array(*map(F.lit, names)), F.col("place")).cast("tinyint")
    counted = events.where(F.col("place").isin(*names)).select(table_no.alias("table"), F.col("word").cast("int").alias("cell"), "n").toPandas()  # no more than the tables' cells
    for number, own in counted.groupby("table"):
        getattr(words, names[number - 1])[own["cell"].to_numpy()] = own["n"].to_numpy()
    words = words.ready() if len(counted) else None
    if not totals.get("gap"):
        return Model(short=short, words=words)
    least = max(1.0, totals["gap"] * RAREST)
    ends = _sums(events.where("place = 'end'").select("word", "kind", "stop", F.lit(None).alias("following"), F.lit(None).alias("shape"), F.col("n").alias("b"), "n"), least)[0]
    starts = _sums(events.where("place = 'start'").select(F.lit(None).alias("word"), F.lit(None).alias("kind"), F.lit("").alias("stop"), "following", "shape", F.col("n").alias("b"), "n"), least)[1]
    gaps_ = events.where("place = 'gap'")
    model: Model | None = None
    for _ in range(ITERATIONS):
        left, right = _sums(_expected(gaps_, model), least)
        model = _maximised(left, right, ends, starts, first=model is None)
        model.short = short
    model.words = words
    return model


def _expected(gaps_: DataFrame, model: Model | None) -> DataFrame:
    """The counts of gaps with b, the expected number of boundary tokens among them."""
    if model is None:
        return gaps_.withColumn("b", F.col("n") * 0.5)
    shared = gaps_.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("word", "kind", "stop", "following", "shape")))
            share = [1 / (1 + math.exp(-shared.value.odds(*k))) for k in keys]
            b = [p * n for p, n in zip(share, batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b, pa.float64())], [*batch.schema.names, "b"])

    return gaps_.mapInArrow(expect, _EVENTS + ", b double")


def _sums(counts: DataFrame, least: float) -> tuple[dict, dict]:
    """(b, n) of the words and classes before a gap, and of those after it; of words, those seen often enough."""
    side = lambda name, event, stop: F.struct(F.lit(name).alias("side"), F.col(event).alias("event"), stop.alias("stop"))
    kind = F.when(F.col("stop").startswith("s"), "s").otherwise("m")
    each = F.explode(F.array(side("left", "word", F.col("stop")), side("left", "kind", F.col("stop")), side("right", "following", kind), side("right", "shape", kind)))
    rows = counts.select(each.alias("at"), "b", "n").where("at.event is not null and at.event <> ''").groupBy("at").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where(F.col("n") >= least).select("at.*", "b", "n").collect()
    found: tuple[dict, dict] = {}, {}
    for r in rows:  # at most 4 / RAREST of them
        found[r["side"] == "right"][r["event"], r["stop"]] = (float(r["b"]), float(r["n"]))
    return found


_CLASSES = ("none", "number", "number-first", "dotted", "one", "two", "short", "word", "sign")


def _is_class(event: str) -> bool:
    return event in _CLASSES or event.startswith("script")


def _maximised(left: dict, right: dict, ends: dict, starts: dict, first: bool) -> Model:
    model = Model()
    stops = {s for _, s in left}
    for stop in stops:
        mine = {w: v for (w, s), v in left.items() if s == stop}
        total_b, total = (sum(v[i] for w, v in mine.items() if _is_class(w)) for i in (0, 1))
        closed = sum(b for (w, s), (b, _) in ends.items() if s == stop and _is_class(w))
        prior = total_b / max(total, 1e-9)

        def share(w: str, backing: float) -> float:
            b, n = mine[w]
            if first:  # spread over line ends against spread over gaps
                b = 0.9 * n if stop in STRONG else min(0.9 * n, 0.5 * n * (ends.get((w, stop), (0.0, 0.0))[0] / max(closed, 1)) / max(n / max(total, 1), 1e-9))
            return (b + BACKOFF * backing) / (n + BACKOFF)

        by_class = {w: share(w, prior) for w in mine if _is_class(w)}
        for w in mine:
            model.left[w, stop] = _logit(by_class[w] if w in by_class else share(w, prior))
    for kind in {s for _, s in right}:
        mine = {w: v for (w, s), v in right.items() if s == kind}
        single = {w for w in mine if not _is_shape(w)}
        total_b, total = (sum(mine[w][i] for w in mine if w not in single) for i in (0, 1))
        opened = max(1.0, sum(b for (w, _), (b, _n) in starts.items() if _is_shape(w)))
        for w in mine:
            b, n = mine[w]
            known = starts.get((w, "m"), (0.0, 0.0))[0]
            if first and _is_shape(w):
                ratio = 0.1 if w[0] == "a" else 0.4 if w == "number" else 1.0
            elif first:  # spread over line starts against spread over gaps, among words of the same class
                shape = _shape(w)
                yes = known / max(1.0, starts.get((shape, "m"), (0.0, 0.0))[0]) * mine.get(shape, (0.0, n))[1]
                ratio = (yes + 0.5) / (n + 0.5) * (0.1 if shape[0] == "a" else 1.0)
            else:
                # Line starts count like a tenth of the boundaries within lines.
                weight = 0.1 * total_b / opened
                yes = (b + weight * known + 0.2) / (total_b * 1.1 + 1)
                no = (n - b + 0.2) / (total - total_b + 1)
                ratio = yes / no
            model.right[w, kind] = max(-7.0, min(7.0, math.log(ratio)))
    return model


def _is_shape(event: str) -> bool:
    return _is_class(event) or (len(event) <= 4 and event[:1] in "Aaxn" and event[1:].isdigit())


def posteriors(between: list, model: Model) -> list[float]:
    """The probability of a boundary token in each gap, by forward-backward over two states."""
    local = [model.odds(*left, stop, *right) for _, _, left, stop, right in between]
    # A boundary right after another one encloses a sentence of a few signs only, which is as rare as such lines are.
    bonds = [model.short if b[0] - a[1] < 4 else 0.0 for a, b in zip(between, between[1:])]
    forward, backward = [(0.0, local[0])], [(0.0, 0.0)]
    for odds, bond in zip(local[1:], bonds):
        no, yes = forward[-1]
        forward.append((_add(no, yes), odds + _add(no, yes + bond)))
    for odds, bond in zip(reversed(local[1:]), reversed(bonds)):
        no, yes = backward[-1]
        backward.append((_add(no, yes + odds), _add(no, yes + odds + bond)))
    found = []
    for (no, yes), (after_no, after_yes) in zip(forward, reversed(backward)):
        d = no + after_no - yes - after_yes
        found.append(1 / (1 + math.exp(min(d, 700))))
    return found


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text."""
    found = []
    cased = text != text.lower() and text != text.upper()
    for start, line in lines(text):
        begin = 0
        between = gaps(line, cased)
        if between:
            for (end, after, *_), p in zip(between, posteriors(between, model)):
                if p > 0.5:
                    found.append((start + begin, start + end))
                    begin = after
        elif model.words and len(words := unmarked(line)) > 1:
            for (_, end, _), (after, _, _), p in zip(words, words[1:], model.words.posteriors([w for _, _, w in words])):
                if p > 0.5:
                    found.append((start + begin, start + end))
                    begin = after
        found.append((start + begin, start + len(line)))
    return found


def sentence_units(df: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(keys, sentence_no, start_char, end_char) of each sentence of each row, which has the keys and `text`.

    Null, empty and blank texts have no sentences. Equal keys are equal rows; other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, (a, b) in enumerate(split(text, shared.value) if text else []):
                    rows.append(i)
                    numbers.append(k)
                    starts.append(a)
                    ends.append(b)
            taken = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, pa.int32()) for x in (numbers, starts, ends))], [*keys, "sentence_no", "start_char", "end_char"])

    rows = df.select(*keys, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, sentence_no int, start_char int, end_char int")


def survey_and_sentences(survey: DataFrame, sentences: DataFrame) -> DataFrame:
    """(origin, item_id, text) of raw texts and of sentence annotations, which may hold several sentences."""
    raw = survey.select(F.lit("raw_text").alias("origin"), F.col("row_id").alias("item_id"), F.col("raw_text").alias("text"))
    return raw.unionByName(sentences.select(F.lit("sentence").alias("origin"), F.col("sentence_id").alias("item_id"), F.col("sentence").alias("text")))
