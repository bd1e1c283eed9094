"""Text that was decoded with the wrong encoding: found, and restored where it can still be told.

Character bigram models with additive smoothing are trained on clean records, those in which no chain of
encoding and decoding applies. Every stretch to which a chain applies is scored as it stands and as each
chain would restore it, in its context, and the likeliest reading is accepted beyond a margin, which is
chosen on held-out clean records and garbled copies of them. Signs that a decoder puts where it gave up are scored
too, against the context without them: beyond the margin they mark a text, though nothing can be restored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import codepoints

#: Size of the hashed bigram table and of the code point table: they don't grow with the corpus.
PAIRS, POINTS = 1 << 20, 1 << 17
MARGINS = (0.5, 1.0, 2.0, 4.0, 8.0)
ROUNDS = 3

# Decoders that garble, single-byte and multi-byte, and encodings that texts come in besides UTF-8.
SINGLE = ("cp1252", "mac_roman", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "cp1250")
MULTI = ("cp932", "gbk", "big5", "euc_jp")
LEGACY = ("cp932", "euc_jp", "gbk", "big5", "cp1251", "koi8_r", "cp866", "cp874", "cp1256")

#: Decoders whose output is also tried as text of an encoding other than UTF-8.
SWAPPED = tuple(SINGLE.index(name) for name in ("cp1252", "cp1251", "koi8_r", "cp866"))
COMMON = tuple(SINGLE.index(name) for name in ("cp1252", "cp1251"))
#: Characters that are looked into at once, and characters of readings that are scored at once: they bound a task's memory.
AT_ONCE, SCORED_AT_ONCE = 100_000, 400_000

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_LOST_RUN = re.compile("[\ufffd\x80-\x84\x86-\x9f]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: More western signs beyond ASCII in a row than any language writes.
_CROWDED = re.compile("[\x80-\xff\u0152-\u0178\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{4,}")
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Signs that two-byte decoders show besides Cyrillic and Greek, whose codes look like sequences: a run needs one of these on.
WIDE = "\u2e80"


def _single_table(name: str) -> dict[str, int]:
    """Characters by byte; bytes without a character come out as control characters, as lenient decoders give them."""
    table = {chr(b): b for b in range(0x80, 0x100)} if name == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@functools.cache
def _tables() -> list[tuple[str, dict[int, int], re.Pattern, re.Pattern]]:
    """Of each single-byte decoder: translation to bytes, UTF-8 sequences as it shows them, and dense runs of its characters."""
    found = []
    for name in SINGLE:
        table = _single_table(name)
        sign = lambda low, high: "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"
        follow = sign(0x80, 0xBF)
        sequences = re.compile(f"(?:{sign(0xC2, 0xDF)}{follow}|{sign(0xE0, 0xEF)}{follow}{{2}}|{sign(0xF0, 0xF4)}{follow}{{3}})+")
        high = sign(0x80, 0xFF)
        dense = re.compile(f"{high}+(?:[ -~]?{high}+)+[@-~]?")
        found.append((name, {ord(c): b for c, b in table.items()}, sequences, dense))
    return found


def _through(text: str, table: dict[int, int]) -> bytes:
    return text.translate(table).encode("latin-1")


@functools.lru_cache(maxsize=20_000)
def _legacy(run: str, table_no: int) -> tuple[str, ...]:
    name, table, _, _ = _tables()[table_no]
    raw = _through(run, table)
    options = []
    for original in LEGACY:
        if original == name:
            continue
        for size in (len(run), len(run) - 1) if run[-1] < "\x80" else (len(run),):
            try:
                options.append(raw[:size].decode(original) + run[size:])
                break
            except UnicodeError:
                continue
    return tuple(options)


@functools.lru_cache(maxsize=50_000)
def _multi(run: str) -> tuple[str, ...]:
    """A run of non-ASCII characters as UTF-8 that was read by a multi-byte decoder; what was lost stays lost."""
    options: list[str] = []
    for name in MULTI:
        try:
            raw = b"\xff".join(part.encode(name) for part in run.split("�"))
        except UnicodeError:
            continue
        hits = [m.span() for m in _UTF8.finditer(raw)]
        if sum(b - a for a, b in hits) >= 0.6 * len(raw) and hits:
            options.append(raw.decode("utf-8", "replace"))
    return tuple(options)


@functools.lru_cache(maxsize=50_000)
def _utf8_readings(run: str, table_no: int, depth: int) -> tuple[str, ...]:
    """The run as UTF-8 that one decoder showed, and those readings that again are such sequences, decoded further."""
    try:
        reading = _through(run, _tables()[table_no][1]).decode("utf-8")
    except UnicodeError:
        return ()
    further = [r for i, (_, _, sequences, _) in enumerate(_tables()) if depth > 1 and sequences.fullmatch(reading) for r in _utf8_readings(reading, i, depth - 1)]
    return (reading, *further)


def stretches(text: str, chains: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """(start, end, its readings) of each stretch to which a chain applies; `chains` as `Chains.of_text` has them."""
    for i, (_, _, sequences, dense) in enumerate(_tables()):
        if chains >> i & 1:
            for m in sequences.finditer(text):
                yield *m.span(), _utf8_readings(m[0], i, ROUNDS)
        if i in SWAPPED and chains >> (len(SINGLE) + i) & 1:
            for m in dense.finditer(text):
                yield *m.span(), _legacy(m[0], i)
    if chains >> 2 * len(SINGLE) & 1:
        for m in _HIGH.finditer(text):
            if max(m[0]) >= WIDE:
                yield *m.span(), _multi(m[0])


@functools.cache
def _flags() -> np.ndarray:
    """Of each code point: 1 lost bytes, 2 western beyond ASCII."""
    flags = np.zeros(POINTS, np.uint8)
    for c in range(0x80, 0x10000):
        flags[c] = (1 if _LOST.match(chr(c)) else 0) | (2 if _CROWDED.match(chr(c) * 4) else 0)
    return flags


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point three bits a single-byte decoder: 0 not among its signs, 1 continues UTF-8 sequences, 2 to 4 begins one of so many bytes, 5 none of these."""
    kinds = np.zeros(POINTS, np.uint32)
    for i, (_, table, _, _) in enumerate(_tables()):
        for c, b in table.items():
            kinds[c] |= (1 if b < 0xC0 else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 5) << 3 * i
    return kinds


@functools.cache
def _bytes_kinds() -> np.ndarray:
    """The same of bytes."""
    return np.array([0 if b < 0x80 else 1 if b < 0xC0 else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 5 for b in range(256)], np.uint8)


@functools.cache
def _codes(name: str) -> np.ndarray:
    """Of each code point its bytes by a multi-byte decoder as one number, 0 if it has none; what was lost counts as one byte."""
    signs = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    codes = np.zeros(POINTS, np.uint32)
    for sign, raw in zip(signs, "\n".join(signs).encode(name, "replace").split(b"\n")):
        codes[ord(sign)] = 0 if raw == b"?" else int.from_bytes(raw, "big")
    codes[:0x80], codes[0xFFFD] = np.arange(0x80), 0xFF
    return codes


def _covered(kind: np.ndarray) -> np.ndarray:
    """Where complete sequences begin, how many bytes they have."""
    follows = np.concatenate([kind == 1, np.zeros(3, bool)])
    one, two, three = follows[1:-2], follows[2:-1], follows[3:]
    return np.where((kind == 2) & one, 2, 0) + np.where((kind == 3) & one & two, 3, 0) + np.where((kind == 4) & one & two & three, 4, 0)


class Chains:
    """Where chains apply in some texts, told on all of them at once.

    of_text: of each text one bit a single-byte decoder of which it has a complete sequence, then one each of which it
    has two signs, then one if a multi-byte decoder's run is in it. runs: its runs of signs beyond ASCII; whole: of each
    decoder, how many of them it explains wholly, or by the greater part if it is a multi-byte one.
    """

    def __init__(self, texts: list[str]) -> None:
        cps, starts = codepoints([t + "\n" for t in texts])
        high = cps > 127
        kept = high.copy()
        kept[1:] |= high[:-1]  # with the sign that ends a run
        at = np.flatnonzero(kept)
        text_of, cps, high = np.searchsorted(starts, at, "right") - 1, np.minimum(cps[at], POINTS - 1), high[at]
        begins = high & ~np.concatenate([[False], high[:-1]])
        run = np.cumsum(begins) - 1
        self.run_text, sizes = text_of[begins], np.bincount(run[high], minlength=int(begins.sum()))
        self._texts = len(texts)
        self.runs, self.signs = self._by_text(np.ones(len(sizes))), self._by_text(sizes)
        self.of_text, self.whole, self.begun = np.zeros(len(texts), np.int64), [], []
        kinds = _kinds()[cps]
        for i in range(len(SINGLE)):
            kind = kinds >> np.uint32(3 * i) & np.uint32(7)
            covered = np.bincount(run, _covered(kind), len(sizes)) if len(sizes) else np.zeros(0)
            self.whole.append(self._by_text(covered == sizes))
            self.begun.append(np.bincount(text_of[:-1][(kind[:-1] >= 2) & (kind[:-1] <= 4) & (kind[1:] == 1)], minlength=len(texts)) if i in COMMON else None)
            self.of_text |= (self._by_text(covered) > 0).astype(np.int64) << i
            if i in SWAPPED:
                self.of_text |= (np.bincount(text_of[kind > 0], minlength=len(texts)) > 1).astype(np.int64) << (len(SINGLE) + i)
        wide = np.zeros(len(sizes), bool)
        wide[run[cps >= ord(WIDE)]] = True
        for name in MULTI:
            hit = self._multi_runs(_codes(name)[cps], run, wide)
            self.whole.append(self._by_text(hit))
            self.of_text |= (self.whole[-1] > 0).astype(np.int64) << 2 * len(SINGLE)

    def _by_text(self, of_run: np.ndarray) -> np.ndarray:
        return np.bincount(self.run_text, of_run, self._texts)

    @staticmethod
    def _multi_runs(codes: np.ndarray, run: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Which runs are mostly sequences in the decoder's bytes."""
        wide = wide.copy()
        wide[run[codes == 0]] = False
        at = wide[run]
        codes, run = codes[at], run[at]
        if not len(codes):
            return wide
        width = 1 + (codes > 0xFF) + (codes > 0xFFFF)
        owner = np.repeat(np.arange(len(codes)), width)
        place = np.arange(len(owner)) - (np.cumsum(width) - width)[owner]
        raw = codes[owner] >> (8 * (width[owner] - 1 - place)).astype(np.uint32) & np.uint32(0xFF)
        covered = np.bincount(run[owner], _covered(_bytes_kinds()[raw]), len(wide))
        size = np.bincount(run[owner][raw > 0x7F], minlength=len(wide)) + np.bincount(run[owner][(raw <= 0x7F) & (width[owner] > 1)], minlength=len(wide))
        return wide & (covered > 0) & (covered >= 0.6 * size)


def has_chain(texts: list[str]) -> np.ndarray:
    """Of each text whether bytes were lost, western signs crowd, or a good part of what is beyond ASCII is UTF-8 as one wrong decoder shows it.

    A good part is half of a line's runs, wholly so: in clean text of some scripts a few words happen to be such
    sequences. Of the commonest decoders, it is also a twentieth of the text's signs that begin one.
    """
    cps, starts = codepoints([t + "\n\n\n" for t in texts])
    f = _flags()[np.minimum(cps, POINTS - 1)]
    of_text = lambda at: np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(texts))
    west = (f & 2) > 0
    crowded = west[:-3] & west[1:-2] & west[2:-1] & west[3:]
    found = (of_text(np.flatnonzero(f & 1)) > 0) | (of_text(np.flatnonzero(crowded)) > 0)
    owner = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    chains = Chains([line for t in texts for line in t.split("\n")])
    for whole in chains.whole:
        found[owner[(whole > 0) & (whole >= 0.5 * chains.runs)]] = True
    least = 1 + np.bincount(owner, chains.signs, len(texts)) // 20
    for i in COMMON:
        found |= np.bincount(owner, chains.begun[i], len(texts)) >= least
    return found


@dataclass
class Model:
    """Counts of clean text, and the margin in nats by which another reading must be likelier."""

    points: np.ndarray
    pairs: np.ndarray
    margin: float = 2.0

    def __post_init__(self) -> None:
        total = max(1.0, float(self.points.sum()))
        self._single = ((self.points + 0.01) / (total + 0.01 * POINTS)).astype(np.float32)

    def _likelihoods(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        seen = self.points[np.minimum(a, POINTS - 1)]
        # A pair is no more frequent than either character: so pairs that share a cell don't lend each other counts.
        together = np.minimum(self.pairs[_pair(a, b)], np.minimum(seen, self.points[np.minimum(b, POINTS - 1)]))
        # Interpolation: what is known of the pair weighs with what has been seen of its first character.
        weight = seen / (seen + 50.0)
        return np.log(weight * together / np.maximum(seen, 1) + (1 - weight + 1e-3) * self._single[np.minimum(b, POINTS - 1)])

    def running(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of all characters up to each one, and where each text starts; a text's first one counts with the text before."""
        cps, starts = codepoints(texts)
        cps = cps.astype(np.int64)
        return np.concatenate([[0.0], np.cumsum(self._likelihoods(cps[:-1], cps[1:]), dtype=np.float64)]), starts

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of the characters of each text, the first one taken as given."""
        found, part, size = [], [], 0
        for text in [*texts, None]:
            if part and (text is None or size > SCORED_AT_ONCE):
                running, starts = self.running(part)
                found.append(running[starts[1:] - 1] - running[starts[:-1]])
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return np.concatenate(found) if found else np.zeros(0)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1_000_003 + b * 7919) & (PAIRS - 1)


def restore(texts: list[str], model: Model) -> list[tuple[str, float]]:
    """Of each text its likeliest reading, and the log-odds by which accepted readings beat the text as it stood.

    Chains don't reach across lines. Every stretch of every line to which a chain applies is scored.
    """
    lines = [[t] if t.isascii() else t.split("\n") for t in texts]
    gains = [0.0] * len(texts)
    active = [(i, j) for i, own in enumerate(lines) for j, line in enumerate(own) if not line.isascii()]
    for _ in range(ROUNDS):
        changed = []
        for (i, j), readings in zip(active, readings_of([lines[i][j] for i, j in active], model)):
            better = [r for r in readings if r[0] > model.margin]
            if better:
                lines[i][j], gain = _accept(lines[i][j], better)
                gains[i] += gain
                changed.append((i, j))
        active = [(i, j) for i, j in changed if not lines[i][j].isascii()]
    return [("\n".join(own), gain) for own, gain in zip(lines, gains)]


def readings_of(lines: list[str], model: Model) -> Iterator[list[tuple[float, int, int, str]]]:
    """(log-odds, start, end, reading) of each line's stretches in their likeliest readings."""
    part, size = [], 0
    for line in [*lines, None]:
        if part and (line is None or size > AT_ONCE):
            yield from _readings_of(part, model)
            part, size = [], 0
        if line is not None:
            part.append(line)
            size += len(line)


def _readings_of(lines: list[str], model: Model) -> list[list[tuple[float, int, int, str]]]:
    framed = [f"\n{line}\n" for line in lines]
    running, starts = model.running(framed)
    number: dict[str, int] = {}
    tried = []
    for k, chains in enumerate(Chains(lines).of_text.tolist()):
        own = []
        if chains:
            for start, end, options in stretches(lines[k], chains):
                if options:
                    before, after = framed[k][start], framed[k][end + 1]
                    own.append((start, end, options, [number.setdefault(before + o + after, len(number)) for o in options]))
        tried.append(own)
    scores = model.scores(list(number)).tolist()
    found = []
    for k, own in enumerate(tried):
        at = int(starts[k])
        best = [(start, end, max((scores[n], o) for n, o in zip(numbers, options))) for start, end, options, numbers in own]
        found.append([(odds - float(running[at + end + 1] - running[at + start]), start, end, reading) for start, end, (odds, reading) in best])
    return found


def lost_odds(texts: list[str], model: Model) -> list[float]:
    """Of each text, how much likelier the likeliest of its runs of lost bytes makes it to be left out; -inf without such."""
    runs = [(i, m.span()) for i, t in enumerate(texts) for m in _LOST_RUN.finditer(t)]
    sides = [((texts[i][a - 1] if a else "\n"), texts[i][a:b], (texts[i][b] if b < len(texts[i]) else "\n")) for i, (a, b) in runs]
    number: dict[str, int] = {}
    pairs = [(number.setdefault(x + run + y, len(number)), number.setdefault(x + y, len(number))) for x, run, y in sides]
    scores = model.scores(list(number))
    found = [-np.inf] * len(texts)
    for (i, _), (whole, without) in zip(runs, pairs):
        found[i] = max(found[i], float(scores[without] - scores[whole]))
    return found


def _accept(text: str, better: list[tuple[float, int, int, str]]) -> tuple[str, float]:
    """The text with the likeliest of its better readings that don't overlap, and what they gain."""
    gain, taken = 0.0, []
    for odds, start, end, reading in sorted(better, reverse=True):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, reading))
            gain += odds
    for start, end, reading in sorted(taken, reverse=True):
        text = text[:start] + reading + text[end:]
    return text, gain


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps, _ = codepoints([t + "\n" for t in texts])
    cps = cps.astype(np.int64)
    return np.bincount(np.minimum(cps, POINTS - 1), minlength=POINTS), np.bincount(_pair(cps[:-1], cps[1:]), minlength=PAIRS)


def train(docs: DataFrame, id_column: str, text_column: str) -> Model:
    """The model of all clean records; those held out for the margin, one in 50 by hash of the id, are counted once it is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {held: (np.zeros(POINTS, np.int64), np.zeros(PAIRS, np.int64)) for held in (False, True)}
        for batch in batches:
            texts = [(t, held) for t, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t]
            texts = [x for x, bad in zip(texts, has_chain([t for t, _ in texts])) if not bad] if texts else []
            for held, (points, pairs) in counts.items():
                if own := [t for t, h in texts if h == held]:
                    p, q = _count(own)
                    points += p
                    pairs += q
        for held, tables in counts.items():
            for kind, table in zip(("point", "pair"), tables):
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array([held] * len(at), pa.bool_()), pa.array([kind] * len(at), pa.string()), pa.array(at), pa.array(table[at])], ["held", "kind", "cell", "n"])

    held = F.pmod(F.xxhash64(id_column, F.lit("held out")), F.lit(50)) == 0
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), held.alias("held"))
    sums = rows.mapInArrow(count, "held boolean, kind string, cell bigint, n bigint").groupBy("held", "kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    tables = {(h, kind): np.zeros(size) for h in (False, True) for kind, size in (("point", POINTS), ("pair", PAIRS))}
    for key, part in sums.groupby(["held", "kind"]):
        tables[key][part["cell"].to_numpy()] = part["n"].to_numpy()
    model = Model(tables[False, "point"].astype(np.float32), tables[False, "pair"].astype(np.float32))
    margin = _validated_margin(rows.where("held").select("text"), model)
    return Model(*((tables[False, kind] + tables[True, kind]).astype(np.float32) for kind in ("point", "pair")), margin)


def garbled_copy(text: str) -> str:
    """The text as a wrong decoder shows it, one of all by the text's hash."""
    raw = text.encode("utf-8", "replace")
    i = zlib.crc32(raw) % len(SINGLE + MULTI)
    if i >= len(SINGLE):
        return raw.decode(MULTI[i - len(SINGLE)], "replace")
    shown = {b: chr(c) for c, b in _tables()[i][1].items()}
    return "".join(chr(b) if b < 0x80 else shown[b] for b in raw)


def errors_by_margin(texts: list[str], model: Model) -> tuple[list[int], int]:
    """Of each margin, in how many of the texts and of their garbled copies `repaired` would err; and how many these are. Texts that aren't clean, and ASCII, don't count."""
    texts = [t for t in texts if t and not t.isascii()]
    clean = [t for t, bad in zip(texts, has_chain(texts)) if not bad] if texts else []
    copies = [garbled_copy(t) for t in clean]
    cases = [(t, False) for t in clean] + [(t, True) for t in copies]
    lines = [(k, line) for k, (t, _) in enumerate(cases) for line in t.split("\n") if not line.isascii()]
    odds = np.full(len(cases), -np.inf)
    for (k, _), readings in zip(lines, readings_of([line for _, line in lines], model)):
        odds[k] = max([odds[k], *(r[0] for r in readings)])
    # A text is changed just if in its first round some reading is beyond the margin.
    odds, bad = np.maximum(odds, lost_odds([t for t, _ in cases], model)), np.array([b for _, b in cases], bool)
    return [int(((odds > margin) != bad).sum()) for margin in MARGINS], len(cases)


def _validated_margin(held_out: DataFrame, model: Model) -> float:
    """The smallest margin that errs least on all held-out clean records and on their garbled copies."""
    shared = held_out.sparkSession.sparkContext.broadcast(model)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cases = np.zeros(len(MARGINS), np.int64), 0
        for batch in batches:
            more, n = errors_by_margin(batch.column(0).to_pylist(), shared.value)
            total, cases = total + more, cases + n
        yield pa.RecordBatch.from_arrays([pa.array(MARGINS), pa.array(total), pa.array([cases] * len(MARGINS))], ["margin", "errors", "cases"])

    sums = held_out.mapInArrow(errors, "margin double, errors bigint, cases bigint").groupBy("margin").agg(F.sum("errors").alias("errors"), F.sum("cases").alias("cases")).collect()
    shared.unpersist()
    return min(((r["errors"], r["margin"]) for r in sums if r["cases"]), default=(0, model.margin))[1]


def repaired(docs: DataFrame, id_column: str, text_column: str, model: Model) -> DataFrame:
    """(id, garbled, restored, log_odds) of every row: whether the text has garbled characters, and its likeliest reading.

    Characters that a decoder gave up on mark a text as garbled, if the model says so, though they can't be restored. Null texts
    come out as not garbled, with a null reading. Equal ids are equal rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            readings = [(None if t is None else r, gain) for t, (r, gain) in zip(texts, restore([t or "" for t in texts], shared.value))]
            lost = lost_odds([t or "" for t in texts], shared.value)
            bad = [t is not None and (gain > 0 or odds > shared.value.margin) for t, (_, gain), odds in zip(texts, readings, lost)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad), pa.array([r for r, _ in readings], pa.string()), pa.array([g for _, g in readings], pa.float64())], [id_column, "garbled", "restored", "log_odds"])

    rows = docs.select(id_column, text_column)
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, garbled boolean, restored string, log_odds double")
