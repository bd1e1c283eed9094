"""A phrase lexicon learned from labelled spans, and its greedy application to texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_text
from ..sources.tables import cut_lineage

#: Signs of the shortest beginning of a phrase that texts are filtered by.
ANCHOR = 4
#: Phrases, and their signs, of a lexicon that every task may hold; a larger one is joined.
HELD, HELD_SIGNS = 100_000, 4_000_000
#: Bits a phrase, and the logarithm of the most bits, of the filter for texts of a larger one.
BITS, MOST_LOG = 64, 28
#: Signs of texts that are filtered at once, or one text.
PIECE = 1 << 20
SPANS = "array<struct<start:int,end:int,type:string>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
_BASE = 0x9E3779B97F4A7C15


def train(spans: DataFrame) -> DataFrame:
    """(phrase, type) of rows (phrase, type): the commonest type of each phrase, the largest name on ties."""
    counted = spans.select(key_text(F.col("phrase")).alias("phrase"), "type").where("phrase <> '' and type is not null").groupBy("phrase", "type").agg(F.count("*").alias("n"))
    return counted.groupBy("phrase").agg(F.max_by("type", F.struct("n", "type")).alias("type"))


def label_counts(spans: DataFrame) -> DataFrame:
    return spans.where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


def top_label(spans: DataFrame, order: str) -> DataFrame:
    """(type, n): the commonest type, the one seen first by `order` on ties; no row for no spans."""
    seen = spans.where("type is not null").groupBy("type").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return seen.orderBy(F.desc("n"), "first", "type").limit(1).select("type", "n")


def save(lexicon: DataFrame, path: str) -> None:
    lexicon.select("phrase", "type").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """A stored lexicon; an empty one where there is none, or what is there has other columns."""
    try:
        if path:
            return spark.read.parquet(path).select("phrase", "type")
    except AnalysisException:
        pass
    return spark.createDataFrame([], "phrase string, type string")


def predict(docs: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, spans): of each text the phrases' occurrences, longest first, without overlaps. All rows come out, a null text with none.

    A lexicon of a checked size goes to every task, which reads each text once with an automaton of all phrases;
    nothing is shuffled. Of a larger one, which grows with the data, every task holds a filter of bounded size, and
    what passes it is joined.
    """
    entries = lexicon.where("phrase <> ''").select("phrase", "type")
    held = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("signs")).first()
    if held["n"] <= HELD and held["signs"] <= HELD_SIGNS:
        return by_automaton(docs, key, {r["phrase"]: r["type"] for r in entries.collect()})
    return by_join(docs, key, entries)


def by_automaton(docs: DataFrame, key: str, phrases: dict[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in shared.value:
            automaton.add_word(phrase, phrase)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for low in batch.column("low").to_pylist():
                last: dict[str, int] = {}
                hits = []
                for end, phrase in automaton.iter(low) if low and shared.value else ():
                    start = end + 1 - len(phrase)
                    if start >= last.get(phrase, 0):  # occurrences of one phrase don't overlap
                        last[phrase] = end + 1
                        hits.append((-len(phrase), phrase, start))
                taken = _without_overlaps(hits, len(low or ""))
                found.append([{"start": a, "end": a + len(p), "type": shared.value[p]} for a, p in taken])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _KIND)], [key, "spans"])

    rows = docs.select(key, F.lower("text").alias("low"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, spans {SPANS}")


def _without_overlaps(hits: list[tuple[int, str, int]], size: int) -> list[tuple[int, str]]:
    """(start, phrase), sorted, of hits taken in order, each unless a sign of it is taken."""
    taken, used = [], bytearray(size)
    for _, phrase, start in sorted(hits):
        # What was taken before is no shorter, so it covers an end of what it overlaps.
        if not used[start] and not used[start + len(phrase) - 1]:
            used[start : start + len(phrase)] = b"\x01" * len(phrase)
            taken.append((start, phrase))
    return sorted(taken)


class _Runs:
    """Hashes of runs of signs of a text: sums of signs times powers of a base, equal for equal runs wherever they stand."""

    def __init__(self, text: str):
        self.signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        power = lambda b: np.cumprod(np.full(len(self.signs), b, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.signs + np.uint64(1)) * power(_BASE))])
        self.back = power(pow(_BASE, -1, 1 << 64))

    def bits(self, at: np.ndarray, n: int, whole: bool, log: int) -> np.ndarray:
        """Bits of a filter of 2 ** log for the runs of n signs at these places, as phrases or as beginnings of phrases."""
        x = (self.sums[at + n] - self.sums[at]) * self.back[at] + np.uint64(2 * n + whole)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - log)).astype(np.int64)


def _steps(n: int) -> list[int]:
    """Sizes of the beginnings by which phrases of n signs are found."""
    return [ANCHOR << k for k in range(n.bit_length()) if ANCHOR << k <= n]


def _filter(entries: DataFrame, log: int) -> np.ndarray:
    """Bytes of the filter of all phrases and their beginnings. Only whole parts of it reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(0).to_pylist()
            sizes = np.array([len(p) for p in phrases], np.int64)
            runs, starts = _Runs("".join(phrases)), np.cumsum(sizes) - sizes
            found = [runs.bits(starts[sizes >= n], n, False, log) for n in _steps(int(sizes.max(initial=0)))]
            found += [runs.bits(starts[sizes == n], n, True, log) for n in np.unique(sizes).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *found])))], ["bit"])

    # The SQL functions number bits from 1, and parts of 4096 bytes.
    bit = F.col("bit") + 1
    parts = entries.select("phrase").mapInArrow(bits, "bit bigint").groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bytes"))
    whole = np.zeros(1 << (log - 3), np.uint8)
    for r in parts.toLocalIterator():
        whole[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bytes"], np.uint8)
    return whole


def by_join(docs: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """Texts are scanned once, against a filter of the phrases and of their beginnings of 4, 8, 16 and more signs. The runs of
    signs that pass, hardly more than occur, are joined with the phrases on equality; no text is shuffled."""
    entries = cut_lineage(entries)
    counts = {r["size"]: r["n"] for r in entries.groupBy(F.length("phrase").alias("size")).agg(F.count("*").alias("n")).collect()}
    log = min(MOST_LOG, max(15, (BITS * sum(counts.values())).bit_length()))
    shared, sizes = docs.sparkSession.sparkContext.broadcast(_filter(entries, log)), sorted(counts)

    def passing(runs: _Runs, at: np.ndarray, room: np.ndarray, n: int, whole: bool) -> np.ndarray:
        at = at[room[at] >= n]
        bits = runs.bits(at, n, whole, log)
        return at[(shared.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("low").to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            a = 0
            while a < len(texts):
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + PIECE, "right")))
                own, starts = texts[a:b], np.concatenate([[done], ends[a : b - 1]]) - done
                runs = _Runs("".join(own))
                text_of = np.repeat(np.arange(b - a), np.diff(np.append(starts, ends[b - 1] - done)))
                room = (ends[a:b] - done)[text_of] - np.arange(len(text_of))
                at, step, found = np.arange(len(text_of)), 0, []
                for n in sizes:
                    for step in [s for s in _steps(n) if s > step]:
                        at = passing(runs, at, room, step, False)
                    found.append((passing(runs, at, room, n, True), n))
                place = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in found)])
                size = np.repeat([n for _, n in found], [len(p) for p, _ in found])
                of = text_of[place]
                start = place - starts[of]
                phrases = [own[t][s : s + n] for t, s, n in zip(of.tolist(), start.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + a)), pa.array(phrases, pa.string()), pa.array(start, pa.int32())], [key, "phrase", "start"])
                a = b

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column("hits").to_pylist():
                last: dict[str, int] = {}
                types: dict[str, str] = {}
                hits = []
                for hit in sorted(row, key=lambda h: h["start"]):
                    phrase, start = hit["phrase"], hit["start"]
                    if start >= last.get(phrase, 0):  # occurrences of one phrase don't overlap
                        last[phrase], types[phrase] = start + len(phrase), hit["type"]
                        hits.append((-len(phrase), phrase, start))
                taken = _without_overlaps(hits, max(last.values()))
                found.append([{"start": a, "end": a + len(p), "type": types[p]} for a, p in taken])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _KIND)], [key, "spans"])

    texts = docs.where("text is not null").select(key, F.lower("text").alias("low"))
    kind = texts.schema[key].dataType.simpleString()
    hits = texts.mapInArrow(scan, f"`{key}` {kind}, phrase string, start int").join(entries, "phrase")
    chosen = hits.groupBy(key).agg(F.collect_list(F.struct("start", "phrase", "type")).alias("hits")).mapInArrow(choose, f"`{key}` {kind}, spans {SPANS}")
    return docs.select(key).join(chosen, key, "left").select(key, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
