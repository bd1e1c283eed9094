"""Byte-level BPE of a whole corpus with a public tokenizer's vocabulary.

Each task pre-splits its texts into words, cuts words where no vocabulary entry spans two characters, and
keeps a dictionary of the pieces met so far. New pieces go to DuckDB as token-position rows; a recursive
query joins adjacent tokens with the merge table and contracts each piece's leftmost pair of minimum rank
until none is left; an ordered aggregation reads the ids off. A long piece is contracted in parts, which are
joined by contracting what lies around each seam: token sequences in which every two neighbours stay apart
when contracted by themselves are the whole piece's. Nothing is shuffled and no text is cut short.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The folder of the public tokenizers' files.
FOLDER = os.environ.get("LUMENRY_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Texts encoded together, in characters: bounds a task's memory, not what it encodes.
CHUNK = 4_000_000
#: Pieces, and ids of pieces, remembered by a task before its dictionary starts anew.
REMEMBERED, REMEMBERED_IDS = 2_000_000, 30_000_000
#: Bytes of a part of a long piece, and rows that a recursive query may make: they bound memory, not what is encoded.
PART, ROWS = 32, 6_000_000
#: Tokens on either side of a seam that are contracted again, at first.
SEAM = 1

# Fixed value: the vocabulary's published pre-splitting pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# One round: all places of the piece's pair of minimum rank are contracted, from the left and without overlaps. A pair
# that this makes has a higher rank, so it is as if they were contracted one by one.
_ROUND = """
    SELECT piece, round + 1 AS round, pos, (CASE WHEN taken THEN best + 256 ELSE tok END)::INTEGER AS tok
    FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS joined
        FROM (
            SELECT *, rank IS NOT DISTINCT FROM best AND (place - coalesce(max(CASE WHEN rank IS DISTINCT FROM best THEN place END) OVER (PARTITION BY piece ORDER BY pos), 0)) % 2 = 1 AS taken
            FROM (
                SELECT p.piece, p.round, p.pos, p.tok, m.rank, min(m.rank) OVER (PARTITION BY p.piece) AS best, row_number() OVER (PARTITION BY p.piece ORDER BY p.pos) AS place
                FROM (SELECT piece, round, pos, tok, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS following FROM step) p
                LEFT JOIN merges m ON m.pair = (p.tok::BIGINT << 20) + p.following
            )
        )
    )
    WHERE best IS NOT NULL AND NOT joined
"""
_CONTRACT = f"""
WITH RECURSIVE step(piece, round, pos, tok) AS (SELECT piece, 0, pos, tok FROM symbols UNION ALL {_ROUND})
SELECT piece, list(tok ORDER BY pos) AS ids
FROM (SELECT piece, pos, tok, round, max(round) OVER (PARTITION BY piece) AS last FROM step)
WHERE round = last GROUP BY piece ORDER BY piece
"""


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies, by their published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]


class Encoder:
    """Encodes words; one for each Python worker and vocabulary."""

    def __init__(self, folder: str, name: str):
        import duckdb
        import regex

        model = json.loads(open(os.path.join(folder, f"{name}.json"), encoding="utf-8").read())["model"]
        vocabulary, signs = model["vocab"], byte_signs()
        byte_of = {s: b for b, s in enumerate(signs)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary[a + b] != 256 + rank for rank, (a, b) in enumerate(pairs)):
            raise ValueError("the ids of merged tokens must follow the ranks of their merges")
        self.byte_ids = np.array([vocabulary[s] for s in signs], np.int32)
        self.bytes_of = {i: bytes(byte_of[s] for s in token) for token, i in vocabulary.items() if all(s in byte_of for s in token)}
        self.words = regex.compile(WORDS)
        self.spanning = self._spans(self.bytes_of.values())
        self.cuts: dict[str, bool] = {}
        self._forget()
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array([(vocabulary[a] << 20) + vocabulary[b] for a, b in pairs], pa.int64()), "rank": pa.array(range(len(pairs)), pa.int64())})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _remember(self, words: list[str], ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.number.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *ids])

    def _read(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of remembered words in a row."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.begin[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    @staticmethod
    def _spans(tokens: Iterable[bytes]) -> set[tuple[bytes, bytes]]:
        """(up to four bytes before, up to four bytes after) of each character start inside a vocabulary entry."""
        return {(t[max(0, i - 4) : i], t[i : i + 4]) for t in tokens for i in range(1, len(t)) if t[i] & 0xC0 != 0x80}

    def _joined(self, a: str, b: str) -> bool:
        """Whether any vocabulary entry could hold the end of a and the start of b."""
        left, right = a.encode(), b.encode()
        ends = [left[i:] for i in range(len(left))]
        starts = [right[: i + 1] for i in range(len(right))]
        for before, after in self.spanning_by.get((left[-1], right[0]), ()):
            fits_left = before.endswith(left) if len(before) >= len(left) else before in ends
            fits_right = after.startswith(right) if len(after) >= len(right) else after in starts
            if fits_left and fits_right:
                return True
        return False

    @functools.cached_property
    def spanning_by(self) -> dict[tuple[int, int], list[tuple[bytes, bytes]]]:
        found: dict = {}
        for before, after in self.spanning:
            found.setdefault((before[-1], after[0]), []).append((before, after))
        return found

    def pieces(self, word: str) -> list[str]:
        """The word, cut where no entry of the vocabulary reaches across: such parts never merge."""
        if word.isascii():
            return [word]
        found, begin = [], 0
        for i in range(1, len(word)):
            pair = word[i - 1 : i + 1]
            joined = self.cuts.get(pair)
            if joined is None:
                joined = self.cuts[pair] = self._joined(pair[0], pair[1])
            if not joined:
                found.append(word[begin:i])
                begin = i
        found.append(word[begin:])
        return found

    def contract(self, pieces: list[bytes], longest: float = PART) -> list[np.ndarray]:
        """The ids of each piece; those of more than `longest` bytes are contracted in parts."""
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        batch, rows = [], 0
        for i in sorted((i for i, p in enumerate(pieces) if len(p) <= longest), key=lambda i: len(pieces[i])):
            # A piece makes a row for each of its bytes in each round, of which there are as many at most.
            if batch and rows + len(pieces[i]) ** 2 > ROWS:
                self._contract_into(found, batch, pieces)
                batch, rows = [], 0
            batch.append(i)
            rows += len(pieces[i]) ** 2
        self._contract_into(found, batch, pieces)
        long = [i for i, p in enumerate(pieces) if len(p) > longest]
        if long:
            parts = [[p[k : k + PART] for k in range(0, len(p), PART)] for p in (pieces[i] for i in long)]
            flat = iter(self.contract([x for own in parts for x in own]))
            for i, ids in zip(long, self._joined_parts([[next(flat) for _ in own] for own in parts])):
                found[i] = ids
        return found

    def _contract_into(self, found: list[np.ndarray], batch: list[int], pieces: list[bytes]) -> None:
        if not batch:
            return
        raw = [pieces[i] for i in batch]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        symbols = pa.table({
            "piece": pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), lengths)),
            "pos": pa.array((np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32)),
            "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]),
        })
        self.db.register("symbols", symbols)
        if len(raw) == 1 and len(raw[0]) ** 2 > ROWS:
            return self._contract_by_rounds(found, batch[0])
        lists = self.db.sql(_CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("symbols")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, a, b in zip(batch, offsets[:-1], offsets[1:]):
            found[i] = values[a:b]

    def _contract_by_rounds(self, found: list[np.ndarray], piece: int) -> None:
        """The same where a recursive query would keep too many rounds: only the last one is kept."""
        self.db.execute("CREATE OR REPLACE TABLE step AS SELECT piece, 0 AS round, pos, tok FROM symbols")
        while self.db.execute(f"CREATE OR REPLACE TABLE following AS {_ROUND}").fetchone()[0]:
            self.db.execute("DROP TABLE step; ALTER TABLE following RENAME TO step")
        found[piece] = self.db.sql("SELECT tok FROM step ORDER BY pos").fetchnumpy()["tok"].astype(np.int32)
        self.db.execute("DROP TABLE step; DROP TABLE following")
        self.db.unregister("symbols")

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[int(i)] for i in ids)

    def _joined_parts(self, pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        """The ids of pieces given as those of their parts: neighbouring parts are joined, then neighbours of these, and so on."""
        while any(len(own) > 1 for own in pieces):
            seams = [(n, k) for n, own in enumerate(pieces) for k in range(0, len(own) - 1, 2)]
            joined: dict[tuple[int, int], np.ndarray] = {}
            width = SEAM
            while seams:
                sides = [(pieces[n][k][-width:], pieces[n][k + 1][:width]) for n, k in seams]
                again = self.contract([self._text(a) + self._text(b) for a, b in sides], np.inf)
                left = []
                for (n, k), (a, b), ids in zip(seams, sides, again):
                    before, after = pieces[n][k], pieces[n][k + 1]
                    # The outermost tokens must come out as they were, or be the part's own ends.
                    if (len(a) == len(before) or ids[0] == a[0]) and (len(b) == len(after) or ids[-1] == b[-1]):
                        joined[n, k] = np.concatenate([before[: len(before) - len(a)], ids, after[len(b) :]])
                    else:
                        left.append((n, k))
                seams, width = left, 4 * width
            pieces = [[joined[n, k] if (n, k) in joined else own[k] for k in range(0, len(own), 2)] for n, own in enumerate(pieces)]
        return [own[0] for own in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's ids."""
        if len(self.number) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
        split = [self.words.findall(t) for t in texts]
        fresh = set(itertools.chain.from_iterable(split)).difference(self.number)
        cut = {w: self.pieces(w) for w in fresh}
        unmerged = list({p for parts in cut.values() for p in parts}.difference(self.number))
        self._remember(unmerged, self.contract([p.encode("utf-8", "surrogatepass") for p in unmerged]))
        rest = [w for w, parts in cut.items() if len(parts) > 1]
        self._remember(rest, [self._read(np.array([self.number[p] for p in cut[w]])) for w in rest])
        words = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, words.sum())
        ends = np.concatenate([[0], np.cumsum(self.size[numbers])])
        upto = np.cumsum(words)
        return self._read(numbers), ends[upto] - ends[upto - words]


@functools.cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, id_column: str, text_column: str, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens, whose strings count as ordinary text.

    An empty and a null text get an empty list. Rows stay as they are: repeated ids give repeated rows. Only
    the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(folder, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids, counts = tool.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [id_column, "ids"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, id_column: str, text_column: str, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of token ids of each text; 0 for an empty and a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(folder, name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tool.encode(texts[a:b])[1])], [id_column, "tokens"])

    rows = df.select(id_column, text_column)
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, tokens bigint")


def decode(df: DataFrame, id_column: str, ids_column: str, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """(id, text): the text of each list of token ids; bytes that are no UTF-8 come out as U+FFFD.

    A null list, and one with an id that the vocabulary doesn't have, gives null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(folder, name).bytes_of
        for batch in batches:
            texts = [None if ids is None or not all(i in known for i in ids) else b"".join(map(known.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    rows = df.select(id_column, ids_column)
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, text string")
