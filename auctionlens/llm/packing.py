"""Packing of tokenised documents into sequences by the configuration linear program.

Only lengths matter: the histogram of piece lengths, with at most one entry per
length up to the capacity, goes to the driver. There the configuration program
(minimise the number of sequences over all multisets of lengths that fit) is
solved by multiplicative weights over size classes: dual prices fall as a class
gets covered, and a knapsack dynamic program prices the best configuration. The
fractional solution is rounded down; the room it leaves is filled, and the bounded
rest packed, best fit. What results is a short list of runs (length, ranks, first
sequence, place), by which Spark assigns every piece through its rank within its
length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.llm.common import written

CAPACITY = 4096
END_ID = 1
#: Size classes of the program: lengths are rounded up to a 256th of the capacity.
GRID = 256
#: Most rounds of multiplicative weights, the largest step of a class, and how fast prices fall.
ROUNDS, STEP, SHARPNESS = 4000, 0.1, 8.0
#: Pieces that are ranked in one task at most, about.
RANK_ROWS = 50_000
#: Pieces whose ids a task remembers at most.
CACHE = 300_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Ids(dict):
    """Packed ids of the pieces into which the tokenizer splits a normalised text, learned as they come."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet: visible bytes stand for themselves, the others for characters from 256 on.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.alphabet = [chr(b if b in visible else next(hidden)) for b in range(256)]

    def _packed(self, piece: str) -> bytes:
        mapped = "".join([self.alphabet[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped)])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if piece.isascii() or piece.isalpha():
            ids = self._packed(piece)
        else:  # numerals that are no decimal digits stand alone
            ids = b"".join(map(self._packed, _LETTERS_OR_NUMERAL.findall(piece)))
        self[piece] = ids
        return ids

    def of_text(self, text: str) -> np.ndarray:
        if any(x in text for x in (*self.special, *_UNLIKE)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return np.frombuffer(b"".join(map(self.__getitem__, _PIECE.findall(text.lower()))), "<u4")


#: What Python and the tokenizer treat unlike, by white space or by lower case.
_UNLIKE = "\x1c\x1d\x1e\x1f\x85\u180e\u03a3"
#: The tokenizer's splitting rule for lower-case text; letters come with numerals that are no decimal digits.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_LETTERS_OR_NUMERAL = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and checksum of the ids of every piece of every document.

    A document is the ids of its text and ``END_ID``; a null text is empty. Only
    one that is longer than ``capacity`` is cut.
    """
    path = path or tokenizer_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).fill_null("").to_pylist()
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                ids = np.concatenate([known.of_text(text), end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES)


def best_configuration(prices: np.ndarray) -> dict[int, int]:
    """Class: multiplicity of the dearest multiset of size classes that fits, by the unbounded knapsack recurrence.

    Class i takes i + 1 units of the GRID units of a sequence.
    """
    value, choice = np.zeros(GRID + 1), np.full(GRID + 1, -1, np.int64)
    for size in range(1, GRID + 1):
        gain = value[size - 1 :: -1] + prices[:size]
        best = int(gain.argmax())
        value[size] = value[size - 1]
        if gain[best] > value[size]:
            value[size], choice[size] = gain[best], best
    used: dict[int, int] = {}
    size = GRID
    while size > 0:
        i = int(choice[size])
        if i >= 0:
            used[i] = used.get(i, 0) + 1
        size -= i + 1 if i >= 0 else 1
    return used


def fractional(counts: np.ndarray) -> dict[tuple, float]:
    """An approximate solution of the configuration program: how often each configuration is used.

    ``counts`` has the pieces of each size class. Prices fall with the share of a
    class that is covered, by multiplicative weights; each round uses the
    configuration that is dearest at these prices, in a step by which no class
    gains more than STEP of its pieces or more than it still needs.
    """
    covered = np.where(counts > 0, 0.0, 1.0)
    used: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = np.where(open_, np.exp(-SHARPNESS * (covered - covered[open_].min())) * np.arange(1, GRID + 1), 0.0)
        config = best_configuration(prices)
        at, times = np.array(list(config)), np.array(list(config.values()))
        amount = float((np.minimum(STEP, 1 - covered[at]) * counts[at] / times).min())
        covered[at] += amount * times / counts[at]
        key = tuple(sorted(config.items(), reverse=True))
        used[key] = used.get(key, 0.0) + amount
    return used


class _Plan:
    """Runs of equal sequences in the making; ``left`` and ``taken`` are by index into the sorted lengths."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.left, self.capacity = lengths, counts.copy(), capacity
        self.taken = np.zeros(len(counts), np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.open: list[tuple[int, int, int]] = []  # first sequence, sequences, tokens in each
        self.sequences = 0

    def put(self, parts: list[tuple[int, int]], first: int, times: int, place: int) -> int:
        for i, n in parts:
            self.runs.append((int(self.lengths[i]), int(self.taken[i]), n * times, first, n, place))
            self.taken[i] += n * times
            self.left[i] -= n * times
            place += n * int(self.lengths[i])
        return place

    def of_class(self, own: np.ndarray, n: int) -> list[tuple[int, int]]:
        """``n`` pieces of a class, the longest first; of one length where it has enough."""
        parts = []
        for i in own[::-1]:
            if n and self.left[i]:
                parts.append((int(i), min(n, int(self.left[i]))))
                n -= parts[-1][1]
        return parts

    def use(self, config: tuple, times: int, classes: list[np.ndarray]) -> None:
        times = min([times, *(int(self.left[classes[c]].sum()) // n for c, n in config)])
        while times > 0:
            parts = [p for c, n in config for p in self.of_class(classes[c], n)]
            alike = min([times, *(int(self.left[i]) // n for i, n in parts)])
            self.open.append((self.sequences, alike, self.put(parts, self.sequences, alike, 0)))
            self.sequences += alike
            times -= alike

    def best_fit(self) -> None:
        """Fills the room that is left, then new sequences, always with the longest piece that fits."""
        todo = sorted(self.open, key=lambda x: x[2])
        while self.left.any():
            if not todo:
                todo.append((self.sequences, 0, 0))
            first, times, place = todo.pop()
            fits = np.flatnonzero(self.left[: np.searchsorted(self.lengths, self.capacity - place, "right")])
            if not len(fits):
                continue
            i = int(fits[-1])
            n = min((self.capacity - place) // int(self.lengths[i]), int(self.left[i]))
            alike = int(self.left[i]) // n
            if times == 0:  # new sequences
                times = alike
                self.sequences += alike
            alike = min(alike, times)
            if alike < times:
                todo.append((first + alike, times - alike, place))
            todo.append((first, alike, self.put([(i, n)], first, alike, place)))


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, ranks, first sequence, pieces per sequence, place), sorted by length and rank."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    of = -(-lengths * GRID // capacity) - 1  # the size class, rounded up
    classes = [np.flatnonzero(of == c) for c in range(GRID)]
    made = _Plan(lengths, counts, capacity)
    if len(lengths):
        solution = fractional(np.array([counts[own].sum() for own in classes], float))
        for config, amount in sorted(solution.items(), key=lambda x: -x[1]):
            made.use(config, int(amount + 1e-9), classes)
        made.best_fit()
    return np.array(sorted(made.runs), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are written once as they are read several times."""
    cut = written(cut, "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row per length, at most capacity
    runs = plan(np.array([r.length for r in histogram]), np.array([r.n for r in histogram]), capacity)
    blocks = max(1, sum(r.n for r in histogram) // RANK_ROWS)
    # The rank within a length: first over the blocks of a length, then within a block.
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).alias("block")
    placed = cut.select("*", block)
    before = (
        placed.groupBy("length", "block").agg(F.count("*").alias("n"))
        .withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = placed.withColumn("within", within - 1).join(before, ["length", "block"])
    ranked = ranked.select(*cut.columns, (F.col("first") + F.col("within")).alias("rank"))
    base = np.searchsorted(runs[:, 0], np.arange(capacity + 2))  # first run of each length
    columns = cut.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own, at = runs[base[size] : base[size + 1]], np.flatnonzero(length == size)
                run = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
                index = rank[at] - run[:, 1]
                sequence[at] = run[:, 3] + index // run[:, 4]
                offset[at] = run[:, 5] + index % run[:, 4] * size
            kept = [batch.column(x) for x in columns]
            names = [*columns, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(assign, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    A null text is empty and is one piece of one id. Rows that repeat a doc_id, or
    have none, are packed each for itself. Other columns are not read.
    """
    return pack(pieces(docs, path, capacity), capacity)
