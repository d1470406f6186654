"""Helpers of the corpus operators: tables in the shared folder, words and word hashes of whole Arrow columns."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are hashed at a time; a longer text is taken whole.
CHUNK_BYTES = 1 << 20
#: A word is a run of bytes other than these: blank, and tab to carriage return.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one below the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_llm").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cut lineage that outlives executors, with a size Spark knows."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(seed)) | np.uint64(1)


def byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit code for each byte; with ``lower``, A to Z have those of a to z."""
    codes = multipliers(256, 11)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a chunk."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~BLANKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~edge
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(np.concatenate(([False], word[:-1])) & (edge | ~word))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a polynomial in the codes of its bytes."""
    powers = np.full(len(data) + 1, _STEP, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers[:-1], out=sums[1:])
    powers.fill(_INVERSE)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def term_table(letters_only: bool) -> bytes:
    """Byte translation to terms: A to Z in lower case; ASCII bytes but letters (and digits) to blanks; others as they are."""
    inside = lambda c: c >= 128 or chr(c).isalpha() or (chr(c).isdigit() and not letters_only)
    return bytes((c + 32 if 65 <= c <= 90 else c) if inside(c) else 32 for c in range(256))


def term_counts(text: bytes | None, table: bytes) -> Counter:
    """How often each term occurs in a whole text; a long one is split a chunk at a time."""
    counts: Counter = Counter()
    data = (text or b"").translate(table)
    first = 0
    while first < len(data):
        last = len(data) if len(data) - first <= 2 * CHUNK_BYTES else data.find(b" ", first + CHUNK_BYTES)
        last = len(data) if last < 0 else last
        counts.update(data[first:last].split())
        first = last
    return counts


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of integer weights, for each of ``n`` rows."""
    return np.bincount(rows, weights, n).astype(np.int64)
