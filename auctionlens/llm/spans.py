"""Exact deduplication of sentence spans across a corpus.

Every run of several consecutive sentences is hashed. Runs that occur again,
anywhere in the corpus, are found by one aggregation; all occurrences but the
first lose the sentences they cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctionlens.llm.common import written

#: A run has so many sentences and words at least, or so many words in fewer sentences.
SENTENCES, MIN_WORDS, LONG_WORDS = 2, 12, 40

#: A sentence ends behind its marks, where white space follows, and at a line's end.
_SENTENCE = re.compile(r"[^\n]*?[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[^\n]+", re.MULTILINE)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence with a word."""
    found = []
    for m in _SENTENCE.finditer(text):
        body = m[0]
        left = len(body) - len(body.lstrip())
        if left < len(body):
            found.append((m.start() + left, m.start() + len(body.rstrip())))
    return found


def runs(
    words: list[int], sentences_: int = SENTENCES, least: int = MIN_WORDS, long: int = LONG_WORDS
) -> list[tuple[int, int]]:
    """(first, last) of the shortest qualified run that begins at each sentence, and that ends at each.

    Both are needed: so a repeated passage is covered from its first sentence to its last.
    """
    n, sums = len(words), np.concatenate(([0], np.cumsum(words)))
    enough = lambda i, j: (j - i >= sentences_ and sums[j] - sums[i] >= least) or sums[j] - sums[i] >= long
    found, j = set(), 0
    for i in range(n):
        j = max(j, i + 1)
        while j <= n and not enough(i, j):
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = n
    for j in range(n, 0, -1):
        i = min(i, j - 1)
        while i >= 0 and not enough(i, j):
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    return sorted(found)


def _hash(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=12).digest()


def text_runs(text: str) -> list[tuple[bytes, int, int]]:
    """(hash, first, last) of the runs of a text; case and white space do not count."""
    bodies = [b" ".join(text[a:b].lower().encode().split()) for a, b in sentences(text)]
    counts = [b.count(b" ") + 1 for b in bodies]
    return [(_hash(b"\n".join(bodies[i:j])), i, j) for i, j in runs(counts)]


def occurrences(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, text_key, first, last) of every run of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for h, i, j in text_runs(text):
                    for column, value in zip(out, (h, doc_id, key, i, j)):
                        column.append(value)
            names = ["hash", "doc_id", "key", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return texts.where("text is not null and doc_id is not null").mapInArrow(rows, "hash binary, doc_id bigint, key bigint, first int, last int")


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, drop): the (first, last) runs to remove, for the documents that lose any.

    The first occurrence of a run is that of the smallest doc_id, then of the
    smallest position. Hot runs are reduced to one row per task before the shuffle
    of the aggregation; the join with the repeated runs alone carries all their
    occurrences, and adaptive execution splits its hot keys.
    """
    found = written(occurrences(docs), "runs")
    place = F.struct("doc_id", "first", "key")
    again = found.groupBy("hash").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    origins = written(again.select("hash", "origin"), "repeated")
    later = found.join(origins, "hash").where(place > F.col("origin"))
    return later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("drop"))


def without(text: str, drop: set[int]) -> tuple[str, int]:
    """The text without some sentences, and the number of words these had; lines that become empty go."""
    spans = sentences(text)
    out, end, lost = [], 0, 0
    for i, (a, b) in enumerate(spans):
        if i in drop:
            lost += len(text[a:b].split())
            gap = text[end:a]
            out.append(gap.rstrip(" \t") if out or end else gap)
            end = b
        else:
            out.append(text[end:b])
            end = b
    kept = "".join([*out, text[end:]])
    return re.sub(r"[ \t]*\n(?:[ \t]*\n)+", "\n", kept).strip(), lost


def deduplicate(docs: DataFrame) -> DataFrame:
    """Adds n_sentences, n_removed and removed_words; ``text`` loses repeated spans, clean texts stay as they are.

    Documents that lose everything stay with an empty text. A null or empty text
    has no sentence. Rows without a doc_id take no part. Rows that repeat a doc_id
    with the same text get the same text. Columns of the three names are replaced.
    """
    added = ("n_sentences", "n_removed", "removed_words")
    docs = docs.drop(*added)
    drops = written(repeated_sentences(docs), "drops").toDF("__id", "__key", "__drop")
    keyed = docs.withColumn("__own", F.xxhash64("text"))
    joined = keyed.join(drops, (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    joined = joined.select(*docs.columns, "__drop")
    columns, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], ([], [], [])
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                total = len(sentences(text or ""))
                gone = {i for run in drop or () for i in range(run["first"], run["last"])}
                text, lost = without(text, gone) if gone else (text, 0)
                texts.append(text)
                for column, value in zip(counts, (total, len(gone), lost)):
                    column.append(value)
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.int64()) for c in counts)], names=names)

    return joined.mapInArrow(rows, schema)


def query(docs: DataFrame) -> DataFrame:
    return deduplicate(docs.select("doc_id", "text"))
