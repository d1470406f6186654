"""Packing by retrieval: a window is filled with the documents that a lexical index finds nearest to its seed.

The index is sharded: documents are dealt at random to shards of bounded size, and
each shard has its own BM25 index over token ids. A shard packs greedily: the
longest unused document is the seed of a window, its unused neighbours follow,
best first, and the one that no longer fits is cut; what is left of it stays in
the index. So all windows but a shard's last are full. The last one's tokens go to
sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END_ID = 1
#: Documents of a shard, about.
SHARD = 2048
#: BM25: how fast repeats of a term saturate, and how much length counts.
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's documents tell nothing apart and are not indexed.
COMMON = 0.25
#: The splitting rule of the byte-level vocabulary, a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of a text by a byte-level vocabulary file.

    Where the file's merges are in the order of their ids, as byte-level vocabularies
    have them, the ids come from the ranks alone, which is several times faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._by_ranks(path)

    def _by_ranks(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, splits = whole["model"], whole["pre_tokenizer"] or {}
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        if model["type"] != "BPE" or whole["normalizer"] or not plain:
            return None
        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # The byte-level alphabet: visible bytes stand for themselves, the others for characters from 256 on.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        byte = {chr(b if b in visible else next(hidden)): b for b in range(256)}
        if made != sorted(set(made)) or len(made) + 256 != len(set(vocab) - set(self.special)):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("by_ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def of_text(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def tokenised(docs: DataFrame, path: str, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows for the shards: full windows of long documents without ids, and what is left of every document with its ids.

    A row's place in the input, not what it holds, decides its shard, so copies and equal ids spread.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(path)
        end = np.array([END_ID], "<u4")
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()):
                ids = np.concatenate([known.of_text(text), end])
                shard = _spread(place) % shards
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].tobytes()
                    full = len(part) == 4 * capacity
                    values = (doc_id, start, len(part) // 4, zlib.crc32(part), len(ids), place, shard, None if full else part)
                    for column, value in zip(out, values):
                        column.append(value)
                place += 1
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, "place", "shard", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"{PIECE}, place bigint, shard bigint, ids binary")


def _spread(place: int) -> int:
    x = (place ^ (place >> 31)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 20


class Index:
    """BM25 over the ids of a shard's documents."""

    def __init__(self, ids: list[np.ndarray]):
        self.n = len(ids)
        counted = [np.unique(x, return_counts=True) for x in ids]
        sizes = np.array([len(t) for t, _ in counted])
        doc = np.repeat(np.arange(self.n), sizes)
        terms, term = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True)
        tf = np.concatenate([c for _, c in counted]).astype(float)
        length = np.array([len(x) for x in ids], float)
        df = np.bincount(term, minlength=len(terms))
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        # A term of one document has no neighbours to offer, a common one has all.
        useful = (df > 1) & (df <= max(2, COMMON * self.n))
        self.own = [t[useful[t]] for t in np.split(term, np.cumsum(sizes)[:-1])]
        order = np.argsort(term, kind="stable")
        at = np.concatenate(([0], np.cumsum(df)))
        self.docs, self.gain = doc[order], gain[order]
        self.spans = [slice(a, b) for a, b in zip(at[:-1], at[1:])]

    def scores(self, seed: int) -> np.ndarray:
        spans = [self.spans[t] for t in self.own[seed]]
        if not spans:
            return np.zeros(self.n)
        docs = np.concatenate([self.docs[s] for s in spans])
        return np.bincount(docs, np.concatenate([self.gain[s] for s in spans]), self.n)


def fill(lengths: np.ndarray, index: Index, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first, length): a seed and its unused neighbours, best first, the last one cut to fit."""
    left, first = lengths.copy(), np.zeros(len(lengths), np.int64)
    unused = left > 0
    for seed in np.argsort(-lengths, kind="stable"):
        # A seed is the longest unused document; one that was cut waits for its turn by its first length.
        if not unused[seed]:
            continue
        window, room, near, at = [], capacity, None, int(seed)
        while True:
            n = min(room, int(left[at]))
            window.append((at, int(first[at]), n))
            first[at] += n
            left[at] -= n
            room -= n
            unused[at] = left[at] > 0
            if not room:
                break
            if near is None:
                near = np.where(unused, index.scores(int(seed)), -1.0)
            near[at] = -1.0
            at = int(near.argmax())
            if near[at] < 0:
                break
        yield window


def powers(length: int) -> list[int]:
    """The powers of two that add up to ``length``, largest first."""
    return [1 << i for i in reversed(range(length.bit_length())) if length >> i & 1]


def pack_shard(table: pa.Table, capacity: int = CAPACITY) -> Iterator[tuple]:
    """(row, first, length, sequence, offset) of every piece; sequences are numbered from 0 within the shard."""
    lengths = table["length"].to_numpy()
    whole = table["ids"].is_null().to_numpy()
    sequence = 0
    for row in np.flatnonzero(whole):
        yield int(row), 0, int(lengths[row]), sequence, 0
        sequence += 1
    rest = np.flatnonzero(~whole)
    if not len(rest):
        return
    ids = [np.frombuffer(x, "<u4") for x in table["ids"].take(pa.array(rest)).to_pylist()]
    for window in fill(lengths[rest], Index(ids), capacity):
        sizes = [capacity] if sum(n for *_, n in window) == capacity else powers(sum(n for *_, n in window))
        offset = 0
        for at, first, n in window:
            while n:
                part = min(n, sizes[0] - offset)
                yield int(rest[at]), first, part, sequence, offset
                first, n, offset = first + part, n - part, offset + part
                if offset == sizes[0]:
                    sequence, offset = sequence + 1, 0
                    sizes.pop(0)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    A document is the ids of its text and ``END_ID``; a null text is empty. One that
    is longer than ``capacity`` fills windows alone, what remains is packed with
    neighbours. Rows that repeat a doc_id, or have none, are packed each for itself.
    Other columns are not read. An empty table gives no rows.
    """
    path = path or tokenizer_path()
    shards = max(1, -(-docs.count() // shard))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("start", "ascending")])
        row, first, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pack_shard(table, capacity)))
        ids = table["ids"].to_pylist()
        sums = table["ids_crc32"].to_numpy().copy()[row]
        for i, (r, a, n) in enumerate(zip(row, first, length)):
            if ids[r] is not None:
                sums[i] = zlib.crc32(ids[r][4 * a : 4 * (a + n)])
        taken = table.select(["doc_id", "doc_tokens"]).take(pa.array(row))
        start = table["start"].to_numpy()[row] + first
        sequence += key[0].as_py() << 32
        columns = [taken["doc_id"], start, length, sums, taken["doc_tokens"], sequence, offset]
        return pa.table(columns, names=[*NAMES, "sequence_id", "offset"])

    rows = tokenised(docs, path, shards, capacity)
    return rows.groupBy("shard").applyInArrow(packed, f"{PIECE}, sequence_id bigint, offset bigint")
