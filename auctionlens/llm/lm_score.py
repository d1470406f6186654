"""Language-model scores from a log-frequency Bloom filter.

Training counts words and word pairs. The filter holds a pair's or a word's count
as a level of a geometric scale: all levels up to its own are members, so the count
is read back by probing level after level until one is missing. The filter is built
in segments by hash, gathered into slabs of bounded size, and broadcast to the
workers slab by slab. One pass over the texts reads the levels of all words and
pairs and keeps them, a byte each. The weights of the interpolated pair model are
learned, and all documents scored by the one model, from these bytes.

Beside it stands the exact unigram base: frequent words from a list of fixed
length, all others by a join with the whole table of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.llm.common import byte_codes, mix, multipliers, text_chunks, word_hashes, word_spans, written

FOLDS, HELD_OUT, ALPHA = 10, 0, 0.1
#: Words in the list of fixed length, which travels with the scoring function.
HEAD = 65_536
#: Text bytes for each segment of the filter, and bytes of a slab that is broadcast.
SEGMENT_BYTES, SLAB_BYTES = 4 << 20, 64 << 20
#: Members cost so many bits, and are so many bits of one 64-bit word: 1 to 2 % false positives a level.
BITS, PROBES = 12, 4
#: Tokens that are counted, or scored, together, and keys that are probed together, few enough for the cache.
COUNTED, SCORED, PROBED = 2_000_000, 500_000, 1 << 15
#: The scale of counts: whole numbers that grow by a quarter.
LEVELS = np.array([*range(6), *(round(6 * 1.25**i) for i in range(100))])

_END, _BEGIN = multipliers(2, 51)
_WORD, _FIRST, _SECOND, _LEVEL, _AGAIN = multipliers(5, 52)
_KEY = np.uint64((1 << 48) - 1)


def streams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, tokens per row): the word hashes of each row, lower-cased, and one end each."""
    codes = byte_codes(lower=True)
    for first, data, offsets in text_chunks(texts):
        starts, ends, rows = word_spans(data, offsets)
        size = np.bincount(rows, minlength=len(offsets) - 1) + 1
        tokens = np.full(int(size.sum()), _END)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(size) - 1] = False
        tokens[inner] = word_hashes(data, starts, ends, codes)
        yield first, tokens, size


def histories(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(size) - size] = _BEGIN
    return before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _FIRST + tokens * _SECOND)


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens * _WORD)


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, back): one place of every different key, and for each key the number of its place.

    Keys meet in a table by some of their bits; only those that meet another key there are sorted.
    """
    all_, slot = np.arange(len(keys), dtype=np.int32), keys >> np.uint64(44)
    table = np.empty(1 << 20, np.int32)
    table[slot] = all_
    place = table[slot]
    rest = np.flatnonzero(keys[place] != keys)
    _, first, group = np.unique(keys[rest], return_index=True, return_inverse=True)
    place[rest] = rest[first][group]
    some = np.flatnonzero(place == all_)
    number = np.empty(len(keys), np.int32)
    number[some] = np.arange(len(some), dtype=np.int32)
    return some, number[place]


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right") - 1


def spread(keys: np.ndarray, level: int) -> np.ndarray:
    """64 bits for each (key, level): the upper half chooses the word, lower ones its bits."""
    return mix((keys & _KEY) * _LEVEL + np.array([level], np.uint64) * _AGAIN)


def word_of(x: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    """The word of a segment of fewer than 2 ** 32."""
    return ((x >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)).astype(np.int64)


def bits_of(x: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield x >> np.uint64(6 * i) & np.uint64(63)


def build_segment(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter bytes of keys with their levels."""
    words = max(1, -(-int(levels.sum()) * BITS // 64))
    hit = np.zeros(64 * words, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        x = spread(keys[levels >= level], level)
        base = word_of(x, words) * 64
        for bit in bits_of(x):
            hit[base + bit.astype(np.int64)] = True
    return np.packbits(hit, bitorder="little")


def read_levels(keys: np.ndarray, slab: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The level of each key by repeated membership probes; start and words are its segment's place in the slab."""
    level, active = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    for step in range(1, len(LEVELS)):
        x = spread(keys, step)
        found, mask = slab[start + word_of(x, words)], np.zeros(len(x), np.uint64)
        for bit in bits_of(x):
            mask |= np.uint64(1) << bit
        member = np.flatnonzero(found & mask == mask)
        active, keys, start, words = active[member], keys[member], start[member], words[member]
        level[active] = step
        if not len(active):
            break
    return level


def _folded(batch: pa.RecordBatch) -> np.ndarray:
    """Null ids count as training documents."""
    return batch.column(1).fill_null(HELD_OUT + 1).to_numpy(zero_copy_only=False)


def _counted(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(pieces), return_counts=True) if pieces else (np.zeros(0, np.uint64), np.zeros(0, int))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): exact counts of the training tokens, words by their 64-bit hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words, n = _counted(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            learn = _folded(batch) % FOLDS != HELD_OUT
            for first, tokens, size in streams(batch.column(2)):
                held.append(tokens[np.repeat(learn[first : first + len(size)], size)])
                if sum(map(len, held)) > COUNTED:
                    yield out()
        yield out()

    counted = docs.select("doc_id", "fold", "text").mapInArrow(rows, "word bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, segments: int) -> DataFrame:
    """(segment, once, often, n): packed 48-bit keys of pairs, of one task's share, that it saw once or more often."""
    packed = lambda keys: np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = _counted(held)
            held.clear()
            own = segment_of(keys, segments)  # keys are sorted, and so are their segments
            ids, starts = np.unique(own, return_index=True)
            columns: list[list] = [[], [], [], []]
            for s, a, b in zip(ids, starts, [*starts[1:], len(keys)]):
                k, c = keys[a:b], n[a:b]
                for column, x in zip(columns, (int(s), packed(k[c == 1]), packed(k[c > 1]), c[c > 1].astype("<u4").tobytes())):
                    column.append(x)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            names = ["segment", "once", "often", "n"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            learn = _folded(batch) % FOLDS != HELD_OUT
            for first, tokens, size in streams(batch.column(2)):
                use = np.repeat(learn[first : first + len(size)], size)
                held.append(pair_keys(histories(tokens, size), tokens)[use])
                if sum(map(len, held)) > COUNTED:
                    yield out()
        yield out()

    return docs.select("doc_id", "fold", "text").mapInArrow(rows, "segment int, once binary, often binary, n binary")


def segments_of(pairs: DataFrame, words: DataFrame, segments: int) -> DataFrame:
    """(segment, filter): the filter bytes of all words and all pairs with their counts."""
    unpacked = lambda column: np.pad(
        np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 6), ((0, 0), (0, 2))
    ).view("<u8").ravel()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            keys = word_keys(words_.view(np.uint64))
            columns = [pa.array(segment_of(keys, segments).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "key", "n"])

    def build(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        once, often = unpacked(left["once"]), unpacked(left["often"])
        n = np.frombuffer(b"".join(left["n"].to_pylist()), "<u4").astype(np.int64)
        keys, at = np.unique(np.concatenate([once, often]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(once)), n]), len(keys)).astype(np.int64)
        word = right["key"].to_numpy().view(np.uint64)
        levels = np.concatenate([level_of(total), level_of(right["n"].to_numpy())])
        bits = build_segment(np.concatenate([keys, word]), levels)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([bits.tobytes()], pa.binary())})

    own = words.mapInArrow(keyed, "segment int, key bigint, n bigint")
    return pairs.groupBy("segment").cogroup(own.groupBy("segment")).applyInArrow(build, "segment int, filter binary")


class Filter:
    """The slabs of the filter, broadcast one by one, and where in them each segment lies."""

    def __init__(self, segments: DataFrame, n: int):
        self.slab, self.start, self.words = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, np.int64)
        self.slabs, held, size = [], [], 0
        context = segments.sparkSession.sparkContext
        for row in segments.orderBy("segment").toLocalIterator():  # a segment at a time
            if held and size + len(row["filter"]) > SLAB_BYTES:
                self.slabs.append(context.broadcast(b"".join(held)))
                held, size = [], 0
            s = row["segment"]
            self.slab[s], self.start[s], self.words[s] = len(self.slabs), size // 8, len(row["filter"]) // 8
            held.append(bytes(row["filter"]))
            size += len(row["filter"])
        self.slabs.append(context.broadcast(b"".join(held)))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        some, back = different(keys)
        # By segment, so that the part of a slab that is probed stays in the cache.
        order = np.argsort(segment_of(keys[some], len(self.slab)).astype(np.min_scalar_type(len(self.slab))), kind="stable")
        number = np.empty(len(some), np.int32)
        number[order] = np.arange(len(some), dtype=np.int32)
        keys, back = keys[some][order], number[back]
        level, own = np.zeros(len(keys), np.uint8), segment_of(keys, len(self.slab))
        for i, slab in enumerate(self.slabs):
            at = np.flatnonzero(self.slab[own] == i) if len(self.slabs) > 1 else slice(None)
            data = np.frombuffer(slab.value, "<u8")
            here, of = keys[at], own[at]
            parts = [slice(i, i + PROBED) for i in range(0, len(here), PROBED)]
            level[at] = np.concatenate(
                [read_levels(here[p], data, self.start[of[p]], self.words[of[p]]) for p in parts] or [level[at]]
            )
            if len(self.slabs) > 1:  # a worker holds one slab at a time
                del data
                vars(slab).pop("_value", None)
        return level[back]


#: Classes of histories: their count's power of two, and whether the pair before was known.
CLASSES = 64


def evidence(
    word: np.ndarray, pair: np.ndarray, size: np.ndarray, total: float, documents: int, without: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word probability, pair frequency, class) of every token, from the levels of its word and pair.

    The class depends on the history alone, so the interpolation is a distribution.
    ``without`` is taken off every count: 1 to leave the token itself out.
    """
    first = np.cumsum(size) - size
    n = np.maximum(LEVELS[pair] - without, 0)
    # A history's count, rounded up to the end of its level, is no less than what its pairs have.
    upper = np.append(LEVELS[1:] - 1, LEVELS[-1] * 2)[np.append(0, word[:-1])] - without
    upper[first] = documents - without
    known = np.append(False, n[:-1] > 0)
    known[first] = False
    probability = (np.maximum(LEVELS[word] - without, 0) + ALPHA) / (total - without)
    frequency = np.minimum(n / np.maximum(upper, 1), 1.0)
    kind = np.minimum(np.log2(np.maximum(upper, 1)).astype(np.int64), CLASSES // 2 - 1) * 2 + known
    return probability, frequency, kind


def log10_probability(
    word: np.ndarray, pair: np.ndarray, size: np.ndarray, total: float, documents: int, weights: np.ndarray
) -> np.ndarray:
    """The model's log10 probability of every token."""
    probability, frequency, kind = evidence(word, pair, size, total, documents)
    weight = weights[kind]
    return np.log10(weight * frequency + (1.0 - weight) * probability)


def kept_levels(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word levels, pair levels, tokens per row) of consecutive rows with about SCORED tokens."""
    sizes = batch.column("n_tokens").to_numpy()
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, before + SCORED, "right")))
        part = batch.slice(first, last - first)
        word, pair = (np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint8) for x in ("words", "pairs"))
        yield first, word, pair, sizes[first:last]
        first = last


def learned_weights(levels: DataFrame, total: float, documents: int) -> np.ndarray:
    """The weight of the pair model for each class: expectation maximisation over a histogram of bounded size.

    Every token of every training document counts, with itself left out of the
    counts it is predicted from.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, word, pair, size in kept_levels(batch):
                probability, frequency, kind = evidence(word, pair, size, total, documents, without=1)
                with np.errstate(divide="ignore"):
                    ratio = np.clip(np.round(4 * np.log2(frequency / probability)), -200, 200).astype(np.int64)
                n = np.bincount(kind * 1000 + ratio + 500)
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    training = levels.where("not held_out").select("n_tokens", "words", "pairs")
    counted = training.mapInArrow(rows, "cell bigint, n bigint")
    cells = counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 64 x 401
    return maximised(np.array([c.cell for c in cells], np.int64), np.array([c.n for c in cells], float))


def maximised(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that make ``n`` tokens of each (class, likelihood ratio) most likely."""
    weights = np.full(CLASSES, 0.1)
    kind, ratio = cell // 1000, np.exp2((cell % 1000 - 500) / 4.0)
    ratio[cell % 1000 - 500 <= -200] = 0.0
    seen = np.bincount(kind, n, CLASSES)
    for _ in range(50):
        weight = weights[kind]
        share = weight * ratio / (weight * ratio + 1.0 - weight)
        # One unit of evidence at 0.1 for classes that are rarely seen; a weight stays between 0.001 and 0.95.
        weights = np.clip((np.bincount(kind, n * share, CLASSES) + 0.1) / (seen + 1.0), 0.001, 0.95)
    return weights


def head_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word, n), sorted by word, of the most frequent words: at most HEAD, down to some level of the scale.

    First the words of each level are counted, so that no task sends more than belongs to the list.
    """
    bounds = F.array(*[F.lit(int(x)) for x in LEVELS])
    level = F.array_size(F.filter(bounds, lambda x: x <= F.col("n")))
    at, least = 0, None
    for row in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):  # one row a level
        at += row["count"]
        if at > HEAD:
            break
        least = int(LEVELS[row["level"] - 1])
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = words.where(F.col("n") >= least).collect()
    word, n = np.array([r.word for r in head], np.int64), np.array([r.n for r in head], np.int64)
    order = np.argsort(word)
    return word[order], n[order]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The score is the log10 probability by the one model of all training documents,
    the document's own among them if it is one. A null or empty text has the end
    alone. A null id is a training document; repeated rows count, and are scored,
    each for itself. An empty table has an empty result. Other columns are not read.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", fold.alias("fold"), "text")
    words = written(word_counts(docs), "words")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total = size.n + ALPHA * (size.v + 1)
    norm = math.log10(total)
    head_word, head_n = head_words(words)

    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = int(min(1 << 24, 1 + text_bytes // SEGMENT_BYTES))
    built = written(segments_of(pair_counts(docs, segments), words, segments), "filter")
    documents = docs.where(F.coalesce(F.col("fold") % FOLDS != HELD_OUT, F.lit(True))).count()
    filter_ = Filter(built, segments)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            folds = _folded(batch)
            for first, tokens, sizes in _gathered(streams(batch.column(2))):
                n = len(sizes)
                of = np.repeat(np.arange(n), sizes)
                found = filter_.levels(np.concatenate([word_keys(tokens), pair_keys(histories(tokens, sizes), tokens)]))
                signed = tokens.view(np.int64)
                at = np.minimum(np.searchsorted(head_word, signed), max(len(head_word) - 1, 0))
                known = head_word[at] == signed if len(head_word) else np.zeros(len(tokens), bool)
                base = np.bincount(of[known], np.log10(head_n[at[known]] + ALPHA) - norm, n)
                n_known = np.bincount(of[known], minlength=n)
                ends = np.append(0, np.cumsum(sizes - n_known)).astype(np.int32)
                levels = [_binary(x, sizes) for x in (found[: len(tokens)], found[len(tokens) :])]
                columns = [
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n),
                    pa.array(folds[first : first + n] % FOLDS == HELD_OUT), pa.array(sizes.astype(np.int64)),
                    pa.array(n_known), pa.array(base, pa.float64()),
                    pa.ListArray.from_arrays(ends, signed[~known]), *levels,
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double, "
        "tail array<bigint>, words binary, pairs binary"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kept = written(docs.mapInArrow(read, schema), "levels")
    weights = learned_weights(kept, total, documents)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, word, pair, sizes in kept_levels(batch):
                each = log10_probability(word, pair, sizes, total, documents, weights)
                scores = np.add.reduceat(each, np.cumsum(sizes) - sizes)
                row = batch.column("row").slice(first, len(sizes))
                yield pa.RecordBatch.from_arrays([row, pa.array(scores)], names=["row", "score"])

    scored = kept.select("row", "n_tokens", "words", "pairs").mapInArrow(score, "row bigint, score double")
    tail = kept.select("row", F.explode("tail").alias("word"))
    part = F.log10(F.col("n") + F.lit(ALPHA)) - F.lit(norm)
    known = tail.join(words, "word").groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(part).alias("tail_base"))
    tail_known, tail_base = (F.coalesce(c, F.lit(0)) for c in ("tail_known", "tail_base"))
    unseen = (F.array_size("tail") - tail_known) * F.lit(math.log10(ALPHA) - norm)
    return kept.join(known, "row", "left").join(scored, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + tail_known).alias("n_known"),
        F.lit(size.n).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + tail_base + unseen).alias("base_score"), "score",
    )


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value a row, of as many bytes as the row has tokens."""
    ends = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _gathered(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive streams as one, of about SCORED tokens."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(t) for _, t, _ in held) >= SCORED:
            yield held[0][0], *(np.concatenate(x) for x in list(zip(*held))[1:])
            held = []
    if held:
        yield held[0][0], *(np.concatenate(x) for x in list(zip(*held))[1:])
