"""Ranked lexical search that scores every bag of words once.

Documents are restricted to the terms of the items. What is left of many of them
is the same: a vector of term frequencies and the length part m of the score.
Such documents are one class; its score against an item is computed once and holds
for all members, of which an item's ranking can hold the first few by doc_id only.
Items come in slabs of bounded size; a slab with the weights of its terms travels
to the tasks, which score their classes in blocks and keep each item's best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.llm.common import term_counts, term_table, written

TOP = 20
#: Distinct (item, term) entries of a slab, about: what the driver and each task hold of the items at once.
SLAB = 500_000
#: Cells (class, item) of a block.
CELLS = 4_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms, times: the distinct terms of each different (item_id, text) and how often it has them."""
    table = term_table(letters_only=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t, table) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            terms = pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string()))
            times = pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms, times], names=["item_id", "terms", "times"])

    read = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return read.mapInArrow(rows, f"item_id {items.schema['item_id'].dataType.simpleString()}, terms array<string>, times array<bigint>")


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms), terms (ascending numbers in the vocabulary), tf: of each row, whatever it holds of the vocabulary."""
    number = {t.encode(): i for i, t in enumerate(vocabulary)}
    table = term_table(letters_only=False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes = [], []
            terms: list[int] = []
            tf: list[int] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = term_counts(text, table)
                n.append(found.total())
                own = sorted((number[t], found[t]) for t in number.keys() & found.keys())
                sizes.append(len(own))
                terms += [t for t, _ in own]
                tf += [x for _, x in own]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((terms, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def classes(counted: DataFrame, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """m, terms, tf, members: one row for each different vector and m, with its first members by doc_id.

    Rows meet by a hash and are one class only if m and the whole vectors are equal.
    A ranking takes members in this order, so it never reaches beyond the first ``top``.
    """
    key = ["hash", "m", "terms", "tf"]
    own = counted.where(F.size("terms") > 0).select(
        F.expr(f"75 + (25L * n * {n_docs}L) div {max(1, n_terms)}L").alias("m"), "terms", "tf", "doc_id"
    )
    own = own.withColumn("hash", F.xxhash64("m", "terms", "tf"))
    first = Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id"))
    few = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    return few.groupBy(*key).agg(F.collect_list(F.struct("doc_id")).alias("members")).drop("hash")


class Slab:
    """Items with their postings: for term t the items ``item[at[t]:at[t + 1]]``, which hold it ``times`` often."""

    def __init__(self, items: list[tuple], vocabulary: list[str], weights: np.ndarray):
        self.item_ids = [i[0] for i in items]
        number = {t: i for i, t in enumerate(vocabulary)}
        entries = [(number[t], row, n) for row, (_, terms, times) in enumerate(items) for t, n in zip(terms, times)]
        term, self.item, times = np.array(sorted(entries), np.int64).reshape(-1, 3).T
        self.at = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.gain = times * weights[term]

    def scores(self, m: np.ndarray, terms: np.ndarray, tf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of classes (rows) and items (columns), from the entries of the classes' vectors."""
        total = np.zeros((len(m), len(self.item_ids)), np.int64)
        part = (10**9 * tf) // (1000 * tf + 12 * m[rows])
        order = np.argsort(terms, kind="stable")
        terms, rows, part = terms[order], rows[order], part[order]
        edges = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1], [True]))) if len(terms) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            own = slice(self.at[terms[a]], self.at[terms[a] + 1])
            # A class has a term once and so has an item: no cell is met twice.
            total[rows[a:b, None], self.item[own]] += part[a:b, None] * self.gain[own]
        return total


class Best:
    """Each item's best members so far, as sorted (score, doc_id, null doc_id) of at most ``top`` rows."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held = [np.zeros((0, 3), np.int64) for _ in range(items)]

    def add(self, scores: np.ndarray, members: np.ndarray, offsets: np.ndarray) -> None:
        """``members`` are (doc_id, null) of the classes, one class after the other."""
        for item in range(scores.shape[1]):
            own, held = scores[:, item], self.held[item]
            least = held[-1, 0] if len(held) == self.top else 1
            at = np.flatnonzero(own >= least)
            if len(at) > self.top:
                at = at[own[at] >= np.partition(own[at], -self.top)[-self.top]]
            if not len(at):
                continue
            sizes = offsets[at + 1] - offsets[at]
            rows = np.repeat(offsets[at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            more = np.column_stack([np.repeat(own[at], sizes), members[rows]])
            both = np.concatenate([held, more])
            self.held[item] = both[np.lexsort((both[:, 1], both[:, 2], -both[:, 0]))[: self.top]]


def ranked(found: DataFrame, slab: Slab, top: int = TOP) -> DataFrame:
    """item, doc_id, score of each item's best documents, from the classes."""
    step = max(1, CELLS // max(1, len(slab.item_ids)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(slab.item_ids), top)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                m = batch.column(0).to_numpy()
                terms, tf, members = (batch.column(i).flatten() for i in (1, 2, 3))
                size, count = (batch.column(i).value_lengths().to_numpy().astype(np.int64) for i in (1, 3))
                doc_id = members.field("doc_id")
                members = np.column_stack([doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)])
                scores = slab.scores(m, terms.to_numpy(), tf.to_numpy(), np.repeat(np.arange(len(m)), size))
                best.add(scores, members.astype(np.int64), np.concatenate(([0], np.cumsum(count))))
        item = np.repeat(np.arange(len(best.held)), [len(x) for x in best.held])
        held = np.concatenate(best.held) if best.held else np.zeros((0, 3), np.int64)
        doc_id = pa.array(held[:, 1], mask=held[:, 2] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item), doc_id, pa.array(held[:, 0])], names=["item", "doc_id", "score"])

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    some = found.select("m", "terms", "tf", "members").mapInArrow(rows, "item bigint, doc_id bigint, score bigint")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_slab(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms, _ in items for t in terms})
    counted = written(bags(docs, vocabulary), "bags")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row for each term of the slab.
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in held:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    slab = Slab(items, vocabulary, weights)
    best = ranked(classes(counted, n_docs, n_terms, top), slab, top)
    kind = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(slab.item_ids)], "item bigint, item_id bigint")
    return best.join(kind, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item with a score above 0.

    Rows that repeat an item_id and its text are one item; with another text they
    are an item of their own, and so are null ids. Each row of the documents is a
    document, also where doc_ids repeat; null ids come last among equal scores. Null
    and empty texts have no terms. Other columns are not read; an empty table gives
    no rows.
    """
    asked = written(item_terms(items).where(F.size("terms") > 0), "items")
    entries = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    slabs = max(1, -(-entries // SLAB))
    dealt = asked.withColumn("slab", F.pmod(F.xxhash64("item_id", "terms"), F.lit(slabs)))
    found = []
    for slab in range(slabs):
        own = sorted((tuple(r) for r in dealt.where(F.col("slab") == slab).drop("slab").collect()), key=repr)
        found.append(search_slab(docs, own, top))
    return reduce(DataFrame.unionAll, found)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), stats AS (
  SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(stats.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, stats GROUP BY term
), m AS (
  SELECT r, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * stats.n) // stats.l AS m FROM d, stats WHERE len(w) > 0
), scored AS (
  SELECT i.i, i.item_id, m.r, m.doc_id, sum(weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS score
  FROM i JOIN tf USING (term) JOIN weights USING (term) JOIN m ON m.r = tf.r
  GROUP BY i.i, i.item_id, m.r, m.doc_id HAVING score > 0
)
SELECT item_id, doc_id, CAST(score AS BIGINT) AS score,
       CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
FROM scored QUALIFY rank <= {TOP}
"""
