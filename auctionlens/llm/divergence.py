"""How far the sources of a language differ in their use of words, with equal texts collapsed first.

Equal texts of a language are one row with its copies by source, so each is taken
apart once and its terms count as often as the text occurs: in the document
frequencies as in the counts. The kept terms, one row each with the counts by
source, are dealt to bounded chunks. A chunk compares every two sources over the
terms that either of them holds; what the others add is a product, since all terms
that two sources lack have one value.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.llm.common import term_counts, term_table, written

#: Documents of a language that a kept term occurs in at least, and the terms reported for a group.
MIN_DOCUMENTS, TOP = 10, 10
#: Shares are whole billionths.
UNIT = 10**9
#: Entries that a task gathers before it hands them on, and (term, source) cells of a chunk, about; a chunk has some
#: terms for each source, so that its sums are fewer than its cells.
ENTRIES, CELLS, TERMS_PER_SOURCE = 4_000_000, 200_000, 4


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, by_source: one row for each text of a language, with its number of copies in each source.

    Nulls are read as ''. Texts are equal if their SHA-256 digests are. The counts
    and the texts are reduced apart, each combined map-side, so copies never meet as rows.
    """
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    keyed = read.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("by_source"))
    texts = keyed.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "by_source")


def counted(texts: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, from the collapsed texts of one task each."""
    table = term_table(letters_only=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of terms and of (lang, source) groups, as they are met.
        terms: dict[bytes, int] = defaultdict(count().__next__)
        groups: dict[tuple, int] = defaultdict(count().__next__)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            group, term, n, docs = (np.concatenate(x) for x in zip(*held))
            key = group * len(terms) + term
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums = [np.add.reduceat(x[order], first) for x in (n, docs)]
            group, term = np.divmod(key[first], len(terms))
            lang, source = (pa.array(x, pa.string()).take(pa.array(group)) for x in zip(*groups))
            name = pa.array(list(terms), pa.binary()).cast(pa.string()).take(pa.array(term))
            columns = [lang, source, name, pa.array(sums[0]), pa.array(sums[1])]
            held.clear(), terms.clear(), groups.clear()
            for numbers in (terms, groups):
                numbers.default_factory = count().__next__
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for lang, text, by_source in zip(
                batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            ):
                found = term_counts(text, table)
                if not found:
                    continue
                own = np.fromiter(map(terms.__getitem__, found), np.int64, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                for s in by_source:
                    group = np.full(len(own), groups[lang, s["source"]])
                    held.append((group, own, n * s["n"], np.full(len(own), s["n"])))
                    size += len(own)
                if size >= ENTRIES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.mapInArrow(rows, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(entries: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, by_source: the terms in ``least`` documents of their language, with their count in each source."""
    # Each task has a term once per source, so there is little to combine before this shuffle, the only one: what meets
    # for a term is bounded by the tasks times the sources.
    dealt = entries.repartition("term", "lang")
    groups = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_docs = F.sum("docs").over(Window.partitionBy("term", "lang"))
    frequent = groups.withColumn("in_docs", in_docs).where(F.col("in_docs") >= least)
    return frequent.groupBy("term", "lang").agg(F.collect_list(F.struct("source", "n")).alias("by_source"))


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / total) for every count, exact also where the product leaves 64 bits."""
    if not len(n) or total <= 0:
        return np.ones(len(n), np.int64)
    if int(n.max()) + 2 < 2**63 // UNIT:
        return 1 + UNIT * (n + 2) // total
    return np.array([1 + UNIT * (int(x) + 2) // total for x in n], np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare(terms: list[str], counts: np.ndarray, totals: list[int], kept: int, sources: list[str], top: int) -> list[tuple]:
    """Rows (source, part, item, value, n_terms) of one chunk.

    ``counts`` has a row for each source of the language and a column for each term.
    A ``pair`` row has the sum over the terms that either source holds, and their
    number; a ``term`` row is one of the ``top`` best of the chunk.
    """
    rows: list[tuple] = []
    p = [shares(own, total + 2 * kept) for own, total in zip(counts, totals)]
    q = shares(counts.sum(axis=0), sum(totals) + 2 * kept)
    held = counts > 0
    for i, source in enumerate(sources):
        at = np.flatnonzero(held[i] & (p[i] > q))
        value = distance(p[i][at], q[at])
        if len(at) > top:
            least = np.partition(value, -top)[-top]
            at, value = at[value >= least], value[value >= least]
        best = sorted(((-int(v), terms[t].encode(), terms[t]) for v, t in zip(value, at)))[:top]
        rows += [(source, "term", term, -v, 1) for v, _, term in best]
    for i, a in enumerate(sources):
        for j in range(i + 1, len(sources)):
            at = np.flatnonzero(held[i] | held[j])
            if len(at):
                rows.append((a, "pair", sources[j], int(distance(p[i][at], p[j][at]).sum()), len(at)))
    return rows


def absent(sql_total: str, sql_kept: str) -> Column:
    """The share of a term that a group lacks; null where no terms are kept."""
    return F.expr(f"CASE WHEN {sql_kept} > 0 THEN 1 + {2 * UNIT}L div ({sql_total} + 2 * {sql_kept}) END")


def divergence(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language its distance to each other source of the
    language, and the terms that it uses most above the language.

    Every occurring (lang, source) has pair rows, also without terms; a language
    without kept terms has value 0. A single source has no pair rows. Repeated rows
    count each; null texts have no terms, null languages and sources are ''. Other
    columns are not read. An empty table gives no rows.
    """
    terms = written(kept_terms(counted(collapsed(docs)), least), "kept-terms")
    each = terms.select("lang", F.explode("by_source").alias("s")).select("lang", "s.source", "s.n")
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    # One row for each group and for each language: no more than the report has.
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = names.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")
    )
    groups = written(groups, "groups")
    each_lang = groups.groupBy("lang").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    cells, widest = each_lang.agg(F.coalesce(F.sum(F.col("n") * F.col("kept")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    chunks = max(1, -(-cells // max(CELLS, TERMS_PER_SOURCE * widest**2)))
    dealt = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    sides = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def chunk_rows(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names, sums = b["source"].to_pylist(), b["total"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        sources = [names[i] for i in order]
        by_source = a["by_source"].combine_chunks()
        held = by_source.flatten()
        counts = np.zeros((len(sources), a.num_rows), np.int64)
        at = pc.index_in(held.field("source"), pa.array(sources, pa.string())).to_numpy()
        counts[at, np.repeat(np.arange(a.num_rows), by_source.value_lengths().to_numpy())] = held.field("n").to_numpy()
        found = []
        if a.num_rows and sources:
            found = compare(a["term"].to_pylist(), counts, [sums[i] for i in order], b["kept"][0].as_py(), sources, top)
        columns = list(zip(*found)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        lang = pa.array([key[0].as_py()] * len(found), pa.string())
        names = ["lang", "source", "part", "item", "value", "n_terms"]
        return pa.table([lang, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    found = dealt.groupBy("lang", "chunk").cogroup(sides.groupBy("lang", "chunk")).applyInArrow(
        chunk_rows, "lang string, source string, part string, item string, value bigint, n_terms bigint"
    )
    found = written(found, "divergence")
    # Pairs: a chunk has them once, the smaller name first; the report has them from both sides.
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms")
    )
    left = groups.select("lang", "kept", "source", absent("total", "kept").alias("p"))
    right = groups.select("lang", F.col("source").alias("item"), absent("total", "kept").alias("q"))
    pairs = left.join(right, "lang").where(F.col("source") < F.col("item")).join(sums, ["lang", "source", "item"], "left")
    rest = F.expr("((p - q) * (p - q)) div (p + q)") * (F.col("kept") - F.coalesce("n_terms", F.lit(0)))
    pairs = pairs.withColumn("value", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).cast("bigint"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), F.lit("pair").alias("part"), "value")
    pairs = pairs.select("lang", "s.source", "part", "s.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").select(pairs.columns[:-1])
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d)
  GROUP BY r, lang, source, term
), kept AS (
  SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= {MIN_DOCUMENTS}
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total FROM d
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s
  ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + ({UNIT}::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= {TOP}
"""
