"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the
measurements and one failure bit for each rule; a policy is a named, versioned
set of bits, so a new policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.llm.common import byte_codes, mix, multipliers, per_row, text_chunks, word_hashes, word_spans

#: All 64-bit counts, in the ledger's order.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the measurements by name, as arrays or as columns."""

    name: str
    fails: Callable[[dict], np.ndarray | Column]


#: Bit i is rule i. A rule is never changed or moved, only added at the end.
RULES = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbol_heavy", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 14 * m["n_words"]),
    Rule("shouting", lambda m: m["n_upper"] > m["n_lower"]),
    Rule("exclamations", lambda m: 100 * m["n_bangs"] > 30 * m["n_words"]),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Policy version: the bits it rejects for.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_words"],
    "v1": sum(BIT[x] for x in ("too_few_words", "repeated_words", "symbol_heavy", "repeated_lines")),
    "v2": sum(BIT.values()),
}
POLICY = "v2"


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text; a null is an empty text."""
    codes, k = byte_codes(lower=False), multipliers(4, 21)
    parts: list[dict[str, np.ndarray]] = []
    for _, data, offsets in text_chunks(texts):
        n = len(offsets) - 1
        starts, ends, rows = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, codes)
        bytes_before = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[offsets])
        m = {"n_words": per_row(rows, n)}
        # Every byte but the continuation bytes of UTF-8 begins a code point.
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        m["word_chars"] = per_row(rows, n, heads[ends] - heads[starts])
        m["n_symbols"] = bytes_before(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
        m["n_upper"] = bytes_before((data >= 65) & (data <= 90))
        m["n_lower"] = bytes_before((data >= 97) & (data <= 122))
        m["n_bangs"] = bytes_before(data == 33)
        repeated = np.zeros(len(rows), bool)
        if len(rows) > 2:
            same = rows[:-2] == rows[2:]
            key = mix(hashes[:-2] * k[0] + hashes[1:-1] * k[1] + hashes[2:] * k[2] + rows[2:].astype(np.uint64) * k[3])
            at = np.flatnonzero(same)
            _, group, count = np.unique(key[at], return_inverse=True, return_counts=True)
            again = at[count[group] > 1]
            for step in range(3):
                repeated[again + step] = True
        m["n_repeat_words"] = per_row(rows[repeated], n)
        lines, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = data.tobytes()
        for i in range(n):
            own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            lines[i], copies[i] = len(own), len(own) - len(set(own))
        m["n_lines"], m["n_dup_lines"] = lines, copies
        parts.append(m)
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64) for name in MEASURES}


def failure_bits(measures: dict[str, np.ndarray]) -> np.ndarray:
    bits = np.zeros(len(measures["n_words"]), np.int64)
    for i, rule in enumerate(RULES):
        bits |= rule.fails(measures).astype(np.int64) << i
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, measurements, ``failures``.

    A null or empty text has only zeros and fails for having too few words.
    Repeated rows and null keys get a row each; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1))
            columns = [batch.column(0), *(pa.array(m[x]) for x in MEASURES), pa.array(failure_bits(m))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *MEASURES, "failures"])

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{x} bigint" for x in MEASURES), "failures bigint"])
    return docs.select(key, text).mapInArrow(rows, schema)


def passes(failures: Column, policy: str = POLICY) -> Column:
    return failures.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents it fails, those only it rejects, and those kept without it.

    Reads the ledger alone: one aggregation over the distinct bitmasks, of which there are few.
    """
    mask = POLICIES[policy]
    counts = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("mask")).agg(F.count("*").alias("n"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if mask >> i & 1]
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).alias("bit")) for i, n in rules)))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    one = counts.select("mask", "n", table.alias("r")).select("mask", "n", "r.rule", "r.bit")
    return one.groupBy("rule").agg(
        total(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("mask") == F.col("bit")).alias("n_only_here"),
        total(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.bit_or("mask").alias("failed_together"),
    )


def keep_documents(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns; nothing is shuffled."""
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = failure_bits(measure(batch.column(place)))
            yield batch.filter(pa.array((bits & POLICIES[policy]) == 0))

    return docs.mapInArrow(kept, docs.schema)


def query(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    entries = ledger(docs)
    return entries.select(
        "doc_id", *MEASURES[:5],
        (~passes(F.col("failures"), "base")).alias("base_failed"),
        passes(F.col("failures"), policy).alias("kept"),
        "failures",
    )


def _sql_failures() -> str:
    tests = {
        "too_few_words": "n_words < 50",
        "repeated_words": "100 * n_repeat_words > 50 * n_words",
        "symbol_heavy": "100 * n_symbols > 10 * n_words",
        "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
        "short_words": "word_chars < 2 * n_words",
        "long_words": "word_chars > 14 * n_words",
        "shouting": "n_upper > n_lower",
        "exclamations": "100 * n_bangs > 30 * n_words",
    }
    return reduce(lambda a, b: f"{a} + {b}", (f"CASE WHEN {t} THEN {BIT[r]} ELSE 0 END" for r, t in tests.items()))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
), repeats AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM repeats) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS copies
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(copies, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
), f AS (SELECT *, CAST({_sql_failures()} AS BIGINT) AS failures FROM m)
SELECT doc_id, {", ".join(MEASURES[:5])}, failures & {POLICIES["base"]} <> 0 AS base_failed,
       failures & {POLICIES[POLICY]} = 0 AS kept, failures
FROM f
"""
