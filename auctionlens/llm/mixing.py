"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a mean repetition rate: its share of the target divided by its
share of the rows. Each document inverts the Poisson distribution of that mean at
a point hashed from the seed and its id, is repeated that often, and all copies
are sorted by a hash of their own. Nothing is drawn at random, so a lost task is
repeated with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.llm.common import written

#: Without given weights a source weighs as much as its number of rows to this power.
FLATTEN = 0.5
SEED = 20240
#: Points lie on a grid of 2 ** -52, which a double holds exactly.
_DIGITS = 13


def unit_hash(*parts: Column) -> Column:
    """A point of [0, 1) from the MD5 of the parts; a null part has a value of its own."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(16**_DIGITS))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """source, rate and the cumulative Poisson probabilities ``steps`` of that mean.

    ``weights`` has (source, weight); a source without one gets no copies. ``total``
    is the expected number of rows, by default that of the input.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n"), F.lit(FLATTEN)))
    else:
        given = weights.select(F.col("source").alias("of"), "weight")
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    weighed = written(weighed, "sources")
    sums = weighed.agg(F.sum("weight").alias("all"), F.sum("n").alias("rows"))
    rows = F.col("rows") if total is None else F.lit(float(total))
    rated = weighed.crossJoin(sums).select(  # with the one row of the sums
        "source", (F.col("weight") / F.col("all") * rows / F.col("n")).alias("rate")
    )
    # Beyond the last step less than 2 ** -52 is left, so no point lies there.
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    k = F.sequence(F.lit(0), last)
    # log(k!) by summing logarithms, so that a large mean does not underflow.
    logs = F.aggregate(
        k, F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps")),
        lambda a, i: _next_step(a, i),
        lambda a: a["steps"],
    )
    return rated.where("rate > 0").select("source", "rate", logs.alias("steps"))


def _next_step(a: Column, i: Column) -> Column:
    log = F.when(i == 0, F.lit(0.0)).otherwise(a["log"] + F.log(i.cast("double")))
    total = a["sum"] + F.exp(i * F.log("rate") - F.col("rate") - log)
    return F.struct(log.alias("log"), total.alias("sum"), F.concat(a["steps"], F.array(total)).alias("steps"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED
) -> DataFrame:
    """Every document as often as its Poisson count says, in a global order that mixes all sources.

    Adds ``copy`` (from 1) and drops nothing but documents with a count of 0. A
    null source is a source of its own; documents with a null id share one point.
    Rows that repeat an id have the same count. A column that is named ``copy``
    already is replaced. Sources are joined by Spark's choice: a broadcast only
    while their written table is below its threshold, else a shuffle in which
    adaptive execution splits a hot source.
    """
    docs = docs.drop("copy")
    rates = written(source_rates(docs, weights, total), "rates")
    steps = rates.select(F.col("source").alias("__of"), F.col("steps").alias("__steps"))
    point = unit_hash(F.lit(seed), F.col("doc_id"))
    count = F.size(F.filter("__steps", lambda x: x <= F.col("__point")))
    copies = (
        docs.join(steps, F.col("source").eqNullSafe(F.col("__of")))
        .withColumn("__point", point)
        .withColumn("__count", count)
        .where("__count > 0")
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    )
    place = unit_hash(F.lit(seed + 1), F.col("doc_id"), F.col("copy"))
    return copies.withColumn("__place", place).orderBy("__place", "doc_id", "copy").drop("__place")


def query(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "source", "lang", "n_chars", "text", "copy")


SQL = f"""
WITH s AS (
  SELECT source, n, pow(n, {FLATTEN}) / sum(pow(n, {FLATTEN})) OVER () * sum(n) OVER () / n AS rate
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
), steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS INT))) AS k FROM s)
), points AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {_DIGITS}) AS BIGINT)
         / {float(16**_DIGITS)!r} AS p
  FROM documents
), counts AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, count(*) AS c
  FROM points d JOIN steps t ON d.source IS NOT DISTINCT FROM t.source AND t.upto <= d.p GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, text, CAST(unnest(generate_series(1, c)) AS INT) AS copy FROM counts
"""
