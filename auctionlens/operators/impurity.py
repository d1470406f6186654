"""Gini impurity of features, alone and given one another, weighted by impressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.predicates import with_keys


def _as_list(feature: str | Sequence[str]) -> list[str]:
    return [feature] if isinstance(feature, str) else list(feature)


def gini(df: DataFrame, feature: str) -> DataFrame:
    """One row: 1 - sum of squared impression shares of the feature's values."""
    per_value = with_keys(df, [feature]).groupBy(feature).agg(F.sum("imps").cast("double").alias("x"))
    total = F.sum("x")
    return per_value.agg((1 - F.try_divide(F.sum(F.col("x") * F.col("x")), total * total)).alias("gini"))


def gini_weighted(df: DataFrame, given: str | Sequence[str], feature: str | Sequence[str] = "campaign_id") -> DataFrame:
    """One row: impurity of ``feature`` inside each value of ``given``, weighted by impressions."""
    given, feature = _as_list(given), _as_list(feature)
    cells = (
        with_keys(df, [*given, *feature])
        .groupBy(*given, *feature)
        .agg(F.sum("imps").cast("double").alias("x"))
    )
    inside = cells.groupBy(*given).agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    return inside.agg(_weighted().alias("gini"))


def _weighted() -> Column:
    """Sum of t * (1 - ss / t^2) over sum of t."""
    return F.try_divide(F.sum(F.col("t") - F.try_divide(F.col("ss"), F.col("t"))), F.sum("t"))


_CELLS = "array<struct<f1:string,f2:string,v1:string,v2:string>>"


def _cell(*columns: str) -> Column:
    return F.struct(*[(F.col(c) if c else F.lit("")).alias(n) for n, c in zip(("f1", "f2", "v1", "v2"), columns)])


def impurity_matrix(df: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """Impurity of every feature given every other, plus its own (``given`` = '').

    One aggregation has a grouping set for every unordered pair, on the features as
    they are typed; only its cells become text. The cells of single features come
    from those of the pairs, and the cells alone are read in both directions. The
    diagonal is 0.
    """
    if len(features) < 2:
        raise ValueError("a matrix needs two features; gini measures one")
    pairs = list(combinations(features, 2))
    sets = df.groupingSets([[F.col(a), F.col(b)] for a, b in pairs], *[F.col(f) for f in features]).agg(
        F.sum("imps").cast("double").alias("x"), F.grouping_id().alias("set")
    )
    # Bit i from the left tells that feature i is not in the set.
    whole = (1 << len(features)) - 1
    bit = {f: 1 << (len(features) - 1 - i) for i, f in enumerate(features)}

    def of_pair(value: Callable[[str, str], Column]) -> Column:
        cases = [F.when(F.col("set") == whole - bit[a] - bit[b], value(a, b)) for a, b in pairs]
        return F.coalesce(*cases)

    joint = sets.select(
        of_pair(lambda a, b: F.lit(a)).alias("f1"),
        of_pair(lambda a, b: F.lit(b)).alias("f2"),
        of_pair(lambda a, b: F.col(a).cast("string")).alias("v1"),
        of_pair(lambda a, b: F.col(b).cast("string")).alias("v2"),
        "x",
    )
    # A feature alone: its cells with one partner, the first feature's with the second.
    first, second = features[:2]
    alone = F.when(
        (F.col("f1") == first) & (F.col("f2") == second),
        F.array(_cell("", "f1", "", "v1"), _cell("", "f2", "", "v2")),
    ).when(F.col("f1") == first, F.array(_cell("", "f2", "", "v2"))).otherwise(F.array().cast(_CELLS))
    cells = (
        joint.select("x", F.explode(F.concat(F.array(_cell("f1", "f2", "v1", "v2")), alone)).alias("p"))
        .select("x", "p.*")
        .where("v1 IS NOT NULL AND v2 IS NOT NULL")
        .groupBy("f1", "f2", "v1", "v2")
        .agg(F.sum("x").alias("x"))
    )

    def reading(given: str, feature: str, at: str) -> Column:
        return F.struct(F.col(given).alias("given"), F.col(feature).alias("feature"), F.col(at).alias("g"))

    both = F.array(reading("f1", "f2", "v1"), F.when(F.col("f1") != "", reading("f2", "f1", "v2")))
    inside = (
        cells.select("x", F.explode(F.array_compact(both)).alias("r"))
        .groupBy("r.given", "r.feature", "r.g")
        .agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    )
    measured = inside.groupBy("given", "feature").agg(F.round(_weighted(), digits).alias("impurity"))
    diagonal = df.sparkSession.createDataFrame([(f, f, 0.0) for f in features], measured.schema)
    return measured.unionByName(diagonal)
