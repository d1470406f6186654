"""Node pass/fail decisions against what their goals say, as 2 x 2 matrices.

Row 0 is a passed node (or good performance), column 0 one that should pass.
All matrices come out of one aggregation per node whose sums combine map-side,
so a node with very many hours is no burden to a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.predicates import with_keys

CTR_NODE = ["campaign_group_id", "country_group_id", "tag_id", "creative_size_bucket_id"]
CPA_NODE = [*CTR_NODE, "pixel_id"]


def _first_decision() -> Column:
    """The decision of the earliest hour as 1, 0 (any value but 1) or NULL; the smallest if an hour has several.

    Hour digits and a rank of the decision (none, below 1, 1, above 1) are packed
    into one number, so that the aggregation stays hash-based.
    """
    hour, value = F.col("ymdh"), F.col("is_passed")
    digits = F.concat(hour.substr(1, 4), hour.substr(6, 2), hour.substr(9, 2), hour.substr(12, 2))
    rank = F.when(value.isNull(), 0).when(value < 1, 1).when(value == 1, 2).otherwise(3)
    first = F.min(digits.try_cast("bigint") * 4 + rank) % 4
    return F.when(first > 0, (first == 2).cast("int")).alias("is_passed")


def _in_test(value: str) -> Column:
    inside = F.col("ymdh").between(F.col("qt_start_time_adjusted"), F.col("qt_finish_time"))
    return F.sum(F.when(inside, F.col(value)).otherwise(0)) > 0


def _one_goal(goals: DataFrame, *values: str) -> DataFrame:
    """One goal row per line item: that of the largest pixel when it has several."""
    order = F.struct(F.coalesce("pixel_id", F.lit(-1)), *values) if "pixel_id" in goals.columns else F.struct(*values)
    picked = F.max_by(F.struct(*values), order).alias("goal")
    return goals.groupBy(F.col("cg_id").alias("campaign_group_id")).agg(picked).select("campaign_group_id", "goal.*")


def cpa_nodes(merged: DataFrame, goals: DataFrame) -> DataFrame:
    """Per node: its decision, whether a wanted conversion fell into the test, and its performance.

    Nodes of a line item without a goal row are left out.
    """
    nodes = (
        with_keys(merged, CPA_NODE)
        .groupBy(*CPA_NODE)
        .agg(
            _first_decision(),
            F.sum("booked_rev").cast("double").alias("spent"),
            F.sum("post_view_convs").alias("views"),
            F.sum("post_click_convs").alias("clicks"),
            _in_test("post_view_convs").alias("view_in_test"),
            _in_test("post_click_convs").alias("click_in_test"),
        )
    )
    pvg, pcg, spent = F.col("pvg_threshold"), F.col("pcg_threshold"), F.coalesce("spent", F.lit(0.0))
    view_value = F.coalesce(F.col("views") * pvg, F.lit(0.0)).cast("double")
    click_value = F.coalesce(F.col("clicks") * pcg, F.lit(0.0)).cast("double")
    return nodes.join(_one_goal(goals, "pvg_threshold", "pcg_threshold"), "campaign_group_id").select(
        *CPA_NODE,
        (F.col("is_passed") == 1).alias("passed"),
        ((pvg.isNotNull() & F.col("view_in_test")) | (pcg.isNotNull() & F.col("click_in_test"))).alias("should_pass"),
        (view_value + click_value > spent).alias("perf_sum"),
        ((view_value > spent) | (click_value > spent)).alias("perf_any"),
    )


def ctr_nodes(merged: DataFrame, goals: DataFrame) -> DataFrame:
    """As ``cpa_nodes`` for click-rate goals."""
    nodes = (
        with_keys(merged, CTR_NODE)
        .groupBy(*CTR_NODE)
        .agg(
            _first_decision(),
            F.sum("imps").alias("imps"),
            F.sum("clicks").alias("clicks"),
            _in_test("clicks").alias("should_pass"),
        )
    )
    enough = F.col("clicks").cast("double") > F.col("goal_threshold").cast("double") * F.col("imps")
    return nodes.join(_one_goal(goals, "goal_threshold"), "campaign_group_id").select(
        *CTR_NODE,
        (F.col("is_passed") == 1).alias("passed"),
        "should_pass",
        F.coalesce(enough, F.lit(False)).alias("perf"),
    )


def _cells(nodes: DataFrame, matrices: dict[str, tuple[str, str]]) -> DataFrame:
    """Counts of all cells of the named (row flag, column flag) matrices in one pass, zeros included."""
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("matrix"),
                (1 - F.col(row).cast("int")).alias("row"),
                (1 - F.col(col).cast("int")).alias("col"),
                F.lit(1).alias("node"),
            )
            for name, (row, col) in matrices.items()
        ]
    )
    spread = nodes.select(F.explode(wanted).alias("c")).select("c.*")
    spark = nodes.sparkSession
    empty = spark.createDataFrame(
        [(name, r, c, 0) for name in matrices for r in (0, 1) for c in (0, 1)],
        "matrix string, row int, col int, node int",
    )
    return spread.unionByName(empty).groupBy("matrix", "row", "col").agg(F.sum("node").alias("n"))


def confusion_cpa(merged: DataFrame, goals: DataFrame, summed: bool) -> DataFrame:
    """Decision and performance matrices of cpa nodes.

    ``summed`` compares the added value of both conversion kinds with the
    spend; otherwise either kind alone has to exceed it.
    """
    perf = "perf_sum" if summed else "perf_any"
    return _cells(
        cpa_nodes(merged, goals), {"definition": ("passed", "should_pass"), "performance": (perf, "should_pass")}
    )


def confusion_ctr(merged: DataFrame, goals: DataFrame) -> DataFrame:
    return _cells(
        ctr_nodes(merged, goals), {"definition": ("passed", "should_pass"), "performance": ("perf", "should_pass")}
    )


def confusion_def_cpa(merged: DataFrame, goals: DataFrame) -> DataFrame:
    return _cells(cpa_nodes(merged, goals), {"definition": ("passed", "should_pass")})


def confusion_def_ctr(merged: DataFrame, goals: DataFrame) -> DataFrame:
    return _cells(ctr_nodes(merged, goals), {"definition": ("passed", "should_pass")})


def confusion_perf_cpa(merged: DataFrame, goals: DataFrame) -> DataFrame:
    """Decision against performance over all hours."""
    return _cells(cpa_nodes(merged, goals), {"performance": ("passed", "perf_sum")})


def confusion_perf_ctr(merged: DataFrame, goals: DataFrame) -> DataFrame:
    return _cells(ctr_nodes(merged, goals), {"performance": ("passed", "perf")})


def as_grid(cells: DataFrame) -> DataFrame:
    """One line per matrix row: the two columns side by side."""
    return cells.groupBy("matrix", "row").pivot("col", [0, 1]).agg(F.first("n")).withColumnsRenamed(
        {"0": "should_pass", "1": "should_fail"}
    )
