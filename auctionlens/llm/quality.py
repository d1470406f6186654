"""Document quality by Bradley-Terry ranking.

Documents labelled good are preferred to documents labelled bad. The strength of a
document is linear in features of its text and is learned from preference pairs by
logistic loss on the feature differences. All labelled rows are learned from: dealt
to blocks by a hash, each meets some rows of the other label in its block, and every
Newton step adds up the blocks' gradients. The threshold is the quantile of the
training scores at the share of bad labels; a score is the probability that the
document would be preferred to one at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.llm.common import written
from auctionlens.llm.rules import measure

#: Rows of the sample that gives the Newton steps their start: those with the smallest hashes of their id and features.
SAMPLE = 20_000
#: Parts of the range of the hash, of which as many are read as hold the sample and a tenth more.
PARTS = 1 << 30
#: Rows of the other label that a labelled row is paired with, and the pairs of the start at most.
PAIRS_PER_ROW, PAIRS = 8, 100_000
#: Labelled rows to a block, about; a label with fewer than LEAST rows a block sends its rows to several blocks.
BLOCK, LEAST = 16_000, 500
#: The threshold is looked for between approximate quantiles of this accuracy.
ACCURACY = 10_000
RIDGE, STEPS = 1e-3, 25
FEATURES = ("symbols", "repeats", "copied_lines", "capitals", "exclamations", "word_length", "short", "size")


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, every feature between 0 and about 1; an empty text has ``short`` alone."""
    words = np.maximum(m["n_words"], 1).astype(float)
    letters = np.maximum(m["n_upper"] + m["n_lower"], 1)
    columns = (
        np.minimum(np.sqrt(m["n_symbols"] / words), 1.0),
        m["n_repeat_words"] / words,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["n_upper"] / letters,
        np.minimum(m["n_bangs"] / words, 1.0),
        np.minimum(np.abs(m["word_chars"] / words - 5.0) / 5.0, 1.0) * (m["n_words"] > 0),
        np.exp(-m["n_words"] / 25.0),
        np.log1p(m["n_words"]) / 12.0,
    )
    return np.stack(columns, axis=1)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the feature array of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(measure(batch.column(1)))
            offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, x.ravel())], names=["doc_id", "x"]
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, x array<double>")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def bradley_terry(x: np.ndarray, good: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights of the strength, by Newton steps on drawn pairs of a good and a bad document."""
    weights = np.zeros(x.shape[1])
    won, lost = x[good], x[~good]
    if not len(won) or not len(lost):
        return weights
    draw = np.random.default_rng(seed)
    n = min(PAIRS, PAIRS_PER_ROW * len(x))
    difference = won[draw.integers(len(won), size=n)] - lost[draw.integers(len(lost), size=n)]
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-np.clip(difference @ weights, -30, 30)))
        gradient = difference.T @ (1.0 - p) / n - RIDGE * weights
        curvature = (difference * (p * (1.0 - p))[:, None]).T @ difference / n + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def threshold(scores: np.ndarray, share_bad: float) -> float:
    """The score below which the given share lies: halfway between its neighbours."""
    ordered = np.sort(scores)
    at = min(max(round(share_bad * len(ordered)), 1), len(ordered) - 1)
    return float((ordered[at - 1] + ordered[at]) / 2)


def labelled_rows(x: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The distinct rows with a label of 0 or 1 for which ``learn`` holds."""
    wanted = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").where(learn).distinct()
    return x.join(wanted, "doc_id").distinct()


def fit(x: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, float]:
    """Weights and threshold of a sample of the labelled rows; ``fit_all`` starts from the weights.

    The rows are counted first, so that only about a sample of them, by a bound of their
    hash, leaves the tasks, however many tasks and rows there are.
    """
    part = F.pmod(F.xxhash64("doc_id", "x"), F.lit(PARTS))
    labelled = written(labelled_rows(x, labels, learn).withColumn("part", part), "sampled")
    bound = -(-PARTS * (SAMPLE + SAMPLE // 10) // max(1, labelled.count()))
    rows = (
        labelled.where(F.col("part") < bound).orderBy("part", "doc_id", "quality", "x").limit(SAMPLE)
        .select("x", "quality").collect()
    )
    if len(rows) < 2:
        return np.zeros(len(FEATURES)), 0.0
    matrix, good = np.array([r.x for r in rows]), np.array([r.quality == 1 for r in rows])
    weights = bradley_terry(matrix, good)
    return weights, threshold(matrix @ weights, float(1 - good.mean()))


def differences(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> np.ndarray:
    """Feature differences of pairs of a good and a bad row: PAIRS_PER_ROW times as many as rows, each row in as many at least."""
    draw, n = np.random.default_rng(seed), PAIRS_PER_ROW * (len(good) + len(bad))
    won, lost = (np.concatenate([draw.permutation(len(x)) for _ in range(-(-n // len(x)))])[:n] for x in (good, bad))
    return good[won] - bad[lost]


def slopes(difference: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the summed loss of pairs."""
    p = 1.0 / (1.0 + np.exp(-np.clip(difference @ weights, -30, 30)))
    return difference.T @ (1.0 - p), (difference * (p * (1.0 - p))[:, None]).T @ difference


def in_blocks(labelled: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """block, good, bad: the rows of a block, their features one after the other."""
    blocks = -(-(n_good + n_bad) // BLOCK)
    copies = [min(blocks, max(1, -(-blocks * LEAST // n))) for n in (n_good, n_bad)]
    first = F.xxhash64("doc_id", "x")
    turns = F.sequence(F.lit(0), F.when(F.col("quality") == 1, copies[0]).otherwise(copies[1]) - 1)
    rows = labelled.select("doc_id", "x", "quality", first.alias("first"), F.explode(turns).alias("turn"))
    row = F.struct("first", "doc_id", "x")
    kinds = [F.sort_array(F.collect_list(F.when(F.col("quality") == q, row))).alias(k) for q, k in ((1, "good"), (0, "bad"))]
    dealt = rows.groupBy(F.pmod(F.pmod(F.col("first"), F.lit(blocks)) + F.col("turn"), F.lit(blocks)).alias("block")).agg(*kinds)
    return dealt.select("block", *[F.flatten(F.col(f"{k}.x")).alias(k) for k in ("good", "bad")])


def newton(blocks: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Weights of the strength, by Newton steps on the pairs of all blocks; a step brings one row of sums a task to the driver."""
    size = len(weights)
    for _ in range(STEPS):

        def sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                for block, *sides in zip(*batch.columns, strict=True):
                    good, bad = (np.asarray(side.values).reshape(-1, size) for side in sides)
                    if len(good) and len(bad):
                        pairs = differences(good, bad, block.as_py())
                        gradient, curvature = slopes(pairs, weights)
                        total += np.concatenate([[len(pairs)], gradient, curvature.ravel()])
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64()))})

        total = np.sum([r.total for r in sorted(blocks.mapInArrow(sums, "total array<double>").collect())], axis=0)
        n = total[0]
        if not n:
            break
        gradient = total[1 : 1 + size] / n - RIDGE * weights
        curvature = total[1 + size :].reshape(size, size) / n + RIDGE * np.eye(size)
        step = np.linalg.solve(curvature, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def strength(weights: np.ndarray) -> Column:
    return sum((F.col("x")[i] * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


def exact_threshold(scores: DataFrame, n: int, n_bad: int) -> float:
    """Below it lie ``n_bad`` of the ``n`` scores: halfway between its neighbours in the order of all.

    Only the different scores between two approximate quantiles around it reach the driver.
    """
    at = min(max(n_bad, 1), n - 1)
    around = [min(max(at / n + d, 0.0), 1.0) for d in (-3 / ACCURACY, 3 / ACCURACY)]
    low, high = scores.agg(F.percentile_approx("score", around, ACCURACY)).first()[0]
    low = low if around[0] > 0 else -np.inf
    high = high if around[1] < 1 else np.inf
    below = scores.where(F.col("score") < F.lit(float(low))).count()
    near = scores.where(F.col("score").between(F.lit(float(low)), F.lit(float(high)))).groupBy("score").count().collect()
    near = sorted((r["score"], r["count"]) for r in near)
    reach = below + np.cumsum([c for _, c in near])
    left, right = (near[int(np.searchsorted(reach, k))][0] for k in (at, at + 1))
    return float((left + right) / 2)


def fit_all(x: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, float]:
    """Weights and threshold from all distinct labelled rows for which ``learn`` holds.

    The loss has one minimum; a sample only decides from where the steps set out for it.
    """
    labelled = written(labelled_rows(x, labels, learn), "labelled")
    n, n_good = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    n_bad = n - int(n_good)
    if n < 2:
        return np.zeros(len(FEATURES)), 0.0
    weights = np.zeros(len(FEATURES))
    if 0 < n_bad < n:
        start, _ = fit(labelled.select("doc_id", "x"), labels, learn)
        weights = newton(written(in_blocks(labelled, n - n_bad, n_bad), "blocks"), start)
    return weights, exact_threshold(labelled.select(strength(weights).alias("score")), n, n_bad)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learns only from labels of ids outside the held-out fold. A null text counts as
    an empty one; a null id is scored and not held out; repeated rows get a row each;
    labels that are null or not 0 or 1 are ignored. Without labels of both kinds all
    scores are 0.5. Other columns are not read.
    """
    x = written(featured(docs), "features")
    weights, at = fit_all(x, labels, fold("doc_id", folds) != held_out)
    scored = x.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(at) - strength(weights)))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
