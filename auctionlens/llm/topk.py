"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Candidates are laid in blocks of like length of their vectors; a block sorts every
dimension once. A query starts from the k-th best score among a bounded sample of
long vectors. What the heads of a block's lists allow at most decides whether a
query meets the block at all. There it reads the lists that add most to that bound,
from the end that its sign favours, scores what it meets, and stops when the best
score that unseen vectors can still reach is below its k-th result. The few best of
every block meet in one aggregation per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auctionlens.llm.common import written

K, SCALE, EVERY = 5, 256.0, 50
#: Values of the candidates of a block at most; queries of a part, and parts that meet a block in one task.
VALUES, QUERIES, PARTS = 1 << 18, 512, 16
#: Blocks laid by one task, and blocks whose bounds one task holds against a part of the queries, about.
LAID, BOUNDS = 16, 256
#: Long vectors that all queries start from, about, and how many times as many they are drawn from.
SEEDS, LONGEST = 1024, 4
#: Depth of the first sorted access to a list; each further one is GROWTH times as deep.
DEPTH, GROWTH = 32, 2
#: Least score there is.
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 x) of every component; vectors that are null or hold a null or no finite number are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(SCALE)))
    return vectors.where("vec_id is not null and embedding is not null").where(~bad).select("vec_id", whole.alias("v"))


def block_top(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, floors: np.ndarray | None = None,
    scored: list[int] | None = None,
):
    """(query, vec_id, score) of each query's k best in a block, by sorted access and a threshold.

    Results below a query's floor may be left out. All queries that are still open go down the same lists, those that
    add most to their bounds; a vector that one of them meets is scored for all of them in one product. ``scored``
    takes how many scores each step computed.
    """
    by_id = np.argsort(ids, kind="stable")  # so that a stable sort by score leaves ties to the smaller id
    ids, x = ids[by_id], x[by_id]
    n, dims = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    # Doubles hold the sums exactly below 2 ** 53 and multiply faster.
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims < 2**53
    kind = np.float64 if exact else np.int64
    x, queries, lists = x.astype(kind), queries.astype(kind), lists.astype(kind)
    none = -np.inf if exact else NONE
    best = np.full((len(queries), k), none, kind)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.full(len(queries), none, kind)
    if floors is not None:
        floor[floors != NONE] = floors[floors != NONE].astype(kind)
    open_, met = np.arange(len(queries)), np.zeros(n, bool)
    depth, every = np.zeros(dims, np.int64), np.arange(dims)
    while n:
        # What no vector beyond the depths can exceed; an equal score could still have a smaller id.
        high, low = lists[np.maximum(n - 1 - depth, 0), every], lists[np.minimum(depth, n - 1), every]
        most = np.maximum(queries[open_], 0) * high + np.minimum(queries[open_], 0) * low
        worst = np.maximum(best[open_, -1], floor[open_])
        still = (worst == none) | (most.sum(axis=1) >= worst)
        open_, most = open_[still], most[still]
        if not len(open_):
            break
        share = most.sum(axis=0)
        deeper = np.flatnonzero(share >= np.median(share))
        q, fresh = queries[open_], np.zeros(n, bool)
        up, down = (q > 0).any(axis=0), (q < 0).any(axis=0)
        new = np.minimum(n, np.maximum(DEPTH, depth[deeper] * GROWTH))
        if (new == n).any():
            fresh[:] = True
        else:
            for j, a, b in zip(deeper, depth[deeper], new):
                fresh[order[n - b : n - a, j]] |= up[j]
                fresh[order[a:b, j]] |= down[j]
        depth[deeper] = new
        fresh &= ~met
        met |= fresh
        at = np.flatnonzero(fresh)
        if scored is not None:
            scored.append(len(at) * len(open_))
        if len(at):
            scores = x[at] @ q.T
            scores[ids[at][:, None] == query_ids[open_][None, :]] = none
            top = np.argsort(-scores if exact else ~scores, axis=0, kind="stable")[:k]
            some = np.concatenate([best[open_], np.take_along_axis(scores, top, axis=0).T], axis=1)
            some_id = np.concatenate([best_id[open_], ids[at][top].T], axis=1)
            some_id[some == none] = np.iinfo(np.int64).max
            first = np.lexsort((some_id, -some if exact else ~some), axis=1)[:, :k]
            best[open_] = np.take_along_axis(some, first, axis=1)
            best_id[open_] = np.take_along_axis(some_id, first, axis=1)
        if met.all():
            break
    row, rank = np.nonzero((best != none) & (best >= floor[:, None]))
    return query_ids[row], best_id[row, rank], best[row, rank].astype(np.int64)


_BLOCK = "dims int, block bigint, ids array<bigint>, v array<bigint>, high array<bigint>, low array<bigint>"
_PART = "dims int, part int, ids array<bigint>, v array<bigint>, floors array<bigint>"


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False)


def _row(schema: str, *values) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    arrays = [pa.array([v], pa.list_(pa.int64())) if isinstance(v, np.ndarray) else v for v in values]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def laid(whole: DataFrame, blocks: int) -> DataFrame:
    """One row for each block: vectors of one number of dimensions and of like length, and the heads of their lists."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of one number of dimensions, less than a block of them
        dims = count = 0
        base = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal base
            ids, x = (np.concatenate(part) for part in zip(*held))
            base += 1
            held.clear()
            return _row(
                _BLOCK, pa.array([dims], pa.int32()), pa.array([base], pa.int64()), ids, x.ravel(), x.max(axis=0), x.min(axis=0)
            )

        for batch in batches:
            all_dims, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = _numbers(batch.column(2)), np.cumsum(all_dims, dtype=np.int64)
            at = 0
            while at < len(ids):
                if held and (all_dims[at] != dims or count >= max(1, VALUES // dims)):
                    yield block()
                if not held:
                    dims, count = int(all_dims[at]), 0
                room = max(1, VALUES // dims) - count
                other = np.flatnonzero(all_dims[at : at + room] != dims)
                last = at + (int(other[0]) if len(other) else min(room, len(ids) - at))
                held.append((ids[at:last], flat[ends[at] - dims : ends[last - 1]].reshape(-1, dims)))
                count, at = count + last - at, last
        if held:
            yield block()

    # Equal vectors are dealt by their ids, so that a vector with many copies fills many blocks.
    apart = whole.repartitionByRange(-(-blocks // LAID), "dims", "norm", F.xxhash64("vec_id", "v"))
    return apart.sortWithinPartitions("dims", F.desc("norm")).select("dims", "vec_id", "v").mapInArrow(rows, _BLOCK)


def seeds(whole: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by number of dimensions of about SEEDS of the longest vectors, drawn by a bound of their hash."""
    share = min(1.0, LONGEST * SEEDS / max(1, n))
    least = whole.agg(F.percentile_approx("norm", 1.0 - share, 1000).alias("least"))
    longest = whole.join(least, F.col("norm") >= F.col("least"))
    parts = 1 << 30
    part = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(parts))
    bound = -(-parts * SEEDS // max(1, longest.count()))
    found: dict[int, list] = {}
    for r in longest.where(part < bound).select("dims", "vec_id", "v").distinct().collect():
        found.setdefault(r.dims, []).append((r.vec_id, r.v))
    return {d: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.int64)) for d, rows in found.items()}


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every query, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by ``every``. Vectors of another
    length than a query's are no candidates of it; those without components have no
    results. Of rows that repeat a vec_id each is a candidate, but for the query's own
    id; of a query's rows the least vector is the query. Other columns are not read.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    whole = written(quantised(vectors).withColumn("dims", F.size("v")).where("dims > 0").withColumn("norm", norm), "vectors")
    n, values = whole.agg(F.count("*"), F.sum("dims")).first()
    blocks = written(laid(whole, max(1, -(-(values or 0) // VALUES))), "blocks")
    asked = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("q"))
    asked = written(asked.select("q.dims", "vec_id", "q.v"), "queries")
    first = seeds(whole, n)

    def part_of(key: tuple, rows: pa.Table) -> pa.Table:
        dims, part = (s.as_py() for s in key)
        ids, x = rows["vec_id"].to_numpy(), _numbers(rows["v"]).reshape(-1, dims)
        floors = np.full(len(ids), NONE)
        if dims in first:
            of, y = first[dims]
            scores = x @ y.T
            scores[ids[:, None] == of[None, :]] = NONE
            # The k-th best row: of ids that repeat, each is a candidate.
            if len(of) >= k:
                floors = np.partition(scores, len(of) - k, axis=1)[:, len(of) - k]
        return pa.Table.from_batches([
            _row(_PART, pa.array([dims], pa.int32()), pa.array([part], pa.int32()), ids, x.ravel(), floors)
        ])

    parts = max(1, -(-asked.count() // QUERIES))
    groups = max(1, -(-blocks.count() // BOUNDS))
    dealt = lambda column, count, seed: F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = written(
        asked.withColumn("part", dealt("vec_id", parts, 2)).groupBy("dims", "part").applyInArrow(part_of, _PART), "parts"
    )

    def bounded(heads: pa.Table, part: pa.Table) -> pa.Table:
        """The queries of a part that the lists of a block may serve, by block."""
        found = []
        if heads.num_rows and part.num_rows:
            dims = part["dims"][0].as_py()
            ids, floors = _numbers(part["ids"]), _numbers(part["floors"])
            q = _numbers(part["v"]).reshape(-1, dims).astype(float)
            high, low = (_numbers(heads[c]).reshape(-1, dims).astype(float) for c in ("high", "low"))
            most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            # Rounding of doubles must not lose an equal score.
            serves = (floors == NONE)[:, None] | (most * (1 + 1e-9 * np.sign(most)) + 1 >= floors[:, None])
            for i, block in enumerate(heads["block"].to_pylist()):
                at = np.flatnonzero(serves[:, i])
                if len(at):
                    found.append((block, part["part"][0].as_py() // PARTS, dims, ids[at], q[at].astype(np.int64).ravel(), floors[at]))
        columns = list(zip(*found)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
        names = ["block", "chunk", "dims", "ids", "v", "floors"]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    heads = blocks.select("dims", "block", "high", "low", dealt("block", groups, 1).alias("group"), all_of(parts).alias("part"))
    spread = queries.select("*", all_of(groups).alias("group"))
    keys = ("dims", "group", "part")
    work = written(
        heads.groupBy(*keys).cogroup(spread.groupBy(*keys))
        .applyInArrow(bounded, "block bigint, chunk int, dims int, ids array<bigint>, v array<bigint>, floors array<bigint>"),
        "work",
    )
    wanted = blocks.select("block", "ids", "v").join(work.select("block", F.col("chunk").alias("of")).distinct(), "block")

    def search(block: pa.Table, open_: pa.Table) -> pa.Table:
        columns: tuple = ((), (), ())
        if block.num_rows and open_.num_rows:
            dims = open_["dims"][0].as_py()
            grid = lambda t: _numbers(t["v"]).reshape(-1, dims)
            columns = block_top(
                _numbers(block["ids"]), grid(block), _numbers(open_["ids"]), grid(open_), k, _numbers(open_["floors"])
            )
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = wanted.groupBy("block", "of").cogroup(work.groupBy("block", "chunk")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score bigint"
    )
    # k rows per query and block: few, and bounded for a query by the number of blocks.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, vec_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
FROM pairs QUALIFY rank <= {K}
"""
