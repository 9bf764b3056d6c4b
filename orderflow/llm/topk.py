"""Exact top-k inner products by columnar branch and bound.

Queries go to the executors in blocks of bounded size, one block after the other; a block's result is
written to the checkpoint folder before the next one is fetched, so the driver holds one block at a time.
Every candidate partition is laid out vertically (one row for each dimension). Scores are accumulated one
block of dimensions at a time for all queries of the block. After each block the norms of what remains
give an upper bound of each score (Cauchy-Schwarz); candidates that no query can still use are compacted
away, and once few (query, candidate) pairs survive, the rest is computed for these pairs alone. A
query's threshold starts at its k-th best score among a sample of the block's own vectors, a valid lower
bound because they are candidates too, and rises with the partition's own results.

Each partition keeps k rows of a query at most; the last ranking is by query row.

Components become floor(scale * x) as exact integers of any size. Products whose bound fits 2^52 are made
in doubles, below 2^62 in 64-bit integers, and beyond that in Python's integers, without pruning.

Defined results: vectors that are null, or hold null or non-finite components (or ones that scale beyond
doubles), take no part; only vectors of the same number of dimensions are compared; a score beyond 64
bits is given as the nearest long, and ranked as that; ties go to the smaller id; rows with a null id
take no part; repeated ids are candidates one by one, and none of them for itself; a repeated query row
is ranked on its own, under the same query_id; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderflow.llm.common import bounded_batches, checkpointed

K = 20
BLOCK_BYTES = 8 << 20
SAMPLE = 1024
DIMENSIONS = 16
#: Share of surviving pairs below which only these are computed.
SPARSE = 0.05
#: Candidates and (queries x candidates) cells worked on at a time.
PART, CELLS = 4096, 1 << 21
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and the cells floor(scale * x), whole numbers as doubles (exact: a double's integer part is one)."""
    cells = F.transform("v", lambda x: x * F.lit(float(scale)))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.select("id", cells.alias("v")).where(~bad)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of cells: 64-bit integers where all fit with room to spare, else Python's integers."""
    cells = np.floor(np.array(column.flatten(), dtype=np.float64)).reshape(len(column), dims)
    if np.abs(cells).max(initial=0) < 2**61:
        return cells.astype(np.int64)
    return np.array([[int(x) for x in row] for row in cells.tolist()], dtype=object).reshape(cells.shape)


def wide(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of rows of a and b could pass 62 bits."""
    return a.dtype == object or b.dtype == object or int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] >= 1 << 62


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product of integers that fits 62 bits: in doubles where these are exact, else in longs."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product of integers of any size, as the nearest longs."""
    return np.clip(a.astype(object) @ b.astype(object), LEAST, MOST).astype(np.int64) if a.shape[1] else np.zeros((a.shape[0], b.shape[1]), np.int64)


class Block:
    """Queries of one number of dimensions, with a lower bound of each k-th best score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tails = [np.sqrt((vectors[:, d:].astype(np.float64) ** 2).sum(axis=1)) for d in range(0, vectors.shape[1], DIMENSIONS)]
        self.least = np.full(len(ids), LEAST, np.int64)
        own = vectors[:SAMPLE]
        for at in range(0, len(ids) if not wide(vectors, vectors) else 0, 512):
            scores = _exact(vectors[at : at + 512], own.T)
            scores[ids[at : at + 512, None] == ids[None, :SAMPLE]] = LEAST
            if scores.shape[1] > k:
                self.least[at : at + 512] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: by score, ties to the smaller id."""
    order = np.lexsort((ids, ~s, q))  # ~s falls as s rises, and has no overflow
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q, side="left") < k]


def search(block: Block, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, score) of one part of the candidates."""
    found = []
    upright = np.ascontiguousarray(vectors.T)  # one row for each dimension
    step = max(1, CELLS // max(1, len(ids)))
    whole = wide(block.vectors, vectors)
    for a in range(0, len(block.ids), step):
        rows = np.arange(a, min(a + step, len(block.ids)))
        if whole or not len(upright):
            total = _plain(block.vectors[rows], upright)
            q, c = (x.ravel() for x in np.indices(total.shape))
            s = total.ravel()
        else:
            q, c, s = _bounded(block, rows, upright)
        own = ids[c] != block.ids[rows[q]]
        q, c, s = rows[q[own]], ids[c[own]], s[own]
        best = _best(q, c, s, block.k)
        found.append((q[best], c[best], s[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bounded(block: Block, rows: np.ndarray, upright: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in rows, place of the candidate, score) of the pairs that reach the queries' thresholds."""
    starts = list(range(0, len(upright), DIMENSIONS))
    tails = [np.sqrt((upright[d:].astype(np.float64) ** 2).sum(axis=0)) for d in starts]
    least = block.least[rows]
    alive = np.arange(upright.shape[1])
    total, pairs = np.zeros((len(rows), len(alive)), dtype=np.int64), None
    for i, d in enumerate(starts):
        part = block.vectors[rows, d : d + DIMENSIONS]
        last = i + 1 == len(starts)
        if pairs is None:
            total = total + _exact(part, upright[d : d + DIMENSIONS, alive])
            most = total.astype(np.float64) + (0 if last else _reach(block.tails[i + 1][rows][:, None], tails[i + 1][alive][None, :]))
            good = total >= least[:, None] if last else most >= _below(least)[:, None]
            if last or good.sum() < SPARSE * good.size:
                q, c = np.nonzero(good)
                pairs, total = (q, alive[c]), total[q, c]
            elif (kept := good.any(axis=0)).sum() < 0.8 * len(alive):
                alive, total = alive[kept], total[:, kept]
        else:
            q, c = pairs
            total = total + np.einsum("ij,ji->i", part[q], upright[d : d + DIMENSIONS, c])
            most = total.astype(np.float64) + (0 if last else _reach(block.tails[i + 1][rows[q]], tails[i + 1][c]))
            good = total >= least[q] if last else most >= _below(least)[q]
            pairs, total = (q[good], c[good]), total[good]
    return *pairs, total


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the remaining dimensions can add, with room for rounding."""
    return a * b * (1 + 1e-9) + 1e-3


def _below(least: np.ndarray) -> np.ndarray:
    """A double not above the threshold nor the sums' rounding."""
    x = least.astype(np.float64)
    return x - np.abs(x) * 1e-12


def top_k(vectors: DataFrame, *, is_query: Column, k: int = K, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, id and score for each row that `is_query` holds for, against all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = checkpointed(quantised(vectors, id_col, vec_col, scale))
    queries = rows.where(is_query)
    sizes = {r.d: r["count"] for r in queries.groupBy(F.size("v").alias("d")).count().collect()}
    parts = []
    for d, many in sorted(sizes.items()):
        blocks = -(-many * (d + 2) * 8 // block_bytes)
        place = F.pmod(F.xxhash64("id", "v"), F.lit(blocks))
        for b in range(blocks):
            own = queries.where((F.size("v") == d) & (place == b)) if blocks > 1 else queries.where(F.size("v") == d)
            got = own.orderBy("id", "v").toArrow()
            if not got.num_rows:
                continue
            shared = spark.sparkContext.broadcast(Block(got["id"].to_numpy(), matrix(got["v"].combine_chunks(), d), k))
            ranked = _ranked(rows.where(F.size("v") == d), shared, d, k)
            if len(sizes) + blocks > 2:
                ranked = checkpointed(ranked)
                shared.destroy()
            parts.append(ranked)
    whole = parts[0] if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _ranked(candidates: DataFrame, shared, d: int, k: int) -> DataFrame:
    """One block's result over all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        given, best, held = block.least, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                best.append(search(block, part.column(0).to_numpy(), matrix(part.column(1), d)))
                held += len(best[-1][0])
                if held > 4 * k * len(block.ids):
                    best = [_merged(best, k)]
                    held = len(best[0][0])
                    block.least = _raised(given, best[0], k)
        block.least = given
        if best:
            q, c, s = _merged(best, k)
            for at in range(0, len(q), 10_000):
                cut = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[cut]), pa.array(block.ids[q[cut]]), pa.array(c[cut]), pa.array(s[cut])], names=["q", "query_id", "vec_id", "score"])

    found = candidates.mapInArrow(run, "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(best: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, c, s = (np.concatenate(x) for x in zip(*best, strict=True))
    keep = _best(q, c, s, k)
    return q[keep], c[keep], s[keep]


def _raised(least: np.ndarray, best: tuple, k: int) -> np.ndarray:
    q, _, s = best
    full = np.bincount(q, minlength=len(least)) >= k
    low = np.full(len(least), MOST, np.int64)
    np.minimum.at(low, q, s)
    return np.where(full, np.maximum(least, low), least)


ORACLE = r"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
k as (select *, row_number() over (partition by s.r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from k where rank <= 20
"""
