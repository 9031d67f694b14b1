"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Every component becomes floor(scale * x).  Candidates lie in blocks.  A block's index holds posting lists: for each dimension the
rows ordered by quantised impact, cut into segments of equal impact.  For a query, the segments of all dimensions are ordered by
what their rows can gain over the dimension's least segment, and processed in that order: each adds its gain to its rows.  After
each round of segments a row can still gain, in each dimension where it wasn't met, what the best segment left there offers; rows
whose bound lies below the score of k others are proven out.  The search stops once all but a small part are, and scores these exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import discard, sorted_groups, stored, table

BLOCK = 4096  # candidates of a block
QUERY_BLOCK = 8192
LEVELS = 32  # quantised impacts of a dimension within a block
FIRST, ROUND = 0.5, 0.125  # shares of a block's postings processed before the first test of the bounds, and between tests
LIVE = 16  # the search stops once all but the 16th part of a block's rows are proven out


class BlockIndex:
    """Posting segments of a block of integer vectors: per dimension and quantised impact the rows that have it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, d = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.level = ((vectors - low) // step).astype(np.int8)
        self.postings = np.ascontiguousarray(np.argsort(self.level, axis=0, kind="stable").T)
        self.impact = np.take_along_axis(np.ascontiguousarray(self.level.T), self.postings, axis=1)
        self.size = np.stack([np.bincount(self.level[:, k], minlength=LEVELS) for k in range(d)])
        floor = low[:, None] + np.arange(LEVELS) * step[:, None]  # least and largest impact of each segment
        self.ends = floor.astype(np.float64), (floor + step[:, None] - 1).astype(np.float64)

    def plan(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Gains by dimension and level; the filled segments by descending gain, as (dimension, level); the sum of the dimensions' least contributions."""
        q = query[:, None].astype(np.float64)
        most = np.where(self.size > 0, np.maximum(q * self.ends[0], q * self.ends[1]), np.inf)
        least = most.min(axis=1)
        gain = most - least[:, None]
        d, level = np.nonzero(self.size)
        order = np.argsort(-gain[d, level], kind="stable")
        return gain, d[order], level[order], float(least.sum())

    def search(self, queries: np.ndarray, k: int, skip: list[slice]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, positions and scores of the ``k`` best rows, those of its ``skip`` left out; ties at the last place are all there."""
        return [self.best(q, k, left_out)[:2] for q, left_out in zip(queries, skip)]

    def best(self, query: np.ndarray, k: int, skip: slice, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """As ``search`` for one query, and the number of segments that were processed.

        Rows that score below ``bar`` may be missing: the caller knows k rows of that score elsewhere.
        """
        n, dims = self.vectors.shape
        gain, d, level, base = self.plan(query)
        sizes = self.size[d, level]
        behind = np.cumsum(sizes)
        slack = 1e-6 * (gain[:, [0, -1]].max(axis=1, initial=0, where=np.isfinite(gain[:, [0, -1]])).sum() + abs(base) + 1)  # more than rounding can lose
        upward = query <= 0  # a dimension's segments gain most at this end, so the processed ones are a run of its postings
        met, taken = np.zeros(n), np.zeros(dims, np.int64)
        out = np.ones(n, bool)
        out[skip] = False
        live, at, share = np.flatnonzero(out), 0, FIRST
        while at < len(d) and len(live) > max(4 * k, n // LIVE):
            at = min(len(d), int(np.searchsorted(behind, share * n * dims)) + 1)
            share += ROUND
            now = np.bincount(d[:at], sizes[:at], dims).astype(np.int64)
            for j, (a, b, up) in enumerate(zip(taken.tolist(), now.tolist(), upward.tolist())):
                if b > a:
                    run = slice(a, b) if up else slice(n - b, n - a)
                    met[self.postings[j, run]] += gain[j][self.impact[j, run]]
            taken = now
            left = np.zeros(dims)
            left[d[at:][::-1]] = gain[d, level][at:][::-1]  # the largest of each dimension is written last
            lowest, highest = np.full(dims, LEVELS, np.int8), np.full(dims, -1, np.int8)
            np.minimum.at(lowest, d[:at], level[:at].astype(np.int8))
            np.maximum.at(highest, d[:at], level[:at].astype(np.int8))
            seen = (self.level >= lowest) & (self.level <= highest)
            bound = base + met + left.sum() - seen.astype(np.float32) @ left.astype(np.float32) + slack
            top = live[np.argpartition(bound[live], len(live) - 4 * k)[len(live) - 4 * k :]] if len(live) > 4 * k else live
            scores = self.vectors[top] @ query
            if len(scores) >= k:
                bar = max(bar, np.partition(scores, len(scores) - k)[len(scores) - k])
            live = live[bound[live] >= bar]
        scores = self.vectors[live] @ query
        if len(live) > k:
            keep = scores >= np.partition(scores, len(live) - k)[len(live) - k]
            live, scores = live[keep], scores[keep]
        return live, scores, at


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, q array<long>`` of the rows whose vectors are non-empty and have only finite components."""
    v = F.col("embedding")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _search(k: int):
    def run(batches):
        bars: dict[int, tuple[int, dict[int, int]]] = {}  # of the query block at hand: each query row's k-th best score so far
        for t, starts in sorted_groups(batches, ["qb", "cb"]):
            ends = np.append(starts[1:], t.num_rows)
            ids, keys, is_query, dims, blocks = t["vec_id"].to_numpy(), t["row"].to_numpy(), t["is_query"].to_numpy(zero_copy_only=False), t["dim"].to_numpy(), t["qb"].to_numpy()
            q = t["q"].combine_chunks()
            for a, b in zip(starts.tolist(), ends.tolist()):
                v = q[a:b].flatten().to_numpy().reshape(b - a, int(dims[a]))
                flag = is_query[a:b].astype(bool)
                own, other = np.flatnonzero(flag), np.flatnonzero(~flag)
                if not len(own) or not len(other):
                    continue
                if (block := int(blocks[a])) not in bars:
                    bars = {block: {}}
                bar = bars[block]
                key = keys[a:b]
                order = other[np.argsort(key[other], kind="stable")]
                at = np.searchsorted(key[order], key[own])
                index, vec_id = BlockIndex(v[order]), ids[a:b][order]
                out: list[tuple[int, int, int, int]] = []
                for row, i in zip(own.tolist(), at.tolist()):
                    mine = int(key[row])
                    rows, scores, _ = index.best(v[row], k, slice(i, i + (i < len(order) and key[order[i]] == mine)), bar.get(mine, -np.inf))
                    best = np.lexsort((vec_id[rows], -scores))[:k]
                    out += [(mine, int(ids[a + row]), int(vec_id[rows[j]]), int(scores[j])) for j in best.tolist()]
                    if len(best) == k:
                        bar[mine] = max(bar.get(mine, int(scores[best[-1]])), int(scores[best[-1]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all other rows with a vector of the same length.
    Fewer than ``k`` candidates: all of them.  Null or empty vectors and those with null, NaN or infinite components, and
    rows without a vec_id, take no part.  Rows that repeat a vec_id, with the same vector or another, are rows of their own:
    each is a candidate of all the others, and each has its own ranking if it is a query.  An empty table gives an empty
    result; other columns are ignored.

    Candidates are dealt to blocks by a hash of their rows, queries to blocks likewise; each pair of blocks is one group of
    bounded size.  Of each group only the k best rows of a query go on, and their last ranking is pre-limited per task.
    """
    rows = stored(quantised(vectors, scale).withColumn("dim", F.size("q").cast("long")).withColumn("row", F.monotonically_increasing_id()))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    by = lambda parts: F.pmod(F.xxhash64("row", F.lit(9)), F.lit(parts)).cast("int")
    shape = F.col("dim") * (1 << 32)  # blocks hold vectors of one length
    cand = rows.withColumn("cb", shape + by(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("is_query", F.lit(False))
    want = queries.withColumn("qb", by(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cb", shape + F.col("cb")).withColumn("is_query", F.lit(True))
    cols = ["qb", "cb", "is_query", "row", "vec_id", "dim", "q"]
    dealt = cand.select(cols).union(want.select(cols)).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "is_query", "row")
    found = stored(dealt.mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long"))
    discard(rows)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (
  select row_number() over () as r, vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
), s as (
  select a.r, a.vec_id as query_id, b.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) as bigint) as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q) where a.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by r order by score desc, vec_id) <= 5
"""
