"""Exact integer k-means whose assignments are filtered by PCA-rotated coordinates.

Vectors become integers.  Each is stored with its leading coordinates in the basis of the table's principal components and the norm
of what these leave.  The squared distance of two vectors is at least that of their leading coordinates plus the squared difference
of their residual norms; centroids whose bound lies above a distance already known are skipped, and the survivors' distances are
computed in integers.  A round sends the driver one sum per centroid and component, never a vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import discard, shared, stored, table

CLUSTERS, ROUNDS, SCALE, SEED, DIMS = 8, 10, 1024, 3, 64
EXPLAINED = 0.75  # share of the variance that the stored rotated coordinates hold
ROWS = 8192  # vectors assigned at a time
RANGE = 1 << 27  # of integer components: squared distances of 64 such components fit in 62 bits
SLACK = 1e-10  # relative to the squared norms; rounding loses less than 1e-12 of them


class Rotation:
    """An origin and the leading principal directions."""

    def __init__(self, origin: np.ndarray, directions: np.ndarray):
        self.origin, self.directions = origin, directions

    @classmethod
    def of_moments(cls, n: float, sums: np.ndarray, products: np.ndarray, explained: float) -> Rotation:
        """With as many directions as explain the share ``explained`` of the variance, one at least."""
        mean = sums / n
        values, vectors = np.linalg.eigh(products / n - np.outer(mean, mean))
        share = np.cumsum(np.maximum(values[::-1], 0))
        return cls(mean, vectors[:, ::-1][:, : 1 + int(np.searchsorted(share, explained * share[-1]))])

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norm of each row."""
        x = q - self.origin
        lead = x @ self.directions
        return lead, np.linalg.norm(x - lead @ self.directions.T, axis=1)


def assign(q: np.ndarray, lead: np.ndarray, residual: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and for how many centroids it was computed."""
    c_lead, c_residual = rotation(centroids)
    bound = (residual[:, None] - c_residual) ** 2
    for j in range(lead.shape[1]):
        bound += (lead[:, j, None] - c_lead[:, j]) ** 2
    norms = (lead * lead).sum(axis=1) + residual * residual
    bound -= SLACK * (norms[:, None] + (c_lead * c_lead).sum(axis=1) + c_residual * c_residual)
    cluster = bound.argmin(axis=1)
    distance = ((q - centroids[cluster]) ** 2).sum(axis=1)
    tried = np.zeros(bound.shape, bool)
    tried[np.arange(len(q)), cluster] = True
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= distance) & ~tried[:, j])
        d = ((q[rows] - centroids[j]) ** 2).sum(axis=1)
        tried[rows, j] = True
        better = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = j, d[better]
    return cluster, distance, tried.sum(axis=1)


def usable(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, q array<int>`` of the vectors with ``dims`` components, all finite and within RANGE once scaled."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    fine = (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= RANGE))
    return rows.where(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def matrix(column: pa.Array, dims: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)


def _moments(dims: int):
    def run(batches):
        n, sums, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                q = matrix(batch["q"].slice(at, ROWS), dims, np.float64)
                n, sums, products = n + len(q), sums + q.sum(axis=0), products + q.T @ q
        if n:
            all_ = np.concatenate([[n], sums, products.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(all_)), pa.int32()), pa.array(all_)], names=["pos", "s"])

    return run


def _indexed(dims: int, rotation):
    def run(batches):
        rotate = rotation()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lead, residual = rotate(matrix(part["q"], dims, np.float64))
                offsets = pa.array(np.arange(len(lead) + 1) * lead.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["q"], pa.ListArray.from_arrays(offsets, pa.array(lead.reshape(-1))), pa.array(residual)], names=["vec_id", "q", "lead", "residual"])

    return run


def _assigned(dims: int, state):
    """Batches of index rows with their assignments."""

    def each(batches):
        centroids, rotation = state()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q = matrix(part["q"], dims)
                yield part["vec_id"], q, *assign(q, matrix(part["lead"], rotation.directions.shape[1], np.float64), part["residual"].to_numpy(), centroids, rotation)

    return each


def _sums(dims: int, k: int, each):
    def run(batches):
        sums = np.zeros((k, dims + 1), np.int64)  # the last place counts
        for _, q, cluster, _, _ in each(batches):
            for j in range(k):
                own = q[cluster == j]
                sums[j, :dims] += own.sum(axis=0)
                sums[j, dims] += len(own)
        c, pos = np.nonzero(sums)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(pos, pa.int32()), pa.array(sums[c, pos])], names=["cluster", "pos", "s"])

    return run


def _last(each):
    def run(batches):
        for ids, _, cluster, distance, tried in each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(tried, pa.int32())], names=["vec_id", "cluster", "distance", "n_verified"])

    return run


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, dims: int = DIMS, explained: float = EXPLAINED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` and ``n_verified``, the centroids whose distance was computed.

    Centroids start as the ``k`` vectors whose ``seed:vec_id`` has the smallest sha256 (rows that repeat a vec_id: the smaller vector
    first; rows without one come last).  A round assigns each vector to its nearest centroid, the smaller number on ties, and moves each
    centroid to the floor of its vectors' mean; empty ones stay.  Rounds after one that moves nothing change nothing and are left out.
    Vectors that are null, of another length, or hold a null, NaN or infinite component have no row, nor those with a component of
    RANGE or more once scaled, whose distances 64 bits needn't hold.  Fewer vectors than ``k``: as many centroids.  Rows that repeat a
    vec_id are vectors of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, dims, scale))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "q").limit(k).select("q").collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_verified int"
    if not first:
        return spark.createDataFrame([], result)
    centroids = np.array([r["q"] for r in first], np.int64)
    moments = {r["pos"]: r["s"] for r in rows.select("q").mapInArrow(_moments(dims), "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect()}
    flat = np.array([moments[i] for i in range(1 + dims + dims * dims)])
    rotation = Rotation.of_moments(flat[0], flat[1 : dims + 1], flat[dims + 1 :].reshape(dims, dims), explained)
    index = stored(rows.mapInArrow(_indexed(dims, shared(spark, rotation)), "vec_id long, q array<int>, lead array<double>, residual double"))
    discard(rows)
    for _ in range(rounds):
        each = _assigned(dims, shared(spark, (centroids, rotation)))
        found = index.mapInArrow(_sums(dims, len(centroids), each), "cluster int, pos int, s long").groupBy("cluster", "pos").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros((len(centroids), dims + 1), np.int64)
        for r in found:
            sums[r["cluster"], r["pos"]] = r["s"]
        some = sums[:, dims] > 0
        moved = centroids.copy()
        moved[some] = sums[some, :dims] // sums[some, dims:]
        if (moved == centroids).all():
            break
        centroids = moved
    final = stored(index.mapInArrow(_last(_assigned(dims, shared(spark, (centroids, rotation)))), "vec_id long, cluster int, distance long, n_verified int"))
    discard(index)
    inertia = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(j, s, sum(inertia.values()), digest[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select(*(x.split()[0] for x in result.split(", ")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("n_verified")


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds one after the other, each as two common table expressions."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (
  select v.r, c.c, cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)]) as bigint) as d from v cross join c{i} c
  qualify row_number() over (partition by v.r order by d, c.c) = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} as materialized (
  select c.c, coalesce(m.q, c.q) as q from c{i} c left join (
    select c, list((s - ((s % n) + n) % n) // n order by i) as q from (
      select a.c, i, cast(sum(v.q[i]) as bigint) as s, count(*) as n from a{i} a join v using (r) cross join range(1, {DIMS + 1}) t(i) group by a.c, i
    ) group by c
  ) m on m.c = c.c
)""")
    return f"""
with e as (
  select row_number() over () as r, vec_id, embedding from embeddings
  where len(embedding) = {DIMS} and len([x for x in embedding if x is null or isnan(x) or isinf(x) or abs(cast(x as double) * {SCALE}) >= {RANGE}]) = 0
), v as materialized (select r, vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as q from e),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, q) - 1 as c, q from v qualify c < {CLUSTERS}),
{", ".join(steps)}
select v.vec_id, cast(a.c as int) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256
from a{rounds} a join v using (r) join c{rounds} c on c.c = a.c
"""


ORACLE = oracle()
