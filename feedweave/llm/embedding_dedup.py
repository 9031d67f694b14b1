"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors with equal labels collapse to one class first.  Classes whose signs agree in a table share a bucket; a table's
signs are as many as keep buckets small, whatever the number of vectors.  A bucket is compared in tiles of bounded size: first by
all sign bits, which travel without the vectors, then, for the vectors with a partner near enough, by a matrix product in double
precision.  A pair that meets in several tables counts in the first, so links are counted without a list of pairs; towards the
components a tile passes only a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import discard, sorted_groups, stored, table
from feedweave.llm.components import connected_components

LEAST_BITS = 12
BUCKET = 64  # classes of a bucket if directions are spread evenly, about
MISSES = 2e-5  # most that the chance to miss a pair exactly at the limit may be
DEVIATIONS = 7  # of the number of differing signs that a linked pair may have
TILE = 512
SIMILARITY = 0.98


def agreement(similarity: float) -> float:
    """The chance that a hyperplane's sign is the same for two vectors of that cosine."""
    return 1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi


def shape_for(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Tables and bits of each for ``n`` classes: (18, 12) up to 262,144 at 0.98."""
    bits = min(48, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / BUCKET))))
    p = agreement(similarity) ** bits
    return (1 if p >= 1 else math.ceil(math.log(MISSES) / math.log1p(-p))), bits


def most_differing(signs: int, similarity: float) -> float:
    p = 1 - agreement(similarity)
    return signs * p + DEVIATIONS * math.sqrt(signs * p * (1 - p)) + 1


def signs_of(vectors: np.ndarray, signs: int) -> np.ndarray:
    """The signs of the products with random hyperplanes, which depend on the dimension and their number alone."""
    rng = np.random.default_rng(7 + vectors.shape[1])
    return vectors @ rng.standard_normal((vectors.shape[1], signs)) > 0


def codes_of(signs: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One code per table."""
    return signs.reshape(len(signs), tables, bits) @ (1 << np.arange(bits))


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors, each scaled by a power of two so that no square of a component overflows: that changes no cosine."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])


def _coded(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            dims = np.diff(batch["embedding"].offsets.to_numpy())
            signs = np.zeros((batch.num_rows, tables * bits), bool)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                signs[rows] = signs_of(vectors_of(batch["embedding"].take(pa.array(rows)), d), tables * bits)
            codes = codes_of(signs, tables, bits)
            packed = np.packbits(signs, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["rep"], pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1))), pa.array([x.tobytes() for x in packed], pa.binary())],
                names=["rep", "codes", "signs"],
            )

    return run


def unpacked_signs(column: pa.ChunkedArray, signs: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1)[:, :signs]


def _screened(tables: int, bits: int, similarity: float):
    """The rows of each tile that have a partner whose signs differ in no more places than a linked pair's."""
    most = most_differing(tables * bits, similarity)

    def run(batches):
        for t, starts in sorted_groups(batches, ["bucket", "i", "j"]):
            ends = np.append(starts[1:], t.num_rows)
            own, i, j = (t[k].to_numpy() for k in ("own", "i", "j"))
            side = unpacked_signs(t["signs"], tables * bits).astype(np.float32) * 2 - 1
            keep = []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a > 1:
                    near = side[a:b] @ side[a:b].T >= tables * bits - 2 * most
                    if i[a] == j[a]:
                        np.fill_diagonal(near, False)
                    else:
                        near &= own[a:b][:, None] != own[a:b][None, :]
                    keep.append(a + np.flatnonzero(near.any(axis=1)))
            if keep and len(rows := np.concatenate(keep)):
                yield from t.take(pa.array(rows)).combine_chunks().to_batches()

    return run


def forest(links: np.ndarray) -> np.ndarray:
    """Each vertex's smallest reachable vertex in a symmetric boolean matrix."""
    root = np.arange(len(links))
    while True:
        near = np.where(links, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(tables: int, bits: int, similarity: float):
    keys = ["bucket", "i", "j"]

    def run(batches):
        for t, starts in sorted_groups(batches, keys):
            ends = np.append(starts[1:], t.num_rows)
            rep, mult, own, i, j, tab, dims = (t[k].to_numpy() for k in ("rep", "mult", "own", "i", "j", "tab", "dim"))
            codes = codes_of(unpacked_signs(t["signs"], tables * bits), tables, bits)
            emb = t["embedding"].combine_chunks()
            out_a, out_n, out_b = [], [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a < 2:
                    continue
                v = vectors_of(emb[a:b], int(dims[a]))
                unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
                link = unit @ unit.T >= similarity
                if i[a] == j[a]:
                    np.fill_diagonal(link, False)
                else:
                    link &= own[a:b][:, None] != own[a:b][None, :]
                if not link.any():
                    continue
                x, y = np.nonzero(link)
                c = codes[a:b]
                first = ~(c[x, : tab[a]] == c[y, : tab[a]]).any(axis=1) if tab[a] else np.ones(len(x), bool)
                n = np.bincount(x[first], mult[a:b][y[first]], b - a).astype(np.int64)
                root = forest(link)
                some = np.flatnonzero(link.any(axis=1))
                out_a.append(rep[a:b][some])
                out_n.append(n[some])
                out_b.append(rep[a:b][root[some]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_n, out_b)], names=["rep", "links", "b"])

    return run


def near_duplicate_vectors(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``rows(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null, their lengths equal, and their cosine in double precision is at
    least ``similarity``.  Null, empty and zero vectors and those with null, NaN or infinite components link with nothing,
    count 0 links and are kept.  Components of doubles stay doubles.  Rows that repeat a vec_id are vectors of their own.  A pair at the limit shares none of
    the tables with a chance of MISSES at most.  An empty table gives an empty result; other columns are ignored.
    """
    v = F.col("embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    all_ = stored(rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast(kind).alias("embedding"), rows["label"].cast("string").alias("label")))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    key = [F.xxhash64(v, F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"), F.size(v).alias("dim"), F.col("label")]
    good = all_.where(usable).select("vec_id", v, *key)
    names = ["h1", "h2", "dim", "label"]
    classes = stored(good.groupBy(*names).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.min("embedding").alias("embedding")))

    made: list[DataFrame] = []
    tables, bits = shape_for(classes.count(), similarity)
    coded = stored(classes.select("rep", "embedding").mapInArrow(_coded(tables, bits), "rep long, codes array<long>, signs binary"), made)
    placed = coded.join(classes.select("rep", "label", "dim"), "rep").select("rep", F.posexplode("codes").alias("tab", "code"), "label", "dim").withColumn("bucket", F.xxhash64("label", "dim", "tab", "code"))
    # written, so that Spark can split a hot bucket's partition in the join
    sizes = stored(placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), made)
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    tiled = placed.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiled = tiled.select("bucket", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tab", F.col("dim").cast("long").alias("dim"))
    tile = ["bucket", "i", "j"]
    signed = tiled.join(coded.select("rep", "signs"), "rep").repartition(*tile).sortWithinPartitions(*tile, "rep")
    near = stored(signed.select(*tile, "rep", "own", "tab", "dim", "signs").mapInArrow(_screened(tables, bits, similarity), "bucket long, i int, j int, rep long, own int, tab int, dim long, signs binary"), made)
    full = near.join(classes.select("rep", "mult", "embedding"), "rep").repartition(*tile).sortWithinPartitions(*tile, "rep")
    found = stored(full.select(*tile, "rep", "mult", "own", "tab", "dim", "signs", "embedding").mapInArrow(_tiles(tables, bits, similarity), "rep long, links long, b long"), made)

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), "b")).withColumnRenamed("id", "rep")
    links = stored(links)
    discard(*made)
    done = classes.select(*names, "rep", "mult").join(links, "rep", "left").join(parts, "rep", "left").select(*names, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = all_.select("vec_id", usable.alias("usable"), *key).join(done, names, "left")
    component = F.when(F.col("usable"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (
  select row_number() over () as r, vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
), ok as (
  select * from v where label is not null and len(e) > 0 and len([x for x in e if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in e if x <> 0]) > 0
), p as (
  select a.r, a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.98
), t(a, c) as (
  select vec_id, vec_id from v union select p.a, t.c from t join p on p.b = t.a
), c as (select a, min(c) as c from t group by 1), n as (select r, count(*) as n from p group by 1)
select v.vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, v.vec_id = c.c as kept from v join c on c.a = v.vec_id left join n on n.r = v.r
"""
