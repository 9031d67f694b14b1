"""Exact ranked lexical search of many items at once by a dual tree.

Items and the documents of a block are the leaves of two hierarchies whose nodes hold, for each term, the largest weight of an item
and the largest impact of a document below them.  The product of two nodes bounds the score of every pair below them; a pair of nodes
goes no further once that bound lies below the weakest k-th best score of the node's items.  What is left of both hierarchies is
scored exactly, in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import byte_texts, discard, id_and_text, shared, slices, split_words, spread, stored, table, tidy

BEST = 50
ITEMS, TERMS = 256, 16_384  # of a batch of items, about; an item with more terms gets a batch of its own
CELLS = 1 << 21  # node and term pairs of the lowest level of a block's hierarchy
LEAF, FAN = 4, 8  # documents of a leaf; children of a node
DEEPEST = 4  # levels of a hierarchy at most
SEED_ONE_IN = 32  # the share of documents that is searched first
NO_ID = np.iinfo(np.int64).max  # orders rows without a doc_id after the others
FOUND = "item_row long, doc_id long, score long"

#: What a byte becomes before white space splits terms: terms are letters and digits of ASCII, A-Z in lower case, and all else beyond it.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def split_terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and each text's number of terms."""
    return split_words([t.translate(FOLD) for t in texts], lower=False)


class Postings:
    """Documents as sparse rows: the codes of the items' terms they hold, and the impacts of these."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, impacts: np.ndarray):
        self.ids, self.sizes, self.codes, self.impacts = ids, sizes, codes, impacts
        self.first = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, rows: np.ndarray) -> Postings:
        at = spread(self.first[rows], self.sizes[rows])
        return Postings(self.ids[rows], self.sizes[rows], self.codes[at], self.impacts[at])

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sizes = self.sizes[rows]
        at = spread(self.first[rows], sizes)
        upto = np.concatenate([[0], np.cumsum(weights[self.codes[at]] * self.impacts[at])])
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]


def alike(main: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order that puts rows with the same strongest terms next to each other."""
    return np.lexsort((second, main))


def strongest(owner: np.ndarray, codes: np.ndarray, strength: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's two codes of the greatest strength, -1 where there are none."""
    order = np.lexsort((codes, -strength, owner))
    sizes = np.bincount(owner, minlength=rows)
    first = np.cumsum(sizes) - sizes
    out = np.full((2, rows), -1, np.int64)
    for k in range(2):
        some = sizes > k
        out[k, some] = codes[order][first[some] + k]
    return out[0], out[1]


def maxima(lowest: np.ndarray) -> list[np.ndarray]:
    """The levels of a hierarchy from its lowest to its topmost: each node holds the maxima of FAN nodes below it."""
    levels = [lowest]
    while len(levels[-1]) > 1 and len(levels) < DEEPEST:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN), axis=0))
    return levels


class Items:
    """A batch of items: exact weights by term, the hierarchy of their maxima, and their best documents so far."""

    def __init__(self, rows: list[int], codes: list[np.ndarray], weights: np.ndarray, best: int, bars: dict[int, int]):
        owner, flat = np.repeat(np.arange(len(rows)), [len(c) for c in codes]), np.concatenate([np.zeros(0, np.int64), *codes])
        order = alike(*strongest(owner, flat, weights[flat], len(rows)))
        self.rows, self.best, self.terms = np.array(rows, np.int64)[order], best, len(weights)
        self.weights = np.zeros((len(rows), len(weights)), np.int64)
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.weights[place[owner], flat] = weights[flat]
        self.levels = maxima(self.weights.astype(np.float64))
        self.bars = np.array([bars.get(r, 1) for r in self.rows.tolist()], np.int64)  # documents must score above 0
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]

    def weakest(self, level: int) -> np.ndarray:
        """The least bar of the items below each node."""
        bars = self.bars
        for _ in range(level):
            bars = np.minimum.reduceat(bars, np.arange(0, len(bars), FAN))
        return bars

    def offer(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= self.bars[item]
        ids, scores = np.concatenate([self.held[item][0], ids[some]]), np.concatenate([self.held[item][1], scores[some]])
        keep = np.lexsort((ids, -scores))[: self.best]
        self.held[item] = ids[keep], scores[keep]
        if len(keep) == self.best:
            self.bars[item] = max(self.bars[item], scores[keep[-1]])


def search(items: Items, docs: Postings) -> tuple[int, int]:
    """Offers every document of a block that may be among an item's best; returns the pairs scored and all pairs."""
    owner = np.repeat(np.arange(len(docs)), docs.sizes)
    main, second = strongest(owner, docs.codes, docs.impacts * items.weights.max(axis=0)[docs.codes], len(docs))
    docs = docs.take(alike(main, second))
    leaf = np.repeat(np.arange(len(docs)) // LEAF, docs.sizes)
    lowest = np.zeros((-(-len(docs) // LEAF), items.terms))
    np.maximum.at(lowest.reshape(-1), leaf * items.terms + docs.codes, docs.impacts)
    levels = maxima(lowest)
    alive = np.ones((len(items.levels[-1]), len(levels[-1])), bool)
    for step in range(max(len(items.levels), len(levels))):
        i, j = max(0, len(items.levels) - 1 - step), max(0, len(levels) - 1 - step)
        if step:
            for axis, (nodes, moved) in enumerate(((len(items.levels[i]), step < len(items.levels)), (len(levels[j]), step < len(levels)))):
                if moved:
                    alive = np.repeat(alive, FAN, axis=axis).take(np.arange(nodes), axis=axis)
        weakest = items.weakest(i)
        for a in range(0, len(alive), FAN):  # children of one node are bounded together
            columns = np.flatnonzero(alive[a : a + FAN].any(axis=0))
            if len(columns):
                bound = items.levels[i][a : a + FAN] @ levels[j][columns].T
                # sums of whole numbers: exact below 2^53, beyond that by far less than the margin
                alive[a : a + FAN, columns] &= bound * (1 + 1e-9) >= weakest[a : a + FAN, None]
    scored = 0
    for item in np.flatnonzero(alive.any(axis=1)).tolist():
        leaves = np.flatnonzero(alive[item])
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        rows = rows[rows < len(docs)]
        scored += len(rows)
        items.offer(item, docs.ids[rows], docs.scores(rows, items.weights[item]))
    return scored, len(docs) * len(items.rows)


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _item_terms(batches):
    for batch in batches:
        terms, counts = split_terms(byte_texts(batch["text"]))
        ends = np.cumsum(counts).tolist()
        own = [pc.unique(terms.slice(a, b - a)) for a, b in zip([0, *ends], ends)]
        yield pa.RecordBatch.from_arrays([batch["item_row"], pa.array([x.to_pylist() for x in own], pa.list_(pa.binary()))], names=["item_row", "terms"])


def _counted(vocabulary):
    """Per document: its terms, and the codes and counts of those that items hold."""

    def run(batches):
        terms = pa.array(vocabulary(), pa.binary())
        for batch in batches:
            texts = byte_texts(batch["text"])
            for i, j in slices(texts):
                flat, counts = split_terms(texts[i:j])
                code = pc.index_in(flat, terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(j - i), counts)[code >= 0]
                pairs, tf = np.unique(owner * len(terms) + code[code >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(pairs, np.arange(j - i + 1) * len(terms)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(terms)), tf)]
                out = pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(counts), *lists], names=["doc_id", "n", "codes", "tfs"])
                yield out.filter(pa.array(counts > 0))

    return run


def _frequencies(vocabulary_size: int):
    """Documents by term; code -1 counts the documents, -2 their terms."""

    def run(batches):
        df, n, total = np.zeros(vocabulary_size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch["codes"].flatten().to_numpy(), minlength=vocabulary_size)
            n, total = n + batch.num_rows, total + int(pc.sum(batch["n"]).as_py() or 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int32()), pa.array(np.append(df[some], [n, total]))], names=["code", "df"])

    return run


def _searched(get: Callable, best: int):
    def run(batches):
        rows, codes, weights, bars, documents, terms = get()
        items = Items(rows, codes, weights, best, bars)
        room = LEAF * max(1, CELLS // max(1, len(weights)))
        for batch in batches:
            n, sizes = batch["n"].to_numpy(), pc.list_value_length(batch["codes"]).to_numpy().astype(np.int64)
            tf, flat = batch["tfs"].flatten().to_numpy().astype(np.int64), batch["codes"].flatten().to_numpy().astype(np.int64)
            ids = pc.fill_null(batch["doc_id"], NO_ID).to_numpy()
            docs = Postings(ids, sizes, flat, impacts_of(tf, np.repeat(n, sizes), documents, terms))
            for at in range(0, len(docs), room):
                search(items, docs.take(np.arange(at, min(len(docs), at + room))))
        owner = np.repeat(items.rows, [len(x) for x, _ in items.held])
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in items.held)]) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item_row", "doc_id", "score"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def batch_search(docs: DataFrame, items: list, best: int) -> DataFrame:
    """``item_row, doc_id, score, rank`` for one batch of item rows ``(item_row, terms)``, stored."""
    spark = docs.sparkSession
    vocabulary = sorted({t for r in items for t in r["terms"]})
    code = {t: i for i, t in enumerate(vocabulary)}
    rows, codes = [r["item_row"] for r in items], [np.array([code[t] for t in r["terms"]], np.int64) for r in items]
    counted = stored(docs.mapInArrow(tidy(_counted(shared(spark, vocabulary))), "doc_id long, n long, codes array<int>, tfs array<int>"))
    df = {r["code"]: r["df"] for r in counted.select("n", "codes").mapInArrow(_frequencies(len(vocabulary)), "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect()}
    documents, terms = df.get(-1, 0), df.get(-2, 0)
    weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    seed = F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_ONE_IN)) == 0
    run = lambda part, bars: part.mapInArrow(_searched(shared(spark, (rows, codes, weights, bars, documents, terms)), best), FOUND)
    first = stored(ranked(run(counted.where(seed), {}), best))
    bars = {r["item_row"]: r["score"] for r in first.where(F.col("rank") == best).select("item_row", "score").collect()}
    out = stored(ranked(run(counted.where(~seed), bars).union(first.drop("rank")), best))
    discard(counted, first)
    return out


def top_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents by descending score, ties by ascending doc_id.

    Scores are those of the contract: integer weights of an item's distinct terms times the documents' integer impacts.  Only scores
    above 0 count; an item without terms, or a null one, has no rows.  Documents without a doc_id are ranked after others of the same
    score.  Rows that repeat a doc_id are documents of their own, item rows that repeat an item_id have rankings of their own.  An empty
    table gives an empty result; other columns are ignored.

    Items are searched in batches of about ITEMS items and TERMS terms, one pass over the documents each, so that what is broadcast
    and held is bounded.  A share of the documents, chosen by a hash, is searched first; the k-th best scores found there are where the
    pass over the rest starts.  No document is shuffled: tasks send on the items' best rows only.
    """
    spark = docs.sparkSession
    own = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text")).withColumn("item_row", F.monotonically_increasing_id())
    own = stored(own)
    listed = own.select("item_row", "text").mapInArrow(_item_terms, "item_row long, terms array<binary>").withColumn("n", F.size("terms")).where("n > 0")
    listed = stored(listed.withColumn("long", F.col("n") > TERMS))
    texts = id_and_text(docs)
    found = []
    for kind in listed.groupBy("long").agg(F.count("*").alias("items"), F.sum("n").alias("terms")).collect():
        batches = kind["items"] if kind["long"] else max(math.ceil(kind["items"] / ITEMS), math.ceil(kind["terms"] / TERMS))
        mine = listed.where(F.col("long") == kind["long"]).withColumn("batch", F.pmod(F.xxhash64("item_row"), F.lit(batches)))
        for b in range(batches):
            if rows := mine.where(F.col("batch") == b).select("item_row", "terms").collect():
                found.append(batch_search(texts, rows, best))
    discard(listed)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.join(own.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = f"""
with folded as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as ts from documents
), d as (select r, doc_id, ts, len(ts) as n from folded where len(ts) > 0),
s as (select count(*) as nn, sum(n)::bigint as ll from d),
tf as materialized (select r, any_value(doc_id) as doc_id, any_value(n) as n, t, count(*) as tf from (select r, doc_id, n, unnest(ts) as t from d) group by r, t),
w as (select t, cast(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by t),
i as (
  select row_number() over () as ir, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as ts from benchmark
), it as (select ir, item_id, unnest(ts) as t from i),
score as (
  select it.ir, it.item_id, tf.r, any_value(tf.doc_id) as doc_id, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * s.nn) // s.ll)))) as bigint) as score
  from it join tf using (t) join w using (t), s group by it.ir, it.item_id, tf.r
)
select item_id, cast(row_number() over (partition by ir order by score desc, doc_id nulls last) as int) as rank, doc_id, score from score where score > 0
qualify row_number() over (partition by ir order by score desc, doc_id nulls last) <= {BEST}
"""
