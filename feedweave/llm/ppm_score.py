"""Language-model scores of documents by prediction by partial matching over bytes.

A document is the sequence of its lower-cased words, each followed by a space, and one end mark.  The model is a trie of byte
contexts of up to ORDER bytes, kept as one table per depth: (context, symbol, count).  A symbol that a context has not been
followed by costs the context's escape (method D) and is looked up in the next shorter context, where the symbols of the
longer one are excluded; the last resort is a uniform choice among the bytes never seen.

Documents are dealt to blocks of bounded size, LANE blocks to a lane.  A block reports its distinct (ORDER + 1)-grams and words
as packed arrays, cut into PARTS by key, so that a shuffled row holds thousands of them; each part of each lane is summed by
itself, so groups stay bounded and their number grows with the text.  Every distinct gram's probability is found once by joins
down the tables, joined with the distinct keys of each lane, and goes back, packed again, to the blocks that asked.  Words
travel as 63-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import byte_texts, crc_mod, discard, flat_words, id_and_text, slices, sorted_groups, stored, table, words_of

ORDER = 5
BLOCK_BYTES = 12_000_000
SLICE = 2_000_000  # bytes of text whose grams are in memory at once
PARTS = 61
LANE = 32  # blocks
END = 10  # the end mark and what stands before a text; words hold no white space
SLICE_DOCS = 1 << 16  # fits the low 16 bits beside a gram of 48


def document_bytes(text: bytes) -> bytes:
    words = words_of(text)
    return b" ".join(words) + (b" \n" if words else b"\n")


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each predicted byte of the texts, its ORDER bytes of context and itself as one number, and the text's position."""
    pad = bytes([END]) * ORDER
    bodies = [document_bytes(t) for t in texts]
    raw = np.frombuffer(b"".join(x for body in bodies for x in (pad, body)), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    gram = np.zeros(max(0, len(raw) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        gram <<= np.uint64(8)
        gram |= raw[k : len(raw) - ORDER + k]
    # number i ends at byte i + ORDER; those that end in a pad are no predictions
    inside = np.ones(len(raw), bool)
    begin = np.cumsum(sizes + ORDER) - sizes - ORDER
    inside[(begin[:, None] + np.arange(ORDER)).reshape(-1)] = False
    return gram[inside[ORDER:]], np.repeat(np.arange(len(texts)), sizes)


def word_keys(words: pa.Array) -> np.ndarray:
    """63-bit hashes of words."""
    return pd.util.hash_array(np.array([*words.to_pylist(), None], dtype=object), categorize=False)[:-1] & np.uint64((1 << 63) - 1)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes plane by plane: the planes of sorted keys and small counts hold long runs, which compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class Tally:
    """Distinct keys, sorted, and the sums of their counts; grows by sorted distinct keys, so one slice's are held beside it at most."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[known]] += counts[known]
        if not known.all():
            both = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(both, kind="stable")
            self.keys, self.counts = both[order], np.concatenate([self.counts, counts[~known]])[order]


def distinct_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _gathered(batches):
    """Each block's distinct grams (parts 0 to PARTS - 1) and words (the parts after) with their counts in training documents."""
    for t, starts in sorted_groups(batches, ["block"]):
        for a, b in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist()):
            texts = byte_texts(t["text"].slice(a, b - a))
            train = t["train"].slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            grams, words = Tally(), Tally()
            for i, j in slices(texts, SLICE):
                g, owner = grams_of(texts[i:j])
                g <<= np.uint64(1)
                g |= train[i:j][owner].astype(np.uint64)
                g.sort()
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                n = np.diff(np.append(first, len(g))) * (g[first] & np.uint64(1)).astype(np.int64)
                grams.add(*distinct_sums(g[first] >> np.uint64(1), n))
                coded, sizes = flat_words(texts[i:j])
                if len(coded):
                    n = np.bincount(coded.indices.to_numpy()[np.repeat(train[i:j], sizes)], minlength=len(coded.dictionary))
                    words.add(*distinct_sums(word_keys(coded.dictionary), n))
            del texts
            block = t["block"][a].as_py()
            for k, tally in enumerate((grams, words)):
                for part in range(PARTS):
                    own = tally.keys % np.uint64(PARTS) == part
                    if own.any():
                        values = [block], [k * PARTS + part], [packed(tally.keys[own])], [packed(tally.counts[own])]
                        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "part", "keys", "n"])


def _combined(batches):
    """The distinct keys of a part in a lane with their counts summed over its blocks; rows come sorted by both, one part's keys of a lane are held."""
    now, tally = None, Tally()

    def emit():
        for i in range(0, len(tally.keys), 50_000):
            k = tally.keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(k), x, np.int32)) for x in now), pa.array(k.view(np.int64)), pa.array(tally.counts[i : i + 50_000])], names=["part", "lane", "key", "n"])

    for batch in batches:
        for part, lane, k, n in zip(*(batch[c].to_pylist() for c in ("part", "lane", "keys", "n"))):
            if (part, lane) != now:
                if now:
                    yield from emit()
                now, tally = (part, lane), Tally()
            tally.add(unpacked(k, np.uint64), unpacked(n, np.int64))
    if now:
        yield from emit()


def _answered(asked: pa.Table, values: pa.Table) -> pa.Table:
    """To each block's keys of a part their values."""
    order = np.argsort(key := values["key"].to_numpy())
    key, value = key[order].view(np.uint64), values["value"].to_numpy()[order]
    out = [packed(value[np.searchsorted(key, unpacked(k, np.uint64))]) for k in asked["keys"].to_pylist()]
    return pa.table({"block": asked["block"], "part": asked["part"], "keys": asked["keys"], "v": pa.array(out, pa.binary())})


def levels(counts: DataFrame, made: list[DataFrame], order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per depth k from 0 to ``order``: the trie's (ctx, s, n), and its contexts (ctx, total, kinds, beneath); tables written are noted in ``made``.

    ``beneath`` sums, over the context's symbols, their counts in the next shorter context: what exclusion takes off there.
    """
    nodes = {order: counts.where("n > 0").select(F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(255).alias("s"), "n")}
    for k in range(order - 1, -1, -1):
        mask = (1 << 8 * k) - 1
        nodes[k] = stored(nodes[k + 1].groupBy(F.col("ctx").bitwiseAND(mask).alias("ctx"), "s").agg(F.sum("n").alias("n")), made)
    out = []
    for k in range(order + 1):
        t = nodes[k].withColumn("beneath", F.lit(0).cast("long"))
        if k:
            shorter = nodes[k - 1].select(F.col("ctx").alias("short"), "s", F.col("n").alias("beneath"))
            short = nodes[k].withColumn("short", F.col("ctx").bitwiseAND((1 << 8 * (k - 1)) - 1))
            t = short.join(F.broadcast(shorter) if k <= 2 else shorter, ["short", "s"])  # depths 0 and 1 hold 65,792 nodes at most
        out.append((nodes[k], stored(t.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("beneath").alias("beneath")), made)))
    return out


def gram_scores(counts: DataFrame, made: list[DataFrame], order: int = ORDER) -> DataFrame:
    """``gram, logp`` for every gram of ``counts(gram, n)``: log10 of its last byte's probability after the others.

    ``n`` counts the gram in training texts and may be 0.  Tables written on the way are noted in ``made``.
    """
    trie = levels(counts, made, order)
    deep = trie[order][1]
    found = counts.withColumn("ctx", F.shiftright("gram", 8)).join(deep, "ctx", "left").select("gram", "n", "total", "kinds", "beneath")
    known = found.where("n > 0").select("gram", F.log10((F.col("n") - 0.5) / F.col("total")).alias("logp"))
    seen = F.col("total").isNotNull()
    cost = F.when(seen, F.log10(F.col("kinds") / (2 * F.col("total")))).otherwise(0.0)
    left = found.where("n = 0").select("gram", cost.alias("cost"), F.coalesce("kinds", F.lit(0)).alias("off_kinds"), F.coalesce("beneath", F.lit(0)).alias("off"))
    for k in range(order - 1, -1, -1):
        nodes, contexts = trie[k]
        if k <= 1:
            nodes, contexts = F.broadcast(nodes), F.broadcast(contexts)
        here = stored(left, made) if k % 2 == 0 else left
        here = here.withColumn("ctx", F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1)).withColumn("s", F.col("gram").bitwiseAND(255))
        here = here.join(contexts, "ctx", "left").join(nodes, ["ctx", "s"], "left")
        total, kinds = F.col("total") - F.col("off"), F.col("kinds") - F.col("off_kinds")
        hit = here.where("n is not null").select("gram", (F.col("cost") + F.log10((F.col("n") - 0.5) / total)).alias("logp"))
        escape = F.when(F.col("total").isNotNull() & (kinds > 0), F.log10(kinds / (2 * total))).otherwise(0.0)
        left = here.where("n is null").select("gram", (F.col("cost") + escape).alias("cost"), F.coalesce("kinds", F.lit(0)).alias("off_kinds"), F.coalesce("beneath", F.lit(0)).alias("off"))
        known = known.union(hit)
    return known.union(left.select("gram", (F.col("cost") - F.log10(256.0 - F.col("off_kinds"))).alias("logp")))


def _gathered_values(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(k, np.uint64) for k, _ in rows)])
    order = np.argsort(keys)
    return keys[order], np.concatenate([np.zeros(0), *(unpacked(v, np.float64) for _, v in rows)])[order]


def _scored(n_train: int, denominator: float, end_count: int):
    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        rows = list(zip(facts["part"].to_pylist(), facts["keys"].to_pylist(), facts["v"].to_pylist()))
        g, logp = _gathered_values([x[1:] for x in rows if x[0] < PARTS])
        w, count = _gathered_values([x[1:] for x in rows if x[0] >= PARTS])
        del rows
        texts = byte_texts(docs["text"])
        parts = []
        for low, high in slices(texts, SLICE):
            for i in range(low, high, SLICE_DOCS):
                j = min(high, i + SLICE_DOCS)
                own, owner = grams_of(texts[i:j])
                own <<= np.uint64(16)
                own |= owner.astype(np.uint64)
                own.sort()
                at = np.flatnonzero(np.concatenate([[True], (own[1:] ^ own[:-1]) >> np.uint64(16) != 0]))
                value = logp[np.searchsorted(g, own[at] >> np.uint64(16))]
                score = np.bincount((own & np.uint64(SLICE_DOCS - 1)).astype(np.int64), np.repeat(value, np.diff(np.append(at, len(own)))), j - i)
                coded, sizes = flat_words(texts[i:j])
                c = count[np.searchsorted(w, word_keys(coded.dictionary))] if len(coded) else np.zeros(0)
                codes, doc = coded.indices.to_numpy(), np.repeat(np.arange(j - i), sizes)
                base = np.bincount(doc, np.log10((c + 0.5) / denominator)[codes], j - i) + math.log10((end_count + 0.5) / denominator)
                known = np.bincount(doc, (c > 0)[codes], j - i).astype(np.int64) + (end_count > 0)
                parts.append((sizes + 1, known, base, score))
        cols = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({"doc_id": docs["doc_id"], "train": docs["train"], "n_tokens": cols[0], "n_known": cols[1], "train_tokens": np.full(len(texts), n_train), "base_score": cols[2], "score": cols[3]})

    return run


def ppm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)`` under a model learned from the rows where ``train``, a condition on doc_id and text, holds.

    Returns ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``: ``score`` the log10 probability by partial
    matching, ``base_score`` that of a unigram model over words and end marks with half a count added.  Null and empty texts
    are one end mark.  Nothing to learn from: all bytes are equally likely.  Repeated rows are scored, and learned from, one
    by one; an empty table gives an empty result; other columns are ignored.
    """
    rows = id_and_text(docs).withColumn("train", F.coalesce(train, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text") + 2).alias("b")).first()["b"] or 0
    blocks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / BLOCK_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = rows.repartition("block").sortWithinPartitions("block")
    lane = F.floor(F.col("block") / LANE).cast("int").alias("lane")
    facts = stored(dealt.select("block", "text", "train").mapInArrow(_gathered, "block int, part int, keys binary, n binary"))
    asked = stored(facts.select("part", lane, "keys", "n").repartition("part", "lane").sortWithinPartitions("part", "lane").mapInArrow(_combined, "part int, lane int, key long, n long"))
    totals = stored(asked.groupBy("part", "key").agg(F.sum("n").alias("n")))
    words = totals.where(F.col("part") >= PARTS)
    ends = rows.where("train").count()
    about = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n, v = about["n"] + ends, about["v"] + (ends > 0)

    made: list[DataFrame] = []
    scores = gram_scores(totals.where(F.col("part") < PARTS).select(F.col("key").alias("gram"), "n"), made)
    values = scores.select((F.col("gram") % PARTS).cast("int").alias("part"), F.col("gram").alias("key"), F.col("logp").alias("value")).union(words.select("part", "key", F.col("n").cast("double")))
    wanted = asked.select("part", "lane", "key").join(values, ["part", "key"])
    answers = stored(facts.select("block", "part", lane, "keys").groupBy("part", "lane").cogroup(wanted.groupBy("part", "lane")).applyInArrow(_answered, "block int, part int, keys binary, v binary"))
    discard(facts, asked, totals, *made)
    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(n, n + 0.5 * (v + 1), ends), out)


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ppm_scores(docs, crc_mod(F.col("doc_id"), 5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
