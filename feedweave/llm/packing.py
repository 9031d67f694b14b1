"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents keep the order of their ids.  Spark deals them out by ranges of that order; each range is tokenised and cut by a
dynamic programme over candidate cuts (document ends, sentence ends, and a grid inside very long sentences).  A window's
cost is its padding, plus a penalty for a cut inside a document or a sentence; the best predecessor within a window's reach
comes from a monotone queue, so the work is linear in the number of candidates.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import binary_array, byte_texts, bytes_of, group_starts, id_and_text, shared, slices, split_words, spread, table, tidy

LENGTH = 4096
SENTENCE_CUT, HARD_CUT, NEW_SEQUENCE = 6.0, 64.0, 2.0
LONG_SENTENCE, GRID = 512, 128  # a longer sentence may be cut on this grid
TAIL_GRID = 64
CHUNK = 1 << 19  # ids that one run of the dynamic programme covers, about
PART_BYTES = 16_000_000  # of text in a range of the order, about
MARKS = 64  # rows that a range's bounds are drawn from, about

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into ``pos`` of the cheapest chain of cuts from the first to the last position, both included.

    ``pos`` increases, neighbours at most ``length`` apart; a window between two cuts is at most ``length`` long and costs
    ``length`` less its own length, or nothing at a power of two, plus NEW_SEQUENCE and the later cut's penalty.  On ties
    the earliest predecessor wins.
    """
    m = len(pos)
    hits = [np.zeros((2, 0), np.int64)]  # later and earlier position of windows of a power of two
    size = 1
    while size <= length:
        i = np.searchsorted(pos, pos - size)
        later = np.flatnonzero((pos[np.minimum(i, m - 1)] == pos - size) & (pos >= pos[0] + size))
        hits.append(np.stack([later, i[later]]))
        size *= 2
    later, earlier = np.concatenate(hits, axis=1)
    order = np.argsort(later, kind="stable")
    exact, upto = earlier[order].tolist(), np.searchsorted(later[order], np.arange(m), side="right").tolist()
    p = 0
    at, pen = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, m):
        reach = at[j] - length
        while at[queue[0][1]] < reach:
            queue.popleft()
        low, k = queue[0]
        c = low + length - at[j]
        while p < upto[j]:
            i = exact[p]
            p += 1
            if cost[i] < c or cost[i] == c and i < k:
                c, k = cost[i], i
        cost[j], back[j] = (c := c + pen[j] + NEW_SEQUENCE), k
        key = c + at[j]
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    chain, j = [m - 1], m - 1
    while j:
        j = back[j]
        chain.append(j)
    return chain[::-1]


class Merges:
    """The vocabulary's merges for many plain words at once: in each round every word that still can merges its best pair.

    Equal to the library's result, since a merge never makes a pair that ranks before it.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, model):
        import json

        table = json.loads(model.to_str())["model"]
        vocab = table["vocab"]
        symbol = self.symbols()
        self.inner = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[symbol[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in table["merges"]]
        keys = np.array([(vocab[x] << 20) | vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        # the pairs by a hash; the few that share a place with an earlier one are looked up by bisection
        place = self.place(keys)
        _, first = np.unique(place, return_index=True)
        self.key, self.rank, self.crowded = np.full(1 << 21, -1), np.full(1 << 21, self.NONE, np.int32), np.zeros(1 << 21, bool)
        self.key[place[first]], self.rank[place[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded[place[rest]] = True
        self.rest = rest[np.argsort(keys[rest])]
        self.rest_keys = keys[self.rest]

    @staticmethod
    def symbols() -> dict[int, str]:
        """The character that stands for each byte in the vocabulary's strings."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}

    @staticmethod
    def place(pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left << 20) | right
        place = self.place(pair)
        out = np.where(self.key[place] == pair, self.rank[place], self.NONE)
        again = self.crowded[place] & (out == self.NONE)
        if again.any():
            own = pair[again]
            at = np.minimum(np.searchsorted(self.rest_keys, own), len(self.rest) - 1)
            out[again] = np.where(self.rest_keys[at] == own, self.rest[at], self.NONE)
        return out

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, where each word's begin, and how many they are."""
        data, at = bytes_of(words)
        lengths = np.diff(at)
        rows_of, pools = [], []
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            raw = data[at[rows][:, None] + np.arange(n)]
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while True:
                done = (rank == self.NONE).all(axis=1) if rank.shape[1] else np.ones(len(rows), bool)
                if done.any():
                    rows_of.append(np.repeat(rows[done], ids.shape[1]))
                    pools.append(ids[done].reshape(-1))
                    rows, ids, rank = rows[~done], ids[~done], rank[~done]
                if not len(rows):
                    break
                best = rank.argmin(axis=1)
                every = np.arange(len(rows))
                made = self.made[rank[every, best]]
                keep = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, keep + (keep > best[:, None]), axis=1)
                ids[every, best] = made
                rank = np.take_along_axis(rank, keep[:-1] + (keep[:-1] >= best[:, None]), axis=1)
                before = np.flatnonzero(best > 0)
                rank[before, best[before] - 1] = self.ranks(ids[before, best[before] - 1], made[before])
                after = np.flatnonzero(best < rank.shape[1])
                rank[after, best[after]] = self.ranks(made[after], ids[after, best[after] + 1])
        owner, pool = np.concatenate([np.zeros(0, np.int64), *rows_of]), np.concatenate([np.zeros(0, np.int64), *pools])
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=len(words))
        return pool[order].astype(np.uint32), np.cumsum(sizes) - sizes, sizes


class Tokens:
    """Token ids of texts, each distinct word of a batch encoded once: the vocabulary's words never span white space.

    Words of plain Latin letters (A-Z, a-z and the letters of U+00C0 to U+00FF, 24 at most) go through ``Merges``, the few
    others and the marks behind words through the library.
    """

    MARK = np.isin(np.arange(256), np.frombuffer(b".,;:!?|", np.uint8))
    ASCII = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
    SECOND = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])  # after the byte C3

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = Merges(self.model)

    def cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word's core, in lower case, and what follows; a word that isn't letters and then marks has no core."""
        data, at = bytes_of(words)
        sizes = np.diff(at)
        owner = np.repeat(np.arange(len(words)), sizes)
        two = np.zeros(len(data), bool)
        two[:-1] = (data[:-1] == 0xC3) & self.SECOND[data[1:]]
        letter = self.ASCII[data] | two
        letter[1:] |= two[:-1]
        n = np.bincount(owner[letter], minlength=len(words))
        chars = n - np.bincount(owner[two], minlength=len(words))
        leading = np.arange(len(data)) - at[:-1][owner] < n[owner]
        odd = np.bincount(owner[(leading & ~letter) | ~(letter | self.MARK[data])], minlength=len(words))
        plain = (n > 0) & (chars <= 24) & (odd == 0)
        core = leading & plain[owner]
        low = data.copy()
        low[core & self.ASCII[data]] |= 0x20
        second = np.zeros(len(data), bool)
        second[1:] = two[:-1]
        low[core & second & (data < 0x9F)] += 0x20
        kept = np.where(plain, n, 0)
        return binary_array(low[core], kept), binary_array(data[~core], sizes - kept)

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, where each word's begin, and how many they are."""
        core, other = (x.dictionary_encode() for x in self.cut(distinct))
        pool, first, sizes = self.merges(core.dictionary)
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        rest = [x.ids for x in encode([x.decode() for x in other.dictionary.to_pylist()], add_special_tokens=False)]
        n = np.fromiter(map(len, rest), np.int64, len(rest))
        # units: cores first, then the others; a word is its core, if it has one, and its other
        first = np.concatenate([first, len(pool) + np.cumsum(n) - n])
        sizes = np.concatenate([sizes, n])
        pool = np.concatenate([pool, np.fromiter((i for own in rest for i in own), np.uint32, int(n.sum()))])
        units = np.stack([core.indices.to_numpy(), len(core.dictionary) + other.indices.to_numpy()], axis=1).reshape(-1)
        both = sizes[units].reshape(-1, 2).sum(axis=1)
        return pool[spread(first[units], sizes[units])], np.cumsum(both) - both, both

    @staticmethod
    def stops(distinct: pa.Array) -> np.ndarray:
        """Which words end a sentence."""
        data, at = bytes_of(distinct)
        back = lambda k: data[np.maximum(at[1:] - k, at[:-1])] if len(data) else np.zeros(len(distinct), np.uint8)
        one, two, three = back(1), back(2), back(3)
        sizes = np.diff(at)
        return np.isin(one, np.frombuffer(b".!?", np.uint8)) | ((one == 34) & (two == 46) & (sizes > 1)) | ((three == 0xE3) & (two == 0x80) & (one == 0x82) & (sizes > 2))

    def __call__(self, texts: list[bytes] | pa.Array, end_id: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row with ``end_id`` after each text; each text's number of ids; where sentences end, as counts of ids before."""
        words, counts = split_words(texts, lower=False)
        coded = words.dictionary_encode()
        pool, first, sizes = self.words(coded.dictionary)
        # the end of a text is one more word
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(counts), len(sizes))
        pool, first, sizes = np.append(pool, np.uint32(end_id)), np.append(first, len(pool)), np.append(sizes, 1)
        n = sizes[codes]
        ends = np.cumsum(n)
        flat = pool[spread(first[codes], n)]
        last = np.cumsum(counts + 1) - 1
        lengths = np.diff(np.concatenate([[0], ends[last]])) if len(texts) else np.zeros(0, np.int64)
        return flat, lengths, ends[np.append(self.stops(coded.dictionary), False)[codes]]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, from 0 to ``total``, and each one's penalty."""
    base = np.concatenate([[0], sentence_ends, doc_ends, [total]])
    base = np.unique(base[(base >= 0) & (base <= total)])
    extra = [np.arange(a + GRID, b, GRID) for k in np.flatnonzero(np.diff(base) > LONG_SENTENCE).tolist() for a, b in [base[k : k + 2].tolist()]]
    if final:
        extra.append(np.arange(total, max(0, total - 2 * LENGTH), -TAIL_GRID))
    pos = np.unique(np.concatenate([base, *extra])).astype(np.int64) if extra else base.astype(np.int64)
    penalty = np.full(len(pos), HARD_CUT)
    for cuts, cost in ((sentence_ends, SENTENCE_CUT), (doc_ends, 0.0)):
        cuts = cuts[cuts <= total]
        penalty[np.searchsorted(pos, cuts)] = cost
    penalty[0] = penalty[-1] = 0.0
    return pos, penalty


class Packer:
    """Packs one range of the order: ``add`` takes its documents, ``solve`` gives the pieces of all windows that are settled."""

    def __init__(self, part: int, length: int):
        self.sequence, self.length = part << 40, length
        self.ids, self.stops = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.docs: list[tuple[int, int, int]] = []  # id, ids of it before the chunk, all its ids
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_ids: list[int], ids: np.ndarray, lengths: np.ndarray, stops: np.ndarray) -> None:
        self.docs += [(doc, 0, n) for doc, n in zip(doc_ids, lengths.tolist())]
        self.held.append((ids, stops))
        self.size += len(ids)

    def solve(self, final: bool) -> pa.RecordBatch | None:
        at = len(self.ids)
        more = []
        for own, own_stops in self.held:
            more.append(own_stops + at)
            at += len(own)
        ids, stops, docs = np.concatenate([self.ids, *(x for x, _ in self.held)]), np.concatenate([self.stops, *more]), self.docs
        self.held, self.size = [], 0
        if not len(ids):
            return None
        ends = np.cumsum([n - before for _, before, n in docs])
        pos, penalty = candidates(ends, stops, len(ids), final)
        cuts = pos[best_cuts(pos, penalty, self.length)].tolist()
        rows, d, start = [], 0, 0
        starts = [0, *ends.tolist()]
        if not final and len(cuts) > 2:
            cuts = cuts[:-1]  # the last window stays open
        for a, b in zip(cuts[:-1], cuts[1:]):
            x = a
            while x < b:
                while starts[d + 1] <= x:
                    d += 1
                y = min(b, starts[d + 1])
                doc, before, n = docs[d]
                rows.append((doc, before + x - starts[d], y - x, zlib.crc32(ids[x:y]), n, self.sequence, x - a))
                x = y
            self.sequence += 1
            start = b
        self.ids, self.stops = ids[start:].copy(), stops[stops > start] - start
        kept = int(np.searchsorted(ends, start, side="right"))
        self.docs = [(doc, before + max(0, start - s), n) for (doc, before, n), s in zip(docs[kept:], starts[kept:])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")]) if rows else None


def _packed(path: str | None, length: int):
    def run(batches):
        import public_tokenizers

        tokens = Tokens(path or public_tokenizers.path("word_bpe_49k.json"))
        packer, now = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            begins = group_starts(t, ["part"]).tolist() if t.num_rows else []
            for a, b in zip(begins, [*begins[1:], t.num_rows]):
                part = batch["part"][a].as_py()
                if part != now:
                    if packer and (out := packer.solve(True)) is not None:
                        yield out
                    packer, now = Packer(part, length), part
                doc_ids, texts = batch["doc_id"].slice(a, b - a).to_pylist(), byte_texts(batch["text"].slice(a, b - a))
                for i, j in slices(texts):
                    packer.add(doc_ids[i:j], *tokens(texts[i:j]))
                    if packer.size >= CHUNK and (out := packer.solve(False)) is not None:
                        yield out
        if packer and (out := packer.solve(True)) is not None:
            yield out

    return run


def order_keys(ids: np.ndarray, ties: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order of (id, tie, row) as byte strings: big-endian, the sign turned."""
    raw = np.stack([ids, ties, rows], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(raw.astype(">u8")).view("S24").reshape(-1)


def ranges_of(rows: DataFrame) -> Column:
    """The number of each row's range in the order of ``doc_id, tie, row``.

    Ranges hold about PART_BYTES of text.  Their bounds are quantiles of a sample by a hash, about MARKS rows a range, so that the same
    table gives the same ranges in each run.
    """
    at = ["doc_id", "tie", "row"]
    about = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 8).alias("b")).first()
    parts = max(1, math.ceil((about["b"] or 0) / PART_BYTES))
    one_in = max(1, about["n"] // (MARKS * parts))
    marks = rows.where(F.pmod(F.xxhash64(*at), F.lit(one_in)) == 0).select(*(F.coalesce(c, F.lit(-(1 << 63))).alias(c) for c in at)).toArrow() if parts > 1 else None
    bounds = np.zeros(0, "S24")
    if marks is not None and marks.num_rows:
        keys = np.sort(order_keys(*(marks[c].to_numpy() for c in at)))
        bounds = np.unique(keys[np.arange(1, parts) * len(keys) // parts])
    get = shared(rows.sparkSession, bounds)

    @F.arrow_udf("int")
    def part(ids: pa.Array, ties: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(get(), order_keys(ids.to_numpy(), ties.to_numpy(), own.to_numpy()), side="right").astype(np.int32))

    return part(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie", "row")


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids: see SCHEMA for the columns.

    Null and empty texts are one id (the end).  A document with a null id is packed too, its pieces carry the null.  Rows
    that repeat an id are packed one after the other, each with its own ``start`` from 0.  An empty table gives an empty
    result; other columns are ignored.  A range of the order ends with one shorter sequence, cut so that little of it is
    padding.  ``sequence_id`` grows with the order; it isn't gapless.  The same rows give the same pieces in each run.
    """
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = rows.withColumn("part", ranges_of(rows)).repartitionByRange("part").sortWithinPartitions("part", "doc_id", "tie")
    return dealt.select("part", "doc_id", "text").mapInArrow(tidy(_packed(tokenizer_path, length)), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
