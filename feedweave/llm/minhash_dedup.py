"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

A document's set holds the 64-bit hashes of its distinct word 5-grams.  Equal sets collapse to one class first, so copies
never meet as pairs.  Each band's bucket links its members to one of them, its hub (a star, not all pairs); only members that
these links leave in different components are then compared among themselves, in tiles of bounded size.  Every link is
confirmed by the exact intersection of the full sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import byte_texts, discard, flat_words, id_and_text, mix64, slices, sorted_groups, stored, table, tidy, with_ids
from feedweave.llm.components import connected_components

WIDTH = 5
ROWS = 5  # MinHash values of a band
MISSES = 1e-6  # most that the chance to miss a pair exactly at the limit may be
SAMPLE = 1024  # smallest hashes of a set that its odd sketch folds
SKETCH_WORDS = 32  # 64-bit words of an odd sketch
TILE = 256  # members of a bucket compared in one row of a tile join, on either side


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes; fewer than ``width`` words make one shingle, none an empty set."""
    words, counts = flat_words(texts)
    own = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words.dictionary.to_pylist()], np.uint64)
    h = own[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    sets, at = [], 0
    for n in counts.tolist():
        if n >= width:
            sets.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for w in h[at : at + n]:
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
            sets.append(x)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def bands_for(percent: int) -> int:
    """Bands that miss a pair at ``percent`` with a chance of MISSES at most: 24 at 85, 35 at 80."""
    return max(1, math.ceil(math.log(MISSES) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, samples, np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under the multiply-add hashes, in slices that bound memory for long texts."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * a + b).min(axis=0), out=low)
    return low


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """The bottom-k MinHash sample of a sorted set, folded into a bitmap that keeps each bit's parity."""
    bits = mix64(s[:SAMPLE] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _signed(n_bands: int):
    def signed(batches):
        a, b = _permutations(n_bands * ROWS)
        for batch in batches:
            texts = byte_texts(batch["text"])
            for i, j in slices(texts, 2_000_000):
                sets = shingle_sets(texts[i:j])
                bands = np.zeros((len(sets), n_bands), np.uint64)
                sketches = np.zeros((len(sets), SKETCH_WORDS), np.int64)
                digests = np.zeros((len(sets), 2), np.int64)
                for k, s in enumerate(sets):
                    if len(s):
                        low = signature(s, a, b)
                        x = np.arange(n_bands, dtype=np.uint64)
                        for r in range(ROWS):
                            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
                        bands[k], sketches[k] = x, odd_sketch(s)
                        digests[k] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists(bands.view(np.int64)), _lists(sketches)],
                    names=["doc_id", "n", "d1", "d2", "bands", "sketch"],
                )

    return signed


def _sets(batches):
    for batch in batches:
        texts = byte_texts(batch["text"])
        for i, j in slices(texts, 2_000_000):
            sets = shingle_sets(texts[i:j])
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], names=["doc_id", "shingles"])


def differing_bits(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def most_long(percent: int) -> int:
    """Differing samples of a linked pair that may have more than SAMPLE shingles: the mean in the worst case, and six deviations."""
    j = percent / 100
    return int(2 * SAMPLE * (1 - j) + 12 * (SAMPLE * j * (1 - j)) ** 0.5)


def screen_bits(a: Column, b: Column, percent: int) -> Column:
    """Differing sketch bits that a link between sets of a and b shingles can have.

    Each differing sample turns one bit over, so up to SAMPLE shingles this bound is certain.
    """
    return F.when((a <= SAMPLE) & (b <= SAMPLE), F.floor((a + b) * (100 - percent) / (100 + percent))).otherwise(most_long(percent))


def sets_of(docs: DataFrame, ids: DataFrame, made: list[DataFrame]) -> DataFrame:
    """``doc_id, shingles`` of the documents among ``ids(doc_id)``, from their whole texts."""
    return stored(with_ids(docs, ids.distinct()).mapInArrow(tidy(_sets), "doc_id long, shingles array<long>"), made)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """Of distinct ``pairs(a, b)``, those with 100 * intersection >= percent * union on the full shingle sets."""
    pairs = stored(pairs, made)
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), made)
    first, second = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(second, "b").join(first, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Links: 100 * |A & B| >= percent * |A | B| on sets of word 5-grams.  ``component_id`` is the smallest doc_id reachable by
    links; ``kept`` marks it.  Null, empty and blank texts have empty sets, link with nothing and are kept.  Rows that repeat
    a doc_id with the same text are copies of each other; a null doc_id takes no part and comes back kept.  An empty table
    gives an empty result; other columns are ignored.  ``bands_for(percent)`` bands of 5 rows miss a pair at the limit once in
    about a million.  The sketch screen can lose no link between sets of up to SAMPLE shingles; between larger ones it lets
    six standard deviations pass, a chance of about one in a billion.
    """
    docs = id_and_text(docs)
    signed = stored(docs.mapInArrow(tidy(_signed(bands_for(percent))), "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"))
    full = signed.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")))
    about = classes.select("rep", "n", "sketch")

    # What many rows are joined with is written first: Spark splits a hot key's partition where both sides of a join are read from
    # a shuffle directly, not where one is aggregated on the way.
    made: list[DataFrame] = []
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    buckets = stored(keyed.groupBy("band", "value").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("size > 1"), made)
    shared = stored(keyed.join(buckets, ["band", "value"]), made)
    # A bucket's hub is the member with the most company over all bands: a text that others were made from, if there is one.
    company = stored(shared.groupBy("rep").agg(F.sum("size").alias("company")), made)
    hubs = stored(shared.join(company, "rep").groupBy("band", "value").agg((-F.max(F.struct("company", (-F.col("rep")).alias("r")))["r"]).alias("hub")), made)
    # buckets of several bands with the same members count once, as the first of them
    members = stored(shared.join(hubs, ["band", "value"]).groupBy("rep", "hub", "size", "who").agg(F.min("band").alias("band")), made)

    def screened(pairs: DataFrame) -> DataFrame:
        x, y = about.toDF("a", "na", "xa"), about.toDF("b", "nb", "xb")
        return pairs.join(y, "b").join(x, "a").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differing_bits(F.col("xa"), F.col("xb")) <= screen_bits(F.col("na"), F.col("nb"), percent))).select("a", "b")

    stars = members.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    links = stored(confirmed(screened(stars), docs, percent, made), made)
    found = connected_components(links)

    # Buckets that the stars left in several components: compare what lies in different ones.
    placed = members.where("size > 2").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component_id", "rep")).drop("component_id")
    open_ = stored(placed.groupBy("hub", "size", "who").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").drop("lo", "hi"), made)
    rest = placed.where("rep <> hub").join(open_, ["hub", "size", "who"]).select("hub", "size", "who", "band", "rep", "c").join(classes.select("rep", "n", "sketch", "bands"), "rep")
    links2 = stored(_across(rest, docs, percent, made), made)
    found = connected_components(links.union(links2))
    discard(*made)

    ids = classes.select("d1", "d2", "n", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component_id", "rep").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(ids, ["d1", "d2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _across(rest: DataFrame, docs: DataFrame, percent: int, made: list[DataFrame]) -> DataFrame:
    """Links ``(a, b)`` that join components, among the members of each bucket that lie in different ones.

    A bucket of m members is cut into ceil(m / TILE) chunks; each pair of chunks is one tile of about 2 * TILE members at
    most, whatever the bucket's size.  A first pass over the tiles finds the members with a partner that passes the screens
    (lengths, sketches, no earlier band in common); only these ship their full sets to the second, which confirms.  Neither
    makes a row for each pair.
    """
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    tiles = rest.withColumn("own", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = tiles.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("tile", F.xxhash64("hub", "size", "who", "i", "j")).drop("hub", "size", "who", "other")
    keys = ["tile", "band", "i", "j"]
    n_bands = bands_for(percent)
    cols = ["tile", "band", "i", "j", "own", "rep", "c", "n", "sketch", "bands"]

    def pairs_of(t, a: int, b: int):
        """The rows x and y of the candidate pairs of one tile, as positions from a."""
        rows = t.slice(a, b - a)
        rep, c, n, own = (rows[k].to_numpy() for k in ("rep", "c", "n", "own"))
        sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
        bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, n_bands)
        band, i, j = (t[k][a].as_py() for k in ("band", "i", "j"))
        xs, ys = [], []
        for x in range(b - a):
            y = np.flatnonzero((c != c[x]) & (rep > rep[x]) & ((own != own[x]) if i != j else True) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
            most = np.where((n[y] <= SAMPLE) & (n[x] <= SAMPLE), (n[y] + n[x]) * (100 - percent) // (100 + percent), most_long(percent))
            y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1) <= most]
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            xs.append(np.full(len(y), x))
            ys.append(y)
        return rows, np.concatenate(xs), np.concatenate(ys)

    def screen(batches):
        for t, starts in sorted_groups(batches, keys):
            keep = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist()):
                if b - a > 1:
                    _, x, y = pairs_of(t, a, b)
                    keep.append(a + np.union1d(x, y))
            if keep and len(rows := np.concatenate(keep)):
                yield from t.take(pa.array(rows.astype(np.int64))).combine_chunks().to_batches()

    def confirm(batches):
        for t, starts in sorted_groups(batches, keys):
            found = []
            for a, b in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist()):
                if b - a > 1:
                    rows, x, y = pairs_of(t, a, b)
                    sets = rows["shingles"].combine_chunks()
                    at, n = sets.offsets.to_numpy(), rows["n"].to_numpy()
                    both = common(sets.values.to_numpy(), at, x, y)
                    ok = 100 * both >= percent * (n[x] + n[y] - both)
                    rep, c, seen = rows["rep"].to_numpy(), rows["c"].to_numpy(), set()
                    for p, q in zip(x[ok].tolist(), y[ok].tolist()):
                        if (edge := (int(c[p]), int(c[q]))) not in seen:  # one link joins two components
                            seen |= {edge, edge[::-1]}
                            found.append((int(rep[p]), int(rep[q])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("tile").sortWithinPartitions(*keys)

    fields = "tile long, band int, i int, j int, own int, rep long, c long, n long, sketch array<long>, bands array<long>"
    chosen = stored(dealt(tiles.select(cols)).mapInArrow(tidy(screen), fields), made)
    sets = sets_of(docs, chosen.select(F.col("rep").alias("doc_id")), made).toDF("rep", "shingles")
    return dealt(chosen.join(sets, "rep").select(*cols, "shingles")).mapInArrow(tidy(confirm), "a long, b long").distinct()


def common(values: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x and y; set k is values[at[k]:at[k + 1]].

    Few pairs intersect one by one; many by products of the sets' incidence matrix, in slices of its columns.
    """
    used = np.union1d(x, y)
    total = int((at[used + 1] - at[used]).sum())
    if len(x) * 40 < total:
        return np.array([len(np.intersect1d(values[at[p] : at[p + 1]], values[at[q] : at[q + 1]], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist())], np.int64)
    place = np.zeros(len(at), np.int64)
    place[used] = np.arange(len(used))
    _, column = np.unique(np.concatenate([values[at[k] : at[k + 1]] for k in used.tolist()]), return_inverse=True)
    row = np.repeat(np.arange(len(used)), at[used + 1] - at[used])
    product = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = (column >= low) & (column < low + 4096)
        m = np.zeros((len(used), 4096), np.float32)
        m[row[part], column[part] - low] = 1
        product += m @ m.T
    return product[place[x], place[y]].astype(np.int64)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), g as (
  select doc_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), s as (select doc_id, hash(unnest(g)) as g from g), m as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), q as (
  select a, b from m join g x on x.doc_id = a join g y on y.doc_id = b where 100 * n >= 85 * (len(x.g) + len(y.g) - n)
), p as (select a, b from q union all select b, a from q
), t(a, c) as (
  select doc_id, doc_id from g union select p.a, t.c from t join p on p.b = t.a
), c as (select a, min(c) as c from t group by 1)
select g.doc_id, len(g.g) as n_shingles, c.c as component_id, g.doc_id = c.c as kept from g join c on c.a = g.doc_id
"""
