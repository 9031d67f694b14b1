"""Joins: fuzzy first match, seeds, nearest positions, prefixes, positional rules and lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import clean as C
from feedweave.functions import text as T
from feedweave.operators import history
from feedweave.operators.tables import stored

ANCHOR, LONGEST = 8, 32  # characters of a seed, at least and at most
BASE, BITS, PART = 0xD6E8FEB86659FD93, 27, 1 << 18  # of the hashes of runs; bits of a bitmap of seeds, as a power of two; characters hashed at a time


def seed(c: Column) -> Column:
    """The leading 35 per cent of a compact text, 12 characters at least and 32 at most."""
    return F.left(c, F.least(F.lit(32), F.greatest(F.lit(12), F.floor(F.length(c) * 0.35).cast("int"))))


def scattered(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of runs of ``n`` characters, mixed."""
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """The polynomial hash of the ``n`` characters from each place on, put together from runs of 1, 2, 4 and so on."""
    have, length, power, out, size = codes, 1, BASE, None, 0
    while True:
        if n & length:
            out, size = have if out is None else out[: max(len(out) - length, 0)] * np.uint64(power) + have[size:], size + length
        if size == n:
            return out
        have = have[:-length] * np.uint64(power) + have[length:] if len(have) > length else have[:0]
        length, power = 2 * length, power * power % (1 << 64)


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bitmap keeps a scattered hash: two bits of 2^BITS."""
    return x >> np.uint64(64 - BITS), (x >> np.uint64(20)) & np.uint64((1 << BITS) - 1)


def held(bits: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The indices of the hashes of runs of ``n`` characters that the bitmap may know; the second bit is looked at where the first is set."""
    one = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    x = scattered(h, n)
    at = np.flatnonzero(one(x >> np.uint64(64 - BITS)))
    return at[one(places(x[at])[1]).astype(bool)]


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def seed_places(batches, most: int):
    """``p``: the bits of each seed's hash and, of seeds shorter than ``most``, of the hash of their first ANCHOR characters, which goes for a run of no characters."""
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        by_size: dict[int, list[str]] = {}
        for s in batch["s"].to_pylist():
            by_size.setdefault(len(s), []).append(s)
        for n, same in by_size.items():
            codes = coded("".join(same))
            found += places(scattered(hashed(codes, n)[::n], n)) + (places(scattered(hashed(codes, ANCHOR)[::n], 0)) if n < most else ())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], names=["p"])


def bitmap(seeds: DataFrame, most: int) -> np.ndarray:
    """2^BITS bits, 16 MB however many seeds there are: those of ``seeds(s)`` are set."""
    p = seeds.select("s").mapInArrow(lambda batches: seed_places(batches, most), "p long")
    words = p.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy()
    return bits.view(np.uint8)


def known_runs(codes: np.ndarray, ends: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[np.ndarray, int]]:
    """``(places, n)``: where a run of ``n`` characters begins that the bitmap may know and that ends with its text, whose end ``ends`` gives, or before."""
    room = lambda at: ends[np.searchsorted(ends, at, "right")] - at
    at = held(bits, hashed(codes, most), most)
    found = [(at[room(at) >= most], most)]
    h = hashed(codes, ANCHOR)
    at = held(bits, h, 0)
    h, left = h[at], room(at)
    for n in range(ANCHOR, most):
        on = left >= n
        at, h, left = at[on], h[on], left[on]
        if n > ANCHOR:
            h = h * np.uint64(BASE) + codes[at + n - 1]
        found.append((at[held(bits, h, n)], n))
    return found


def held_runs(batches, bits, most: int):
    """``text_id, s``: the runs of ``(text_id, t)`` that the bitmap may know, once a part of a text; parts of PART characters overlap by a run."""
    for batch in batches:
        rows, runs, waiting, owners, room = [], [], [], [], 0

        def scan():
            text, owner = "".join(waiting), np.array(owners)
            ends, pairs = np.cumsum([len(w) for w in waiting]), set()
            for at, n in known_runs(coded(text), ends, bits.value, most):
                pairs.update(zip(owner[np.searchsorted(ends, at, "right")].tolist(), [text[i : i + n] for i in at.tolist()]))
            for i, s in pairs:
                rows.append(i)
                runs.append(s)

        for i, t in enumerate(batch["t"]):
            t = t.as_py()
            for begin in range(0, max(len(t), 1), PART):
                waiting.append(t[begin : begin + PART + most - 1])
                owners.append(i)
                room += len(waiting[-1])
                if room >= PART:
                    scan()
                    waiting, owners, room = [], [], 0
        if waiting:
            scan()
        yield pa.RecordBatch.from_arrays([batch["text_id"].take(pa.array(rows, pa.int64())), pa.array(runs, pa.string())], names=["text_id", "s"])


def containing(texts: DataFrame, seeds: DataFrame, most: int = LONGEST) -> DataFrame:
    """Pairs (text_id, seed_id) of ``texts(text_id, t)`` and ``seeds(seed_id, s)`` where t contains s, s of 8 to ``most`` characters.

    Each text is read once, by tasks that hold a bitmap of the seeds' hashes, bounded in size: runs of ``most`` characters are looked up at each place,
    shorter ones only where the first eight characters are those of a shorter seed.  Only runs that the bitmap knows leave a task, and an equi-join
    with the seeds themselves decides; texts don't travel.  Give each distinct text and seed once.
    """
    keyed = seeds.where(F.length("s").between(ANCHOR, most)).select("seed_id", "s")
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(keyed, most))
    kind = dict(texts.dtypes)["text_id"]
    runs = texts.where(F.length("t") >= ANCHOR).select("text_id", "t").mapInArrow(lambda batches: held_runs(batches, bits, most), f"text_id {kind}, s string")
    return runs.join(keyed, "s").select("text_id", "seed_id").distinct()


def first_match(posts: DataFrame, network: DataFrame) -> DataFrame:
    """Each post with the first network post, by seq, that shares a seed either way and whose author is compatible.

    ``posts(post_id, author_name, t)`` and ``network(seq, post_id, author_name, text, is_sponsored)``; posts without a match
    keep nulls.  Texts are compared once however many copies they have; of a seed's network posts by one author only the first counts,
    so texts that share a seed never meet in pairs.
    """
    own = posts.withColumn("t", T.compact(F.col("t"))).withColumn("k", F.xxhash64("t"))
    net = network.withColumn("t", T.compact(F.col("text"))).where(F.length("t") >= ANCHOR).withColumn("n", F.xxhash64("t"))
    ours, theirs = sharing_seeds(own.groupBy("k").agg(F.min("t").alias("t")), net.groupBy("n").agg(F.min("t").alias("t")))
    own, net = stored(own.select("post_id", "author_name", "k")), stored(net.select("n", "seq", "post_id", "author_name", "is_sponsored"))
    others = net.select("n", F.col("author_name").alias("gql_author"), F.struct("seq", F.col("post_id").alias("gql_id"), "is_sponsored").alias("first"))
    by_seed = theirs.join(others, "n").groupBy("node", "gql_author").agg(F.min("first").alias("first"))
    both = ours.join(by_seed, "node").groupBy("k", "gql_author").agg(F.min("first").alias("first"))
    authors = own.select("k", "author_name").distinct()
    fit = both.join(authors, "k").where(F.col("author_name").isNull() | F.col("gql_author").isNull() | T.compatible_authors(F.col("author_name"), F.col("gql_author")))
    best = fit.groupBy(F.col("k").alias("bk"), F.col("author_name").alias("ba")).agg(F.min("first").alias("m"))
    return own.join(best, (F.col("k") == F.col("bk")) & F.col("author_name").eqNullSafe(F.col("ba")), "left").select("post_id", F.col("m.gql_id").alias("gql_id"), F.col("m.is_sponsored").alias("gql_sponsored"))


def known_sponsored(posts: DataFrame, network: DataFrame) -> DataFrame:
    """The posts whose text contains the first 30 characters of a sponsored network text."""
    seeds = network.where("is_sponsored and length(text) > 20").select(F.left("text", F.lit(30)).alias("s")).distinct().select(F.xxhash64("s").alias("seed_id"), "s")
    keyed = posts.withColumn("k", F.xxhash64("full_text"))
    texts = keyed.groupBy("k").agg(F.min("full_text").alias("t"))
    hits = containing(texts.select(F.col("k").alias("text_id"), "t"), seeds, 30).select(F.col("text_id").alias("k")).distinct()
    return keyed.join(hits, "k", "left_semi").drop("k")


def retro_marked(posts: DataFrame, network: DataFrame) -> DataFrame:
    """The posts that a sponsored network post of the same seed marks when it comes late: of the posts that share its seed, by order, the first one not yet marked.

    ``posts(post_id, seq, text, marked)``, ``network(text)`` with seeds of the first 30 characters of texts of 30 or more.
    """
    seeds = network.where(F.length("text") >= 30).select(F.left("text", F.lit(30)).alias("s")).distinct()
    return posts.where("not marked").join(seeds, F.left("text", F.lit(30)) == F.col("s")).groupBy("s").agg(F.min(F.struct("seq", "post_id")).alias("m")).select("m.post_id")


def sharing_seeds(posts: DataFrame, network: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(k, node)`` and ``(n, node)`` of distinct compact texts, ``posts(k, t)`` and ``network(n, t)``, of eight characters or more: one holds the other's seed just if they have a node in common.

    A node is a seed of either side; texts that begin or hold it are its members, so that their number, not that of pairs, decides.
    """
    own, net = stored(posts.where(F.length("t") >= ANCHOR)), stored(network.where(F.length("t") >= ANCHOR))

    def side(holders: DataFrame, h: str, owners: DataFrame, o: str, salt: str) -> tuple[DataFrame, DataFrame]:
        owned = owners.select(o, seed(F.col("t")).alias("s")).withColumn("node", F.xxhash64(F.lit(salt), "s"))
        found = stored(containing(holders.select(F.col(h).alias("text_id"), "t"), owned.select(F.col("node").alias("seed_id"), "s").distinct()).toDF(h, "node"))
        return found, owned.select(o, "node").join(found.select("node").distinct(), "node", "left_semi").select(o, "node")

    (ours, theirs), (theirs2, ours2) = side(own, "k", net, "n", "network"), side(net, "n", own, "k", "page")
    return ours.union(ours2), theirs.union(theirs2)


def late_marks(posts: DataFrame, late: DataFrame) -> DataFrame:
    """``session, post_id, late_id``: the posts that sponsored network posts mark when they come late, each its first match that isn't marked yet.

    ``posts(session, post_id, seq, text, marked)`` in the order of a session's page, ``late(session, late_id, seq, text)`` in the order of
    arrival; late texts under 30 units mark nothing.  What a late post finds depends on those before it, but only on those that can reach
    the same posts: a session falls apart into the groups that its shared seeds connect, and each group takes its late posts one after the other.
    A task holds the ids of one group's posts, listed by seed; no text and no pair.
    """
    from feedweave.llm.components import connected_components

    own = posts.where("not marked").select("session", "post_id", F.col("seq").alias("at"), T.compact(F.col("text")).alias("t")).withColumn("k", F.xxhash64("t"))
    net = late.where(T.units(F.col("text")) >= 30).select("session", "late_id", F.col("seq").alias("came"), T.compact(F.col("text")).alias("t")).withColumn("n", F.xxhash64("t"))
    ours, theirs = sharing_seeds(own.groupBy("k").agg(F.min("t").alias("t")), net.groupBy("n").agg(F.min("t").alias("t")))
    place = F.xxhash64("session", "node").alias("place")
    free = stored(ours.join(own.drop("t"), "k").select("session", "post_id", "at", place).distinct())
    asking = stored(theirs.join(net.drop("t"), "n").select("session", "late_id", "came", place).distinct())
    free, asking = free.join(asking.select("place").distinct(), "place", "left_semi"), asking.join(free.select("place").distinct(), "place", "left_semi")
    posted = free.groupBy("session", "post_id", "at").agg(F.collect_set("place").alias("places")).select("session", F.lit(0).alias("kind"), F.col("at").alias("o"), "post_id", F.lit(None).cast(dict(net.dtypes)["late_id"]).alias("late_id"), "places")
    came = asking.groupBy("session", "late_id", "came").agg(F.collect_set("place").alias("places")).select("session", F.lit(1).alias("kind"), F.col("came").alias("o"), F.lit(None).cast(dict(own.dtypes)["post_id"]).alias("post_id"), "late_id", "places")
    rows = stored(posted.union(came))
    groups = connected_components(rows.where(F.size("places") > 1).select(F.array_min("places").alias("a"), F.explode("places").alias("b")))
    rows = rows.withColumn("a", F.array_min("places")).join(groups, F.col("a") == F.col("id"), "left").withColumn("group", F.coalesce("component_id", "a"))

    def run(batches):
        now, lists, heads, taken = None, {}, {}, set()
        for batch in batches:
            found = []
            for group, kind, session, post, late_id, places in zip(*(batch[c].to_pylist() for c in ("group", "kind", "session", "post_id", "late_id", "places"))):
                if group != now:
                    now, lists, heads, taken, n = group, {}, {}, set(), 0
                if kind == 0:
                    for p in places:
                        lists.setdefault(p, []).append((n, post))
                    n += 1
                    continue
                best = None
                for p in places:
                    line, at = lists.get(p, ()), heads.get(p, 0)
                    while at < len(line) and line[at][1] in taken:
                        at += 1
                    heads[p] = at
                    if at < len(line) and (best is None or line[at] < best):
                        best = line[at]
                if best is not None:
                    taken.add(best[1])
                    found.append((session, best[1], late_id))
            yield pa.RecordBatch.from_arrays([pa.array(c, batch[name].type) for c, name in zip(zip(*found) if found else ((), (), ()), ("session", "post_id", "late_id"))], names=["session", "post_id", "late_id"])

    kinds = dict(rows.dtypes)
    dealt = rows.select("group", "kind", "o", "session", "post_id", "late_id", "places").repartition("group").sortWithinPartitions("group", "kind", "o", "post_id", "late_id")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("session", "post_id", "late_id")))


def text_upgrades(posts: DataFrame, late: DataFrame, least: int = 50) -> DataFrame:
    """``post_id, late_id, before, after``: the posts whose text a fuller one replaces, each time with the units before and after.

    ``posts(session, post_id, seq, text, classified)`` with the units that were classified last, 0 if none were yet, and ``late(session, late_id, seq,
    text)``.  A late text of over 30 units belongs to the first post of its session that shares a seed with it, and to no other; it replaces
    that post's text if it is more than ``least`` units longer than what was classified by then.
    """
    own = stored(posts.select("session", "post_id", F.col("seq").alias("at"), "classified", T.compact(F.col("text")).alias("t")).withColumn("k", F.xxhash64("t")))
    net = late.where(T.units(F.col("text")) > 30).select("session", "late_id", F.col("seq").alias("came"), T.units(F.col("text")).alias("u"), T.compact(F.col("text")).alias("t")).withColumn("n", F.xxhash64("t"))
    net = stored(net)
    ours, theirs = sharing_seeds(own.groupBy("k").agg(F.min("t").alias("t")), net.groupBy("n").agg(F.min("t").alias("t")))
    own, net = own.drop("t"), net.drop("t")
    heads = ours.join(own, "k").groupBy("session", "node").agg(F.min(F.struct("at", "post_id", "classified")).alias("m"))
    first = theirs.join(net.select("session", "n").distinct(), "n").join(heads, ["session", "node"]).groupBy("session", "n").agg(F.min("m").alias("m"))
    met = net.join(first, ["session", "n"]).select(F.struct("session", "m.post_id").alias("post"), F.struct("came", "late_id").alias("place"), "u", F.col("m.classified").alias("classified"))
    met = met.where("classified > 0").select(F.xxhash64("post").alias("key"), F.col("post.post_id").alias("post_id"), F.col("place.came").alias("came"), F.col("place.late_id").alias("late_id"), "u", "classified")

    def step(state: tuple, row) -> tuple:
        last = row.classified if state[1] is None else state[1]
        return (row.post_id, row.u, row.late_id, last) if row.u > last + least else (row.post_id, last, None, None)

    kinds = dict(met.dtypes)
    fields = [("post_id", kinds["post_id"]), ("after", "int"), ("late_id", kinds["late_id"]), ("before", "int")]
    found = history.folded(met.withColumn("order", F.format_string("%020d %s", F.col("came").cast("long") + (1 << 40), "late_id")), "key", "order", (None, None, None, None), step, fields)
    return found.where("before is not null").select("post_id", "late_id", "before", "after")


def known_when(posts: DataFrame, network: DataFrame) -> DataFrame:
    """``post_id, marked_at, late``: the posts that a remembered sponsored text gives away, when, and whether only after they had been seen.

    ``posts(post_id, seq, text)``, ``network(seq, text)`` of sponsored posts.  A seed is the beginning of a text of over 20 units, looked for
    with its first 30 characters in a post's first 200; seeds stay, so the first one to come decides.
    """
    seeds = network.where(T.units(F.col("text")) > 20).groupBy(F.left("text", F.lit(30)).alias("s")).agg(F.min("seq").alias("came")).withColumn("seed_id", F.xxhash64("s"))
    keyed = posts.withColumn("t", F.left("text", F.lit(200))).withColumn("k", F.xxhash64("t"))
    texts = keyed.groupBy("k").agg(F.min("t").alias("t"))
    hits = containing(texts.select(F.col("k").alias("text_id"), "t"), seeds.select("seed_id", "s"), 30)
    first = hits.join(seeds.select("seed_id", "came"), "seed_id").groupBy(F.col("text_id").alias("k")).agg(F.min("came").alias("came"))
    return keyed.join(first, "k").select("post_id", F.greatest("seq", "came").alias("marked_at"), (F.col("came") > F.col("seq")).alias("late"))


def nearest(marks: DataFrame, kind: str) -> DataFrame:
    """Per marker of a document the nearest position of ``kind``, ties to the earlier: two running values, no join of pairs."""
    return nearest_each(marks, (kind,)).select("doc_id", "pos", kind)


def nearest_each(marks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``doc_id, pos`` of each marker and the nearest value of each kind, all over one sort of ``marks(doc_id, kind, pos, value)``."""
    w = Window.partitionBy("doc_id").orderBy("pos", "value")
    past, coming = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = marks
    for k in kinds:
        here = F.when(F.col("kind") == k, F.struct("pos", "value"))
        rows = rows.withColumn(f"{k}_before", F.last(here, ignorenulls=True).over(past)).withColumn(f"{k}_after", F.first(here, ignorenulls=True).over(coming))

    def pick(k: str) -> Column:
        before, after = F.col(f"{k}_before"), F.col(f"{k}_after")
        best = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col("pos") - before["pos"] <= after["pos"] - F.col("pos"), before).otherwise(after)
        return best["value"].alias(k)

    return rows.where("kind = 'marker'").select("doc_id", "pos", *map(pick, kinds))


def other_with_prefix(rows: DataFrame, key: str, text: str, author: str, n: int = 60) -> DataFrame:
    """Each row with the author of the first other row whose text starts with the same n characters.

    The first two rows of a prefix are enough to answer for all of them, so a prefix's rows never meet in pairs.
    """
    p = rows.withColumn("p", F.left(text, F.lit(n)))
    firsts = p.groupBy("p").agg(F.min(F.struct(key, author)).alias("a"), F.count("*").alias("n"))
    second = p.join(firsts, "p").where(F.col(key) != F.col(f"a.{key}")).groupBy("p").agg(F.min(F.struct(key, author)).alias("b"))
    both = firsts.join(second, "p")
    found = p.join(both, "p")
    return found.select(key, F.coalesce(F.when(F.col(f"a.{key}") != F.col(key), F.col(f"a.{author}")).otherwise(F.col(f"b.{author}")), F.lit("(unknown)")).alias("other_author"))


def feature_gates(rows: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``rows(enabled, provider, feature, endpoint, model)`` with ``gate``: not_configured, unsupported or ready; a provider that isn't listed supports nothing."""
    known = capabilities.select(F.col("provider").alias("p"), "needs_endpoint", "deep", (F.col("brief") | F.col("candidate")).alias("brief"))
    runs = F.coalesce(F.when(F.col("feature") == "ai_analysis", F.col("deep")).otherwise(F.col("brief")), F.lit(False))
    gate = F.when(~F.col("enabled") | (F.col("provider") == "none"), "not_configured").when(~runs, "unsupported").when(F.col("needs_endpoint") & ((F.col("endpoint") == "") | (F.col("model") == "")), "not_configured").otherwise("ready")
    return rows.join(F.broadcast(known), F.col("provider") == F.col("p"), "left").withColumn("gate", gate).drop("p", "needs_endpoint", "deep", "brief")


def active_rules(rules: DataFrame, most: int = 10) -> DataFrame:
    """The first ten enabled rules in stored order, numbered from 1: a list of fixed length."""
    return rules.where("enabled").orderBy("ord").limit(most).withColumn("k", F.row_number().over(Window.orderBy("ord")))


def folded(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Posts with the first active rule whose score reaches its threshold; the score is the keyword's share of ten words."""
    listed = active_rules(rules).agg(F.array_sort(F.collect_list(F.struct("k", "rule_id", "keyword", "threshold"))).alias("rules"), F.collect_set("keyword").alias("keywords"))
    rows = posts.join(F.broadcast(listed), F.lit(True))  # one row: the rules
    named = F.filter(F.split(F.lower("full_text"), r"\s+"), lambda w: F.array_contains("keywords", w))
    # split once, not for each rule; the rules count in what is left
    hits = C.let(named, lambda words: F.filter("rules", lambda r: F.least(F.size(F.filter(words, lambda w: w == r["keyword"])) / 10, F.lit(1.0)) >= r["threshold"]))
    return rows.select("post_id", F.try_element_at(F.transform(hits, lambda r: r["rule_id"]), F.lit(1)).alias("fold_rule"), F.size(hits).alias("rule_hits"))
