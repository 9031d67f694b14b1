"""Streams with timers against plain versions whatever the order of arrival, and the cache that computes only what is missing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedweave.operators.cache import AnswerCache
from feedweave.operators.tables import VersionedTable, shared_folder
from feedweave.sources import markers
from feedweave.streaming import arrivals, timers
from feedweave.streaming.posts import drained

START = datetime(2024, 1, 1)
KINDS = "k int, event_id long, ts timestamp, on boolean, item long"
CLOSING = {"k": -1, "event_id": -1, "on": False, "item": -1}


def events(seed, n=120, span=20_000):
    rng = random.Random(seed)
    return [(rng.randrange(4), i, START + timedelta(seconds=rng.randrange(span)), rng.random() < 0.6, rng.randrange(7)) for i in range(n)]


def arriving(spark, rows, seed, slices=3, late=600):
    """The rows in an order of arrival in which nobody is later than the watermark allows."""
    rng = random.Random(seed)
    came = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.randrange(late)), r[1]))
    size = -(-len(came) // slices)
    parts = [rng.sample(p, len(p)) for p in (came[i : i + size] for i in range(0, len(came), size))]
    return arrivals.arriving([spark.createDataFrame(p, KINDS) for p in parts], CLOSING)


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


def plain_waits(rows, seconds, restart=False, once=False):
    out = set()
    for k, own in by_key(rows).items():
        running = False
        for i, (_, row, ts, on, _) in enumerate(own):
            starts = on and (restart or not running)
            running = on
            ends = next((r[2] for r in own[i + 1 :] if restart or not r[3]), None)
            if starts and (ends is None or ends - ts >= timedelta(seconds=seconds)) and not (once and any(x[0] == k for x in out)):
                out.add((k, row))
    return out


@pytest.mark.parametrize("restart, once", [(False, False), (False, True), (True, False)])
def test_waits_equal_plain_version(spark, restart, once):
    rows = events(3) + [(0, 500, START, True, 0), (0, 501, START, False, 0), (1, 502, START + timedelta(seconds=40_000), True, 0)]
    stream = timers.waited(arriving(spark, rows, 5), "k", "event_id", "on", 300, restart, once)
    found = drained(stream, "append")
    assert {(r["k"], r["event_id"]) for r in found.where("event_id >= 0").collect()} == plain_waits(rows, 300, restart, once)


def test_replay_and_ring_with_returning_items(spark):
    rows = events(9, 160)
    want, live = set(), set()
    for k, own in by_key(rows).items():
        buffer, members = [], 0
        for _, row, _, on, item in own:
            if item == 0:
                want |= {(k, p, row, members + 1) for p in buffer}
                members += 1
            else:
                buffer = [*buffer, row][-5:]
                live.add((k, row, None, members))
    stream = arriving(spark, rows, 2).withColumn("joins", F.col("item") == 0)
    assert {tuple(r) for r in drained(timers.replayed(stream, "k", "event_id", "joins", 5), "append").where("post >= 0").collect()} == want | live
    rings, returned = set(), 0
    for k, own in by_key(rows).items():
        held, gone = [], set()
        for _, row, _, _, item in own:
            left = None
            if item not in held:
                returned += item in gone
                held.append(item)
                left = held.pop(0) if len(held) > 3 else None
                gone.add(left)
            rings.add((k, row, item, len(held), left))
    assert {tuple(r) for r in drained(timers.ring(arriving(spark, rows, 4), "k", "event_id", "item", 3), "append").where("event_id >= 0").collect()} == rings and returned > 5


def test_late_marks_leave_the_state(spark):
    rows = events(6, 200, 100_000)
    posts, marks = (arriving(spark, rows, 1, 6).where(f"on = {on} or event_id < 0").select("k", F.col("event_id").alias(n), "ts") for on, n in ((True, "post"), (False, "mark")))
    found = drained(timers.with_late_marks(posts, marks, "k", "10 minutes"), "append")
    want = set()
    for _, row, ts, on, _ in rows:
        if on:
            hits = {m for k2, m, t2, on2, _ in rows if not on2 and k2 == _key(rows, row) and timedelta(0) <= t2 - ts <= timedelta(minutes=10)}
            want |= {(row, m) for m in hits} or {(row, None)}
    assert {(r["post"], r["mark"]) for r in found.where("post >= 0").collect()} == want
    assert max(found.state_rows) < 120 and found.state_rows[-1] <= 4  # what is left is the closing event


def _key(rows, row):
    return next(r[0] for r in rows if r[1] == row)


# Cache ------------------------------------------------------------------------------------------------------------------


def test_cache_computes_only_what_is_missing(spark):
    asked = []

    def compute(missing):
        asked.append(sorted(tuple(r) for r in missing.collect()))
        return missing.where("n < 90").select("key", F.concat("key", F.lit("!")).alias("answer"))

    cache = AnswerCache(spark, shared_folder(spark), "string", 300, lambda key, answer: answer != "bad!")
    requests = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("bad", 7), ("none", 90), (None, 1)], "key string, n int")
    out = lambda now: sorted(((r["key"], r["n"], r["answer"], r["hit"]) for r in cache.ask(requests, compute, now).collect()), key=str)
    first = out(1000)
    assert asked == [[("a", 1), ("b", 5), ("bad", 7), ("none", 90)]]
    assert ("a", 2, "a!", False) in first and ("bad", 7, "bad!", False) in first and ("none", 90, None, False) in first and (None, 1, None, False) in first
    assert {(r["key"], r["written"]) for r in cache.table.read().collect()} == {("a", 1000), ("b", 1000)}
    only = spark.createDataFrame([("a", 3), ("b", 4)], "key string, n int")
    assert all(r["hit"] for r in cache.ask(only, compute, 1299).collect()) and len(asked) == 1  # nothing was computed
    assert not any(r["hit"] for r in cache.ask(only, compute, 1300).collect()) and asked[-1] == [("a", 3), ("b", 4)]  # all has expired
    cache.write(spark.createDataFrame([("c", "c!")], "key string, answer string"), 1700)
    assert [r["key"] for r in cache.table.read().collect()] == ["c"]  # what has expired goes


def test_cache_keeps_the_newest(spark):
    cache = AnswerCache(spark, shared_folder(spark), "int", 1000, most=3)
    for now in range(5):
        cache.write(spark.createDataFrame([(f"k{now}", now)], "key string, answer int"), now)
    cache.write(spark.createDataFrame([("k3", 33)], "key string, answer int"), 9)
    assert sorted((r["key"], r["answer"]) for r in cache.table.read().collect()) == [("k2", 2), ("k3", 33), ("k4", 4)]


def test_versions_are_swapped_whole(spark):
    table = VersionedTable(spark, shared_folder(spark), "a int")
    assert table.read().collect() == []
    table.replace(spark.range(3).selectExpr("cast(id as int) as a"))
    reader = table.read()
    table.replace(table.read().where("a > 0"))
    assert reader.count() == 3 and table.read().count() == 2  # a reader of the version before isn't disturbed
    spark.range(9).selectExpr("cast(id as int) as a").write.parquet(f"{table.folder}/draft-left")  # by a writer that died
    assert table.read().count() == 2
    other = VersionedTable(spark, table.folder, "a int")
    other.versions = lambda: [1]  # it looked before the second version was there
    with pytest.raises(RuntimeError):
        other.replace(spark.range(1).selectExpr("cast(id as int) as a"))
    assert table.read().count() == 2


def test_cacheable_pages(spark):
    good = [("1", "text", "author")]
    long = [("1", "x" * 5001, "author")]
    cases = [
        ("https://www.facebook.com/groups/a/posts/1", good, True), ("https://facebook.com/", good, True), ("https://evil.example/posts/1", good, False), ("https://notfacebook.com/", good, False), ("ftp://facebook.com/", good, False),
        ("https://facebook.com/", long, False), ("https://facebook.com/", [("1", "text", " ")], False), ("https://facebook.com/", good * 30, True), ("https://facebook.com/", good * 31, False), ("https://facebook.com/", [], False),
        ("https://facebook.com/" + "x" * 2030, good, False), ("https://facebook.com/", [("1", "x" * 4990, "a")] * 25, False), ("https://facebook.com/", [("1", None, "a")], False), (None, good, None),
    ]
    rows = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(cases)], f"i int, url string, posts {markers.POSTS}")
    found = {r["i"]: r["ok"] for r in rows.select("i", markers.cacheable(F.col("url"), F.col("posts")).alias("ok")).collect()}
    assert [found[i] for i in range(len(cases))] == [w for _, _, w in cases]
