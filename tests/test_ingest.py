"""Markers in pages, nested JSON and late marks on edge cases."""

import json
import random

from pyspark.sql import functions as F

from feedweave.operators import enrich
from feedweave.sources import markers, nested


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def message(text):
    return f'"message":{{"text":"{text}"}},'


MARK, ID = '"th_dat_spo":{"ad_id":"1"},', '"post_id":"%d",'


def test_scan_positions_and_bounds(spark):
    html = "😀é" + MARK + '"th_dat_spo":null,' + message("x" * 9) + message("y" * 10) + message("z" * 8000) + message("w" * 8001) + message(r"a \"quoted\" word") + ID % 5 + '"post_id":"x1"'
    rows = {(r["kind"], r["pos"], r["value"]) for r in markers.scan(pages(spark, html, None, "")).collect()}
    at = lambda s: len(html[: html.index(s)].encode("utf-16-le")) // 2
    assert rows == {
        ("marker", 3, MARK[:-1]), ("message", at('"message":{"text":"yy'), "y" * 10), ("message", at('"message":{"text":"zz'), "z" * 8000),
        ("message", at('"message":{"text":"a '), r"a \"quoted\" word"), ("post_id", at('"post_id":"5"'), "5"),
    }


def test_nearest_fields_of_each_marker(spark):
    actor = '"actors":[{"id":"1","name":"Ann \\u00e9"}],'
    tie = message("earlier of two") + '"th_dat_spo":{"c":"' + "x" * 14 + '"},' + message("later of two!!")
    assert len(message("earlier of two")) == len('"th_dat_spo":{"c":"' + "x" * 14 + '"},')
    html = [
        actor + message("first text here") + MARK + "-" * 300 + message("second text here") + ID % 2 + MARK,
        tie, MARK + MARK, message("short one") + MARK, actor + MARK + MARK, "nothing", message("no marker at all"),
    ]
    rows = sorted((tuple(r) for r in markers.sponsored_posts(pages(spark, *html)).collect()))
    assert rows == [
        (0, 1, "2", "first text here", "Ann é"), (0, 2, "2", "second text here", "Ann é"), (1, 1, "ssr-1", "earlier of two", ""),
        (4, 1, "ssr-1", "", "Ann é"), (4, 2, "ssr-2", "", "Ann é"),
    ]
    assert markers.sponsored_posts(spark.createDataFrame([], "page_id long, html string")).collect() == []


def greedy(posts, late, match):
    taken, out = set(), set()
    for session, late_id, _, text in sorted(late, key=lambda r: (r[0], r[2], r[1])):
        if len(text) >= 30:
            hit = next((p for s, p, _, t, marked in sorted(posts, key=lambda r: (r[0], r[2])) if s == session and not marked and (s, p) not in taken and match(t, text)), None)
            if hit is not None:
                taken.add((session, hit))
                out.add((session, hit, late_id))
    return out


def shares_seed(a, b):
    a, b = ("".join(x.split()).lower() for x in (a, b))
    cut = lambda x: x[: min(32, max(12, int(len(x) * 0.35)))]
    return len(a) >= 8 and len(b) >= 8 and (cut(b) in a or cut(a) in b)


def test_late_marks_equal_one_after_the_other(spark):
    rng = random.Random(4)
    stems = ["A shared story about cats and dogs in town", "A shared story about cats", "Another thing entirely for all of you here", "tiny", "A shared story about cats and birds at the sea, long ago"]
    posts = [(s, i, rng.randrange(1000), rng.choice(stems) + rng.choice(["", " more words follow", " and end"]), rng.random() < 0.2) for i in range(120) for s in [i % 4]]
    late = [(rng.randrange(4), f"g{i}", rng.randrange(50), rng.choice(stems) + rng.choice(["", " more words follow", " and end"])) for i in range(60)]
    posts += [(0, 500 + i, 2000, stems[2], False) for i in range(40)]
    late += [(0, f"h{i}", 60, stems[2]) for i in range(30)]
    posts = [(s, i, k, t, m) for k, (s, i, _, t, m) in enumerate(sorted(posts, key=lambda r: (r[0], r[2], r[1])))]
    p = spark.createDataFrame(posts, "session int, post_id int, seq int, text string, marked boolean")
    n = spark.createDataFrame(late, "session int, late_id string, seq int, text string")
    got = {tuple(r) for r in enrich.late_marks(p, n).collect()}
    assert got == greedy(posts, late, shares_seed) and len(got) > 40
    assert enrich.late_marks(p, n.limit(0)).collect() == [] and enrich.late_marks(p.limit(0), n).collect() == []


def test_known_when(spark):
    text = "Sponsored product launch with a distinctive text seed"
    posts = spark.createDataFrame([(1, 5, text + " and visible copy"), (2, 50, "x" * 150 + text), (3, 50, "x" * 180 + text), (4, 1, "A normal update"), (5, 1, None)], "post_id int, seq int, text string")
    network = spark.createDataFrame([(20, text), (30, text + " again"), (1, "too short to keep")], "seq int, text string")
    assert {tuple(r) for r in enrich.known_when(posts, network).collect()} == {(1, 20, True), (2, 50, False)}


def signalled(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, j string").select("id", F.parse_json("j").alias("value"))
    found = {r["id"] for r in nested.signalled(rows).collect()}
    return [i in found for i in range(len(values))]


def within(depth, value, lists=False):
    for k in range(depth):
        value = [value] if lists and k % 2 else {"a": value}
    return value


def test_signals_are_strict_and_bounded(spark):
    yes = [
        {"is_sponsored": True}, {"is_pseudo_organic": True}, {"sponsored_data": {}}, {"sponsored_data": []}, {"boosted_post_data": {"x": 1}}, {"ad_id": "1"}, {"ad_client_token": "t"},
        {"tracking_data": {"ad_id": None}}, {"tracking_data": {"campaign_id": 0}}, {"sponsor_id": 0}, {"sponsor_id": ""}, {"th_dat_spo": {}}, within(15, {"is_sponsored": True}), within(14, {"ad_id": "x"}, True), [[{"ad_id": "x"}]],
    ]
    no = [
        {"is_sponsored": "true"}, {"is_sponsored": 1}, {"is_sponsored": "false"}, {"is_sponsored": None}, {"sponsored_data": None}, {"sponsored_data": "x"}, {"ad_id": ""}, {"ad_id": 5}, {"tracking_data": {"page": 1}},
        {"tracking_data": ["ad_id"]}, {"tracking_data": "ad_id"}, {"sponsor_id": None}, {"th_dat_spo": None}, {"th_dat_spo": False}, within(16, {"is_sponsored": True}), {"is_sponsored_by": True}, [], {}, None, 3, "is_sponsored",
    ]
    assert signalled(spark, yes) == [True] * len(yes)
    assert signalled(spark, no) == [False] * len(no)


def test_posts_at_any_depth(spark):
    post = lambda i, text="some words", **more: {"post_id": i, "actors": [{"name": "Ann"}], "message": {"text": text}, **more}
    bodies = [
        {"data": [post("a", "first of equal beginnings" + "." * 40), post("b", "first of equal beginnings" + "." * 40 + "!"), post("c", "other")]}, post("d", attached_story={"actors": [{"name": "Bo"}], "message": {"text": "shared text"}}),
        within(30, post("e")), within(31, post("f")), {"is_sponsored": True, "node": post("g")}, post("h", deep=within(13, {"ad_id": "1"})), post("i", actors=[], owning_profile={"name": "Own"}), {"message": {"text": "no author"}}, post("j", "abc"),
        post("k", "ab😀"), post(None, story_id=7), post("l", is_text_only_story=False), post("m", is_text_only_story=True), post("n", url="https://h/reel/1"), post("o", "x" * 5, actors=[{"name": ""}]), post("p", message={"text": 12345}),
    ]
    rows = spark.createDataFrame([*((i, json.dumps(b)) for i, b in enumerate(bodies)), (90, "{broken"), (91, None), (92, "3")], "id int, body string")
    got = sorted(tuple(r) for r in nested.posts(rows).collect())
    plain = lambda i, key, text, sponsored=False, kind="standard", name="Ann": (i, 0, key, name, text, sponsored, kind, None, None)
    equal = "first of equal beginnings" + "." * 40
    assert got == [
        plain(0, "a", equal), (0, 1, "c", "Ann", "other", False, "standard", None, None), (1, 0, "d", "Ann", "some words", False, "reshare", "shared text", "Bo"), (1, 1, "", "Bo", "shared text", False, "standard", None, None),
        plain(2, "e", "some words"), plain(4, "g", "some words"), plain(5, "h", "some words", True), plain(6, "i", "some words", False, "page", "Own"), plain(9, "k", "ab😀"), plain(10, "7", "some words"),
        plain(11, "l", "some words"), plain(12, "m", "some words", False, "text_only"), plain(13, "n", "some words", False, "reel"),
    ]
