"""Posts put together, decisions step by step, reviews and the panel's next steps on edge cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedweave.functions import flow as W
from feedweave.functions import rules as R
from feedweave.functions import text as T
from feedweave.operators import assembly, enrich, flow, review


def test_primary_message(spark):
    kinds = "post_id int, place int, text string, label string, nested boolean, after_comments boolean, author_name string, source_name string"
    plain = lambda p, k, text, label=None, nested=False, after=False, author="Ann Lee", source="Cat Club": (p, k, text, label, nested, after, author, source)
    rows = [
        plain(1, 0, "Ann Lee"), plain(1, 1, "Cat Club · 2h"), plain(1, 2, "nested words of others", nested=True), plain(1, 3, "a button's longer text", " Share "), plain(1, 4, "https://example.org/a/b"), plain(1, 5, "abcdefgh12345678"), plain(1, 6, "Ann Lee\nthe message itself"), plain(1, 7, "a later block of text"),
        plain(2, 0, "seven 7"), plain(2, 1, None), plain(2, 2, "個人檔案照片 of somebody"), plain(3, 0, "the only words here", after=True), plain(4, 0, "no author is known here", author=None, source=None),
    ]
    found = assembly.primary_message(spark.createDataFrame(rows, kinds)).collect()
    assert {r["post_id"]: r["message"] for r in found} == {1: "the message itself", 4: "no author is known here"}
    assert assembly.primary_message(spark.createDataFrame([], kinds)).collect() == []


def test_reshare_splits(spark):
    cases = [
        ("said of it\nBo Li\nthe original words", ("said of it", "Bo Li", "the original words")), ("a\nb\nBo Li · 3h\nthe original\n\nwords", ("a\nb", "Bo Li", "the original\nwords")), ("x\nBo Li\nCy Wu\nlong enough", None),
        ("Bo Li\nthe original words\nmore", None), ("said of it\nBo Li\nabc", None), ("said of it\nBo Li", None), ("xx\nCy Wu\nfirst part\nBo Li\nsecond part", ("xx", "Cy Wu", "first part\nBo Li\nsecond part")), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t, ["Bo Li", "Cy Wu"]) for i, (t, _) in enumerate(cases)], "i int, t string, a array<string>")
    found = df.select("i", assembly.reshare_split(F.col("t"), F.col("a")).alias("s")).orderBy("i").collect()
    want = [w for _, w in cases]
    want[2] = ("x\nBo Li", "Cy Wu", "long enough")  # a single character isn't enough before the first name, two lines are before the second
    assert [tuple(r["s"]) if r["s"] else None for r in found] == want


def test_attachments(spark):
    kinds = "post_id int, place int, href string, text string, own_text string, names_author boolean, shown boolean, after_comments boolean"
    own = "these are the words of the post itself"
    rows = [
        (1, 0, "https://example.org/x", "A headline that is long enough to count here\nexample.org", own, False, True, False), (1, 1, "https://www.facebook.com/reel/1", "Reel caption\nOriginal audio\nFollow", own, False, True, False), (1, 2, "/watch/?v=1", "Reel caption\nSecond", own, False, True, False), (1, 3, "/posts/1", "Third\nFourth", own, False, True, False),
        (2, 0, "/posts/1", "quoting: " + own, own, False, True, False), (2, 1, "https://www.facebook.com/ann", "A profile whose name is long enough to be counted", own, True, True, False), (2, 2, "/reel/2", "hidden", own, False, False, False), (2, 3, "/reel/3", "behind comments", own, False, True, True), (2, 4, "https://e.org", "too short", own, False, True, False),
        (3, 0, "/reel/4", "x y " * 150, None, False, True, False), (3, 1, None, "no link at all, but long enough to be counted", None, False, True, False),
    ]
    found = {r["post_id"]: r["attachment"] for r in assembly.attachments(spark.createDataFrame(rows, kinds)).collect()}
    assert found == {1: "Reel caption\nSecond\nThird", 3: ("x y " * 150)[:500]}


def test_text_upgrades_follow_each_other(spark):
    text = "a post about cats and dogs that goes on for some time " * 3
    posts = spark.createDataFrame([(0, 1, 1, text, 100), (0, 2, 2, text, 0), (1, 3, 1, text, 0), (2, 4, 1, "something else entirely, with no seed in common", 10)], "session int, post_id int, seq int, text string, classified int")
    more = lambda n: text + "y" * n
    n = len(text)
    late = [(0, "a", 5, more(0)), (0, "b", 6, more(40)), (0, "c", 7, more(60)), (0, "d", 8, more(20)), (0, "e", 9, more(200)), (1, "f", 1, more(500)), (2, "g", 1, more(500)), (0, "h", 10, "short")]
    found = enrich.text_upgrades(posts, spark.createDataFrame(late, "session int, late_id string, seq int, text string")).collect()
    assert {tuple(r) for r in found} == {(1, "a", 100, n), (1, "c", n, n + 60), (1, "e", n + 60, n + 200)}


def test_decisions_step_by_step(spark):
    names = "event_id, enabled, allowed, sponsored, cached, shared, configured, n_chars, outcome".split(", ")
    base = {"enabled": True, "allowed": False, "sponsored": False, "cached": False, "shared": False, "configured": True, "n_chars": 9, "outcome": "scores"}
    cases = [
        ({"enabled": False}, []), ({"allowed": True, "sponsored": True}, ["allowed"]), ({}, ["heuristic", "model"]), ({"sponsored": True}, ["sponsored", "model"]), ({"sponsored": True, "cached": True}, ["sponsored", "cached"]), ({"cached": True}, ["cached"]),
        ({"shared": True}, ["heuristic"]), ({"shared": True, "cached": True}, ["heuristic"]), ({"shared": True, "sponsored": True}, ["sponsored"]), ({"configured": False}, ["heuristic"]), ({"n_chars": 1}, ["heuristic", "model"]), ({"outcome": "timeout"}, ["heuristic", "model"]), ({"outcome": "empty"}, ["heuristic", "model"]),
    ]
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], ", ".join(f"{n} {'int' if n in ('event_id', 'n_chars') else 'string' if n == 'outcome' else 'boolean'}" for n in names))
    steps = {}
    for r in R.decided(df).orderBy("event_id", "step").collect():
        steps.setdefault(r["event_id"], []).append(r)
    assert [[r["stage"] for r in steps.get(i, [])] for i in range(len(cases))] == [w for _, w in cases]
    assert steps[2][0]["pending"] and not steps[6][0]["pending"] and steps[3][1]["filtered"] and steps[2][1]["tier"] == 3
    last = {r["event_id"]: r for r in R.decisions(df).collect()}
    assert [last[i]["state"] for i in range(len(cases))] == ["none", "kept", "final", "final", "final", "final", "heuristic", "heuristic", "heuristic", "heuristic", "insufficient", "error", "insufficient"]
    assert R.counted(df).first().asDict() == {"seen": 12, "sponsored": 3, "tier1": 11, "tier3": 3, "tier3_empty": 1}


def test_hashes_count_units(spark):
    def fnv(text, h, factor):
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * factor) & 0xFFFFFFFF
        return h

    texts = ["", "abc", "é中", "😀", "a😀b𝄞"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.fnv(F.col("t"), 0x811C9DC5, 0x01000193).alias("h"), T.units(F.col("t")).alias("n")).collect()
    assert {r["t"]: (r["h"], r["n"]) for r in rows} == {t: (fnv(t, 0x811C9DC5, 0x01000193), len(t.encode("utf-16-be")) // 2) for t in texts}


def test_reviews_add_up(spark):
    kinds = "post_id int, kind string, seq int, found string, suggestions array<string>, rule_type string, severity string"
    rows = [
        (1, "shared_content", 1, "視頻", ["影片"], "lexical", "error"), (1, "post_text", 2, "，。", ["x"], "lexical", "error"), (1, "post_text", 3, "圖像", [" 影像"], "lexical", "warning"), (1, "post_text", 4, "圖像", ["畫"], "lexical", "warning"), (1, "post_text", 5, "seventeen letters", [], "grammar", "error"),
        (1, "post_text", 6, "fine", [], "punctuation", "error"), (2, "post_text", 1, "info only", [], "lexical", "info"), (3, "post_text", 1, "one", [], "lexical", "error"),
    ]
    df = spark.createDataFrame(rows, kinds)
    assert {tuple(r) for r in review.hints(df).collect()} == {(1, 2, True), (3, 1, False)}
    one = next(r for r in review.aggregated(review.segment_reviews(df)).collect() if r["post_id"] == 1)
    assert (one["issue_count"], one["badge_count"], one["warning"], one["error"], one["issue_summary"], one["examples"], one["signal"]) == (6, 2, 2, 4, {"lexical": 4, "grammar": 1, "punctuation": 1}, ["，。", "圖像", "圖像", "視頻"], 0.4)


def test_next_steps(spark):
    queue = [("t", 0, 10, -500, -100, True, False), ("t", 1, 11, 100, 300, True, False), ("t", 2, 12, 400, 520, True, False), ("t", 3, 13, 440, 460, False, False), ("t", 4, 14, 440, 460, True, True), ("u", 0, 20, 2000, 2100, True, False), ("u", 1, 21, 1000, 1100, True, False), ("v", 0, 30, 3000, 3001, True, False)]
    df = spark.createDataFrame([(*r, 900, False, False) for r in queue], "tab string, place int, post_id int, top int, bottom int, attached boolean, mixed boolean, view int, done boolean, waiting boolean")
    assert {tuple(r) for r in flow.next_in_queue(df).collect()} == {("t", 12), ("u", 20), ("v", 30)}
    assert {tuple(r) for r in flow.next_ahead(df).collect()} == {("u", 21)}
    at = datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, "fast", at), (2, "fast", at), (3, "deep", at), (4, "fast", at)], "call_id int, stage string, sent timestamp")
    replies = spark.createDataFrame([(1, at + timedelta(seconds=3)), (1, at + timedelta(seconds=2)), (2, at + timedelta(seconds=30)), (3, at + timedelta(seconds=44))], "call_id int, came timestamp")
    assert {tuple(r) for r in flow.answered_in_time(calls, replies, {"fast": 30, "deep": 45}).collect()} == {(1, "answered", 2.0), (2, "timeout", 30.0), (3, "answered", 44.0), (4, "timeout", 30.0)}


def test_questions_without_pointing_words(spark):
    cases = {"這篇貼文的說法是真的嗎": "說法是真的嗎", "貼文中的數據從哪來": "數據從哪來", "該文章：來源？": "來源？", "這則內容是誰寫的": "是誰寫的", "plain  question": "plain question", "這篇": ""}
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", W.without_pointing(F.col("q")).alias("r")).collect()
    assert {r["q"]: r["r"] for r in rows} == cases
