"""Edge cases of cleaning, single rules and ordered folds on small tables."""

from pyspark.sql import functions as F

from feedweave.functions import clean as C
from feedweave.functions import context as X
from feedweave.functions import rules as R
from feedweave.functions import scores as S
from feedweave.operators import enrich, history
from feedweave.operators.context import INPUTS, with_context


def each(spark, f, cases, columns="text string, author string, source string"):
    """``f`` over all inputs of the cases at once."""
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], f"i int, {columns}")
    names = [c.split()[0] for c in columns.split(", ")]
    return [r["r"] for r in rows.select("i", f(*(F.col(c) for c in names)).alias("r")).orderBy("i").collect()]


def test_identity(spark):
    cases = {
        ("Bob\n\nBob · 2小時\nHello Bob\nmore", "Bob", None): "Hello Bob\nmore", ("貓咪社團\nBob\nHello", "Bob", None): "Hello", ("Cats\nBob Hello", "Bob", "Cats"): "Hello", ("管理員 Hello", "Bob", "Cats"): "Hello",
        ("貓咪社團 Bob · Hello all", "Bob", None): "Hello all", ("Bobby says", "Bob", None): "Bobby says", (" x ", None, None): "x", ("Bob", "Bob", None): "", ("", "Bob", None): "", (None, "Bob", None): None,
        ("Bob 已驗證帳號\nHi", "Bob", None): "Hi", ("Bob: Bob: deep", "Bob", None): "deep",
    }
    assert each(spark, C.without_identity, cases) == list(cases.values())


def test_labels_and_attributions(spark):
    chrome = {("Hello\n查看更多留言\nx",): "Hello", ("hi See more 回覆 圖片 done\nAI 圖片觀察：x",): "hi done", ("回覆 查看 12 則回覆 end",): "end", (None,): None, ("看圖片說故事",): "看圖片說故事"}
    assert each(spark, C.chrome, chrome, "text string") == list(chrome.values())
    cases = {("Hello world 來源：Cats 3小時", "Bob", "Cats"): "Hello world", ("Hello 來源：Dogs 3小時", "Bob", "Cats"): "Hello 來源：Dogs 3小時", ("Hello 來源：Cats forever", "Bob", "Cats"): "Hello 來源：Cats forever"}
    assert each(spark, C.authored, cases) == list(cases.values())


def test_image_parts(spark):
    texts = [("Look 可能是顯示的文字是「HELLO」的圖像 and 可能是一隻貓的圖像 end",), ("「SALE」的圖像 now",), ("plain",), ("",)]
    found = each(spark, C.image_parts, texts, "text string")
    assert [(r["body"], r["image_texts"], r["image_alts"]) for r in found] == [("Look and end", ["HELLO"], ["一隻貓"]), ("now", ["SALE"], []), ("plain", [], []), ("", [], [])]


def test_context_of_shares(spark):
    rows = [
        ("Bob\nMy view of it", None, "Bob", None, None, "reshare_with_comment", None, "The original text of someone", "Ann"),
        ("## 分享文結構\n### 分享者評論\nNice one\n### 原始作者：Ann\n### 被分享內容\nThe story that Ann told", None, "Bob", None, "reshare", None, None, None, None),
        (None, None, None, None, None, None, None, None, None),
        ("Words of my own, quite a few.", None, "Bob", None, None, "standard", "Words of my own, quite a few.", None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in INPUTS))
    found = with_context(df).orderBy("i").select("context", X.segments(F.col("context")).alias("s")).collect()
    c = [r["context"] for r in found]
    assert (c[0]["is_share"], c[0]["sharer_comment"], c[0]["shared_content"], c[0]["original_author"]) == (True, "My view of it", "The original text of someone", "Ann")
    assert (c[1]["sharer_comment"], c[1]["shared_content"], c[1]["original_author"]) == ("Nice one", "The story that Ann told", "Ann")
    assert (c[2]["is_share"], c[2]["own_text"], found[2]["s"]) == (False, "", [])
    assert c[3]["own_text"] == "Words of my own, quite a few." and c[3]["link_preview"] == ""


def test_lines_and_objects(spark):
    lines = {("5h\nLike\nHello\n12\nxq\nno\n1,234",): "Hello\nno", ("a\n·\n",): "", (None,): None, ("Text\nx View more comments\nreply",): "Text"}
    assert each(spark, R.cleaned_lines, lines, "text string") == list(lines.values())
    objects = {('x {"a":{"b":1}} {"c":2}',): '{"a":{"b":1}}', ("{",): None, ("none",): None, ('{"a":"}"}',): '{"a":"}'}  # braces count wherever they stand
    assert each(spark, R.balanced_object, objects, "text string") == list(objects.values())
    fenced = {('Sure:\n```json\n{"c":1}\n```\nDone',): '{"c":1}', ('Here: {"c":1}',): None, (' {"c":1} ',): '{"c":1}', ("",): None}
    assert each(spark, S.json_body, fenced, "text string") == list(fenced.values())


def test_headline_signals_suppress(spark):
    names = ("commercial", "political", "emotional", "personal", "deep_commercial", "factual_risk", "text_ai", "image_ai", "low_quality", "manipulation")
    df = spark.createDataFrame([(0.0, 0.0, 0.8, 0.0, None, None, None, None, None, 0.9), (0.9, 0.0, 0.8, 0.0, 0.9, None, 0.75, None, None, None)], ", ".join(f"{n} double" for n in names))
    d = {n: F.col(n) for n in names} | {"needs_fact_check": F.lit(None).cast("boolean"), "insufficient": F.lit(False), "rule_hits": F.lit(0), "is_sponsored": F.lit(False)}
    s = S.headline_signals(d)
    assert [(r["fast"], r["deep"], r["severity"]) for r in df.select(*(c.alias(n) for n, c in s.items())).collect()] == [("", "ragebait", "high"), ("commercial,emotional_strong", "", "high")]


def test_folds_and_health(spark):
    rows = [(1, 1, 5, 0, True, True), (1, 2, 6, 3, True, False), (1, 3, 6, 11, True, False), (1, 4, 6, 12, True, False), (1, 5, 7, 13, False, False)]
    held = history.held(spark.createDataFrame(rows, "user_id long, seq long, post_id long, tick long, follow boolean, manual boolean"), hold=10)
    assert [(r["accepted"], r["current"]) for r in held.orderBy("seq").collect()] == [(True, 5), (False, 5), (True, 6), (False, 6), (False, 6)]
    ticks = spark.sql("""select * from values (1, 1, timestamp'2026-01-01 00:00:00', '/', false, true), (1, 2, timestamp'2026-01-01 00:00:30', '/', false, true), (1, 3, timestamp'2026-01-01 00:00:40', '/', true, true),
      (1, 4, timestamp'2026-01-01 00:00:50', '/messages/t', false, true), (1, 5, timestamp'2026-01-01 00:02:00', '/messages/t', false, true) as t(user_id, event_id, ts, path, emitted, has_main)""")
    assert [r["health"] for r in history.health(ticks, "user_id", "ts", "event_id").orderBy("event_id").collect()] == ["unknown", "unhealthy", "healthy", "unknown", "unknown"]


def test_seed_joins_with_copies(spark):
    posts = spark.createDataFrame([(i, f"Author {i % 2}", "The very same text of a post that many share") for i in range(40)] + [(99, "Author 0", "short")], "post_id long, author_name string, t string")
    net = spark.createDataFrame([(k, f"g{k}", "Author 1" if k % 2 else "Other", "The very same text of a post that many share, and more", k == 4) for k in range(2, 30)], "seq long, post_id string, author_name string, text string, is_sponsored boolean")
    found = {r["post_id"]: r["gql_id"] for r in enrich.first_match(posts, net).collect()}
    assert len(found) == 41 and all(found[i] == ("g3" if i % 2 else None) for i in range(40)) and found[99] is None
    late = enrich.retro_marked(posts.select("post_id", F.col("post_id").alias("seq"), F.col("t").alias("text"), (F.col("post_id") < 3).alias("marked")), net)
    assert [r[0] for r in late.collect()] == [3]
