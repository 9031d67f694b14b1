"""Gates of what is shown, labels and forms of letters, and sponsored marks against one label after the other."""

import random
import unicodedata

from pyspark.sql import functions as F

from feedweave.functions import gates as G
from feedweave.functions import text as T
from feedweave.operators import marks

WORDS = {"fallback": "evidence for {topic}?", "image": "generated?"}


def test_chips(spark):
    rows = [
        (1, False, 0.9, 0.1, "文字高度模板化。然後", None, [], "a post"), (2, False, 0.69, 0.9, "模板化", "手指畸形", None, ""), (3, False, 0.9, 0.9, "looks fine", "非 AI 生成", ["不是AI"], ""),
        (4, False, 0.8, None, "AI生成", None, [], "我今天用 Claude 寫程式"), (5, False, 0.8, None, "AI生成而且空泛", None, [], "我今天用 Claude 寫程式"), (6, True, 0.9, 0.9, "模板化", "AI合成", [], ""),
        (7, False, None, 0.75, None, None, [None, "", "臉部變形"], None), (8, False, 0.9, None, "   ", "罐頭文", None, None), (9, None, 0.7, 0.7, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "id int, filtered boolean, text_ai double, image_ai double, explanation string, summary string, insights array<string>, post_text string")
    found = {r.id: [(c.kind, c.score, c.percent) for c in r.chips] for r in d.select("id", G.ai_chips(F.struct(*d.columns[1:])).alias("chips")).collect()}
    assert found == {1: [("text", "0.9", 90)], 2: [("image", "0.9", 90)], 3: [("text", "0.9", 90)], 4: [], 5: [("text", "0.8", 80)], 6: [], 7: [("image", "0.8", 75)], 8: [("text", "0.9", 90)], 9: []}


def test_visible_questions(spark):
    q = lambda *texts: [(t, "context") for t in texts]
    rows = [
        (1, ["a"], None, [], [], None, None, "text", True, 0.8, True, False), (2, ["a"], None, q("Who?"), [], None, None, "text", True, 0.9, True, False), (3, ["低風險"], "", q("Who?"), [], None, None, "t", False, 0.0, True, True),
        (4, ["x"], None, q("是否為個人分享"), ["", "  Is it so? "], None, None, "t", False, None, True, True), (5, ["x"], None, [], ["商業推廣是否"], "待確認：abc。", "", "t", False, None, True, True), (6, ["x"], None, [], [], "待確認：abcd。！", "", "t", False, None, True, True),
        (7, ["x"], None, [], [], "abcd", None, "t", False, None, True, False), (8, ["需查證"], None, [], [], None, "short one", "t", False, None, False, False), (9, ["需查證 無需查核"], None, [], [], None, "short one", "t", False, None, True, False),
        (10, ["x"], None, q("Why?", "API docs?", "SDK?"), [], None, None, "t", False, None, False, False), (11, ["x"], None, q("API docs?"), [], "無事實風險", None, "t", False, None, False, False), (12, [], None, [], [], None, None, None, None, None, False, False),
        (13, ["x"], None, q("這張圖片是否為 AI 生成或模板素材？"), [], "低風險", None, "t", False, None, False, False), (14, ["x"], None, [], [], "長" * 60, None, "t", False, None, True, True),
    ]
    schema = "id int, rows array<string>, note string, questions array<struct<q:string,kind:string>>, asked array<string>, summary string, short string, text string, has_media boolean, image_ai double, worthy boolean, risky boolean"
    d = spark.createDataFrame(rows, schema)
    found = {r.id: [(x.q, x.kind) for x in r.v] for r in d.select("id", G.visible_questions(F.struct(*d.columns[1:]), WORDS).alias("v")).collect()}
    assert found == {
        1: [("generated?", "image")], 2: q("Who?"), 3: [], 4: [("Is it so?", "verify")], 5: [], 6: [("evidence for abcd?", "verify")], 7: [], 8: [], 9: [], 10: q("API docs?"), 11: [], 12: [],
        13: q("這張圖片是否為 AI 生成或模板素材？"), 14: [("evidence for " + "長" * 54 + "……?", "verify")],
    }


def test_locales_and_forms(spark):
    d = spark.createDataFrame([("zh_TW", "Ａ１ ｶﾞ"), ("ja-JP", "ﬁn"), ("en_GB", ""), ("xx", None), (None, "é한")], "c string, t string")
    got = d.select(G.locale_of(F.col("c")), G.labels_for(F.col("c"), "people"), T.nfkc(F.col("t")), "t").collect()
    assert [r[0] for r in got] == ["zh_TW", "ja", "en", "en", "en"] and got[1][1] == ["知り合いかも"] and len(got[3][1]) == 2
    assert all(r[2] == (unicodedata.normalize("NFKC", r[3]) if r[3] is not None else None) for r in got)


def one_after_the_other(labels, boxes):
    """The marks of one page: labels ``(place, element, path)`` in turn, boxes by id."""
    marked, created, out = {c for c, b in boxes.items() if b["marked"]}, set(), []
    seen = {c for c, b in boxes.items() if b["post_id"]}
    for place, element, path in sorted(labels):
        done = False
        for c in path[:25]:
            if c in seen and c not in marked and c not in created:
                if not boxes[c]["mixed"]:
                    marked.add(c)
                    out.append((element, c, False))
                done = True
                break
        for c in () if done else path[:20]:
            b = boxes[c]
            if 450 <= b["width"] <= 720 and 100 <= b["height"] <= 1500:
                if c not in seen | created and not (set(b["path"]) & (seen | created)) and b["likes"] and b["comments"]:
                    created.add(c)
                    out.append((element, c, True))
                break
    return out


def test_marks_equal_one_label_after_the_other(spark):
    rng = random.Random(5)
    elements, containers, want = [], [], set()
    for page in range(60):
        boxes = {}
        for c in range(rng.randint(1, 12)):
            up = rng.randrange(c) if c and rng.random() < 0.9 else None
            boxes[c] = {"path": [] if up is None else [up, *boxes[up]["path"]], "post_id": f"p{c}" if rng.random() < 0.5 else None, "marked": rng.random() < 0.1, "mixed": rng.random() < 0.1,
                        "width": rng.choice([300, 500, 720]), "height": rng.choice([99, 300, 1500]), "likes": rng.random() < 0.8, "comments": rng.random() < 0.8}
            containers.append((page, c, *(boxes[c][k] for k in ("post_id", "marked", "mixed", "width", "height", "likes", "comments", "path"))))
        labels = []
        for e in range(rng.randint(0, 14)):
            c, place, ad = rng.randrange(len(boxes)), rng.randrange(6), rng.random() < 0.8
            path = [c, *boxes[c]["path"]]
            elements.append((page, e, place, None, "Sponsored" if ad else "Sponsoring " * 9, path))
            if ad:
                labels.append((place, e, path))
        want |= {(page, *row) for row in one_after_the_other(labels, boxes)}
    e = spark.createDataFrame(elements, "page int, element int, place int, raw string, visible string, path array<int>")
    c = spark.createDataFrame(containers, "page int, container int, post_id string, marked boolean, mixed boolean, width int, height int, likes boolean, comments boolean, path array<int>")
    assert {(r.page, r.element, r.container, r.created) for r in marks.sponsored_marks(e, c).collect()} == want and len(want) > 60
    assert marks.sponsored_marks(e.limit(0), c).count() == 0
