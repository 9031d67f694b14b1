"""What of a deep reading is shown: chips for generated text and images, questions of a brief, and labels in the reader's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import flow as W
from feedweave.functions import panel as P
from feedweave.functions import text as T
from feedweave.functions.clean import let, trimmed

LEAST_SHOWN, LEAST_IMAGE_QUESTION, TOPIC_ROOM, LEAST_TOPIC = 0.7, 0.8, 54, 4
# Words that show why a text or image was taken for generated, and those that only mention the matter.
TEXT_STYLE = "高度模板化|模板化|公式化|空泛|機械式|罐頭文|高度工整|過度工整|報告式|模型摘要|自動生成摘要|語氣過度平衡"
TEXT_EVIDENCE = f"AI ?生成|模型生成|生成式文字|生成文|機器生成|內容農場|AI 文|{TEXT_STYLE}"
AI_TOPIC = "AI|人工智慧|生成式|大語言模型|LLM|ChatGPT|Claude|Gemini|Copilot|vLLM|模型|機器學習"
PERSONAL = "我(今天|昨天|最近|剛|每天|自己|覺得|認為|使用|用了|遇到|發現|分享)|我們(剛|最近|今天|昨天|公司|團隊|測試|使用|遇到)|個人(覺得|經驗|心得|推薦)"
PERSONAL_SUMMARY = "個人推薦|個人經驗|每天.*用|實測|心得"
IMAGE_EVIDENCE = "AI ?生成|AI ?合成|生成圖|合成圖|不自然|畸形|失真|臉部變形|手指|錯字|模糊文字|光影不自然"
NOT_GENERATED = "(?i)非 ?AI ?生成|不是 ?AI ?生成|非生成|非 ?AI|不是 ?AI"
# Briefs that call for nothing, questions not worth asking, texts worth looking up, and the words that deny it.
LOW_ACTION = "低風險|純(?:個人|生活|運動|娛樂|遊戲|商業)|無需(?:事實)?查核|無查核必要|無事實(?:查核)?需求|無(?:爭議|爭議性)(?:事實|主張)?|無事實風險"
LOW_VALUE = "是否.*(?:純個人分享|個人分享|商業(?:推廣|意圖)|推廣意圖)|(?:純個人分享|商業(?:推廣|意圖)).*是否"
WORTHY = "需查證|建議查證|政治議題|公共議題|政治討論|需要證據|事實風險|操弄風險|資訊來源|來源疑慮|各方觀點差異|官方(?:文件|文檔|資料|公告)|GitHub|原始碼"
NOT_WORTHY = "無明顯(?:公共議題|高?事實風險|來源疑慮)|無(?:高?事實風險|公共議題|來源疑慮|查核必要|需查證|資訊品質疑慮)|無需(?:事實)?查核"
IMAGE_QUESTION = r"這張圖片是否為\s*AI\s*生成或模板素材"
# Labels by locale.
LABELS = {
    "en": {"sponsored": ("Sponsored", "Paid partnership"), "suggested": ("Suggested for you", "Suggested"), "people": ("People You May Know", "People you may know")},
    "zh_TW": {"sponsored": ("贊助", "付費合作夥伴關係"), "suggested": ("為你推薦", "推薦"), "people": ("你可能認識的朋友",)},
    "ja": {"sponsored": ("広告", "スポンサー", "タイアップ投稿"), "suggested": ("おすすめ", "あなたへのおすすめ"), "people": ("知り合いかも",)},
}
ALL_SPONSORED = tuple(label for own in LABELS.values() for label in own["sponsored"])
ALL_SUGGESTED = tuple(label for own in LABELS.values() for label in (*own["suggested"], *own["people"]))


def said(c: Column) -> Column:
    """Whether there is more than white space; false for null."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def first_said(*columns: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def text_reason(explanation: Column, summary: Column) -> Column:
    """The first sentence of the explanation or else the summary, whichever says why the text looks generated; null if neither does."""
    shows = lambda c: F.when(said(c) & c.rlike(f"(?i){TEXT_EVIDENCE}"), c)
    return T.first_sentence(F.coalesce(shows(explanation), shows(summary)))


def shows_text_ai(likelihood: Column, explanation: Column, summary: Column, post_text: Column) -> Column:
    """Whether a text's likelihood of being generated is shown.

    It needs a reason; a post in the first person that only speaks about AI needs one about its style.
    """
    post, reason = F.coalesce(post_text, F.lit("")), text_reason(explanation, summary)
    about = post.rlike(f"(?i){AI_TOPIC}") & ~post.rlike(f"(?i){TEXT_EVIDENCE}")
    personal = post.rlike(PERSONAL) | F.coalesce(summary, F.lit("")).rlike(PERSONAL_SUMMARY)
    return F.coalesce((likelihood >= LEAST_SHOWN) & let(reason, lambda r: r.isNotNull() & ~(about & personal & ~r.rlike(f"(?i){TEXT_STYLE}"))), F.lit(False))


def image_text(summary: Column, insights: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(summary), F.coalesce(insights, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")), " ")


def shows_image_ai(likelihood: Column, summary: Column, insights: Column) -> Column:
    """Whether an image's likelihood of being generated is shown: if what was seen in it, denials aside, says so."""
    shown = F.regexp_replace(image_text(summary, insights), NOT_GENERATED, "").rlike(f"(?i){IMAGE_EVIDENCE}")
    return F.coalesce((likelihood >= LEAST_SHOWN) & shown, F.lit(False))


def ai_chips(d: Column) -> Column:
    """Chips ``kind, score, percent`` of a decision; none for posts that are filtered.

    ``d``: ``filtered, text_ai, image_ai, explanation, summary, insights, post_text``.
    """
    chip = lambda kind, on, c: F.when(on, F.struct(F.lit(kind).alias("kind"), F.format_string("%.1f", c).alias("score"), F.floor(c * 100 + 0.5).cast("int").alias("percent")))
    text, image = shows_text_ai(d["text_ai"], d["explanation"], d["summary"], d["post_text"]), shows_image_ai(d["image_ai"], d["summary"], d["insights"])
    chips = F.array_compact(F.array(chip("text", text, d["text_ai"]), chip("image", image, d["image_ai"])))
    return F.when(F.coalesce(d["filtered"], F.lit(False)), F.slice(chips, 1, 0)).otherwise(chips)


def preview(c: Column, limit: int) -> Column:
    return let(W.preview_line(c), lambda p: F.when(T.units(p) > limit, F.concat(trimmed(T.left_units(p, limit)), F.lit("……"))).otherwise(p))


def is_low_value(question: Column) -> Column:
    return question.rlike(LOW_VALUE)


def is_worth_looking_up(c: Column) -> Column:
    return c.rlike(WORTHY) & ~c.rlike(NOT_WORTHY)


def fallback_question(candidates: Column, anchor: Column, words: dict[str, str]) -> Column:
    """The first candidate worth asking, else a question about the anchor's topic; null if that has under four units."""
    worth = F.get(F.filter(F.transform(candidates, trimmed), lambda q: said(q) & ~is_low_value(q)), F.lit(0))
    topic = F.regexp_replace(preview(F.regexp_replace(F.coalesce(anchor, F.lit("")), "^待確認：", ""), TOPIC_ROOM), r"[。！？!?；;：:]+\z", "")
    made = let(topic, lambda t: F.when(T.units(t) >= LEAST_TOPIC, F.replace(F.lit(words["fallback"]), F.lit("{topic}"), t)))
    return F.coalesce(worth, made)


def visible_questions(b: Column, words: dict[str, str]) -> Column:
    """The questions of a brief that are shown, as ``q, kind``.

    ``b``: ``rows`` (lines shown), ``note``, ``questions`` (``q, kind``), ``asked`` (questions of claims, checks and background in this order),
    ``summary`` (of the deep reading), ``short`` (the event's), ``text``, ``has_media``, ``image_ai``, ``worthy`` and ``risky`` (by its scores: worth looking
    up; worth a question of our own).  ``words``: ``fallback`` with ``{topic}``, and ``image``.
    """
    item = lambda q, kind: F.struct(q.alias("q"), F.lit(kind).alias("kind"))
    none = F.slice(b["questions"], 1, 0)
    blank = lambda c: F.coalesce(c, F.lit(""))
    kept = F.filter(b["questions"], lambda x: x["q"].isNotNull() & ~is_low_value(x["q"]))
    image = F.coalesce(b["has_media"] & (b["image_ai"] >= LEAST_IMAGE_QUESTION), F.lit(False))
    shown = F.array_join(F.concat(b["rows"], F.array(blank(b["note"]))), " ", "")
    ours = fallback_question(b["asked"], first_said(b["summary"], F.get(b["rows"], F.lit(0)), b["short"], b["text"]), words)
    own = let(ours, lambda q: F.when(q.isNotNull(), F.array(item(q, "verify"))).otherwise(none))
    context = F.concat_ws(" ", blank(b["note"]), blank(b["summary"]), blank(b["text"]))
    acts = lambda x: x["q"].rlike(IMAGE_QUESTION) | P.is_actionable(F.concat_ws(" ", x["q"], blank(x["kind"]), context))
    some, lookup = F.size(kept) > 0, is_worth_looking_up(shown)
    worthy = F.when(some, kept).when(lookup | b["risky"], own).otherwise(none)
    harmless = F.when(~some, F.when(lookup, own).otherwise(none)).otherwise(F.slice(F.filter(kept, acts), 1, 1))
    by_image = F.when(some, kept).otherwise(F.array(item(F.lit(words["image"]), "image")))
    return F.when(b["worthy"] & image, by_image).when(shown.rlike(LOW_ACTION), none).when(b["worthy"], worthy).otherwise(harmless)


def locale_of(c: Column) -> Column:
    """The locale whose labels serve a reader: the one asked for, that of its language, else English."""
    language = F.regexp_extract(c, "^[^-_]*", 0)
    return F.when(c.isin(*LABELS), c).when(language.isin(*LABELS), language).otherwise("en")


def labels_for(c: Column, kind: str) -> Column:
    """The labels of a kind in a reader's locale."""
    out = F.array(*map(F.lit, LABELS["en"][kind]))
    for name, own in LABELS.items():
        out = F.when(locale_of(c) == name, F.array(*map(F.lit, own[kind]))).otherwise(out)
    return out
