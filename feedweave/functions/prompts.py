"""What is asked of models: texts and messages put together from a post's parts, each part within its own bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import text as T

# Bounds in UTF-16 units, headings and lines of the prompts.
FAST, RESHARE, ORIGINAL, DEEP, IMAGES = 500, 300, 400, 8192, 4
BRIEF_TEXT, BRIEF_SHARED, BRIEF_LINK = 3000, 1600, 1000
KINDS = {"reshare": "轉發", "group": "社團", "reel": "Reel 短影片", "text_only": "純文字", "page": "粉專", "standard": "一般"}
RULES_HEAD = (
    "", "## 自訂規則", "在 JSON 內附加以下 key（0=完全不符合，1=完全符合）：", "每條規則只判斷貼文是否明確符合該規則，不要把政治、情緒或商業分數代入；否定或只是相近主題請給 0。",
    "否定範例：規則問「是否要求留言拿連結？」時，貼文「留言我不會傳連結」的規則分數是 0；貼文「留言+1我傳連結」的規則分數是 1。",
)
COMPACT_HEAD = (
    "", "## 額外自訂分類", "前 4 碼仍是商業/政治/情緒/個人。", "第 5 碼起依序追加下列規則分數；只在貼文明確符合規則時給高分，否定或只是相近主題不要高分。", "自訂規則只判斷規則文字本身，不要把政治、情緒或商業分數代入規則碼。",
    "否定範例：規則問「是否要求留言拿連結？」時，貼文「留言我不會傳連結」的規則碼是 0；貼文「留言+1我傳連結」的規則碼是 9。", "規則碼也是 0-9：0=不符合，5=可能相關，9=明確符合。",
)
TIME = {
    "en": ("## Time Context", "Current date/time (UTC): ", "User local time: ", "User timezone: ", "Current year: ", "Use this as the basis for relative-time and freshness judgments. Do not use the model's built-in current year."),
    "zh-TW": ("## 時間脈絡", "目前日期時間（UTC）：", "使用者本地時間：", "使用者時區：", "目前年份：", "請以此作為相對時間與時效性判斷基準，不要使用模型內建的現在年份。"),
}
ANSWER = {"en": "\n\n## Required Answer Language\nAlways answer in English. The post itself may be in any language.", "zh-TW": ""}
TEXT_HEAD = {"en": "## Post Text", "zh-TW": "## 貼文文字"}
BRIEF_HEAD = {"en": "Produce a reading brief from the following JSON. The post may be in any language; write all output fields in English.", "zh-TW": "請根據以下 JSON 產生閱讀簡報。"}


def lines(*parts: Column) -> Column:
    """The parts that aren't null, one below the other."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def fast(text: Column) -> Column:
    """The text alone, at most its first FAST units."""
    return T.left_units(text, FAST)


def sectioned(post: Column) -> Column:
    """A post with what is known of it: ``text, author_name, post_type, is_sponsored, is_verified, has_media, reactions, comments, shares, reshare_text, reshare_author``."""
    said = lambda c: F.coalesce(c != "", F.lit(False))
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), post["post_type"]), post["post_type"])
    engaged = F.array_join(F.array_compact(F.array(*(F.when(said(post[n]), post[n]) for n in ("reactions", "comments", "shares")))), "、")
    quoted = lambda c, n: F.concat(F.lit('"""'), T.left_units(c, n), F.lit('"""'))
    shared = (post["post_type"] == "reshare") & said(post["reshare_text"])
    own = F.when(F.coalesce(shared, F.lit(False)), lines(
        F.lit("### 轉發者評論"), quoted(post["text"], RESHARE), F.lit(""), F.concat(F.lit("### 原始貼文（"), F.when(said(post["reshare_author"]), post["reshare_author"]).otherwise("unknown"), F.lit("）")), quoted(post["reshare_text"], ORIGINAL),
    )).otherwise(quoted(post["text"], FAST))
    return lines(
        F.lit("## 貼文資訊"), F.when(said(post["post_type"]), F.concat(F.lit("- 類型："), label)), F.when(said(post["author_name"]), F.concat(F.lit("- 作者："), post["author_name"], F.when(post["is_verified"], "（已認證）").otherwise(""))),
        F.when(post["is_sponsored"], "- 贊助：是（Facebook 標記的付費廣告）"), F.when(post["has_media"], "- 媒體：有圖片/影片"), F.when(engaged != "", F.concat(F.lit("- 互動："), engaged)), F.lit(""), F.lit("## 貼文內容"), own,
    )


def rules_block(rules: Column, compact: bool = False) -> Column:
    """The lines that ask for the scores of ``rules array<struct<rule_id,prompt>>``; empty without any."""
    row = (lambda r, i: F.concat(F.lit("第 "), (i + 5).cast("string"), F.lit(" 碼 "), r["rule_id"], F.lit(": "), r["prompt"])) if compact else (lambda r, i: F.concat(F.lit("- r"), (i + 1).cast("string"), F.lit("："), r["prompt"]))
    head = F.array(*map(F.lit, COMPACT_HEAD if compact else RULES_HEAD))
    return F.when(F.size(F.coalesce(rules, F.array().cast("array<struct<rule_id:string,prompt:string>>"))) > 0, F.array_join(F.concat(head, F.transform(rules, row)), "\n")).otherwise("")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fast_messages(system: str, examples: list[tuple[str, str]], text: Column, rules: Column) -> Column:
    """The messages of the fast stage: instructions, worked examples ``(post, JSON answer)`` with a zero for each rule, and the post with its rules."""
    n = F.coalesce(F.size(rules), F.lit(0))
    zeros = F.when(n > 0, F.concat(F.lit(","), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit('"r'), i.cast("string"), F.lit('":0'))), ","))).otherwise("")
    shown = [m for post, answer in examples for m in (message("user", F.lit(post)), message("assistant", F.concat(F.lit(answer[:-1]), zeros, F.lit("}"))))]
    return F.array(message("system", F.lit(system)), *shown, message("user", F.concat(fast(text), rules_block(rules))))


def compact_messages(system: str, examples: list[tuple[str, str]], text: Column, rules: Column) -> Column:
    """As ``fast_messages`` for answers of one digit a score."""
    zeros = F.repeat(F.lit("0"), F.greatest(F.coalesce(F.size(rules), F.lit(0)), F.lit(0)))
    shown = [m for post, digits in examples for m in (message("user", F.lit(post)), message("assistant", F.concat(F.lit(digits), zeros)))]
    return F.array(message("system", F.lit(system)), *shown, message("user", F.concat(fast(text), rules_block(rules, compact=True))))


def when_asked(at: Column, zone: str) -> Column:
    """The moment of the question, as the prompts state it; ``at`` is a timestamp of a session in UTC."""
    local = F.from_utc_timestamp(at, zone)
    return F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("nowUtc"), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss").alias("localDateTime"), F.lit(zone).alias("timezone"), F.year(local).alias("currentYear"))


def deep_content(text: Column, images: Column, at: Column, zone: str, lang: Column) -> Column:
    """The parts of the deep stage's question: one text with the time, the answer's language and at most DEEP units of the post, then at most IMAGES images."""
    moment = when_asked(at, zone)
    stated = lambda k: lines(F.lit(TIME[k][0]), *(F.concat(F.lit(TIME[k][i + 1]), moment[n].cast("string")) for i, n in enumerate(("nowUtc", "localDateTime", "timezone", "currentYear"))), F.lit(TIME[k][5]))
    whole = lambda k: F.concat(stated(k), F.lit(ANSWER[k]), F.lit("\n\n"), F.lit(TEXT_HEAD[k]), F.lit("\n"), T.left_units(text, DEEP))
    kind = lambda t, x, u: F.struct(F.lit(t).alias("type"), x.alias("text"), u.alias("url"))
    none = F.lit(None).cast("string")
    shown = F.transform(F.slice(F.coalesce(images, F.array().cast("array<string>")), 1, IMAGES), lambda u: kind("image_url", none, u))
    return F.concat(F.array(kind("text", F.when(lang == "en", whole("en")).otherwise(whole("zh-TW")), none)), shown)


def risk(scores: Column, deep: Column) -> Column:
    """How much a post's scores call for care: ``highRisk``, ``lookupWorthy``, ``lowRiskPersonal``."""
    value = lambda s, n: F.coalesce(s[n], F.lit(0.0))
    check, factual, commercial = F.coalesce(deep["needsFactCheck"], F.lit(False)), value(deep, "factualRisk"), F.coalesce(deep["commercialIntent"], scores["commercial"], F.lit(0.0))
    marks = [value(scores, "political") >= 0.6, commercial >= 0.6, value(deep, "textAiLikelihood") >= 0.8, value(deep, "imageAiLikelihood") >= 0.8, value(deep, "lowQualitySignal") >= 0.6, value(deep, "manipulationRisk") >= 0.6]
    some = marks[0]
    for m in marks[1:]:
        some = some | m
    return F.struct((check | (factual >= 0.7)).alias("highRisk"), (check | (factual >= 0.5) | some).alias("lookupWorthy"), (~check & (factual < 0.4) & ~some).alias("lowRiskPersonal"))


def brief(post: Column, scores: Column, deep: Column, at: Column, zone: str, lang: Column) -> Column:
    """The question for a reading brief: an instruction and a JSON record of the post, its scores and its risk; absent values are left out.

    ``post``: ``author, ownText, sharerComment, isShare, sharedContent, linkPreview, imageTexts, imageAltTexts, originalAuthor, contentKind, hasMedia``.
    """
    shown = F.struct(
        post["author"].alias("author"), T.left_units(F.when(post["isShare"], post["sharerComment"]).otherwise(post["ownText"]), BRIEF_TEXT).alias("text"), T.left_units(post["sharedContent"], BRIEF_SHARED).alias("sharedText"),
        T.left_units(post["linkPreview"], BRIEF_LINK).alias("linkPreview"), F.slice(post["imageTexts"], 1, IMAGES).alias("imageText"), F.slice(post["imageAltTexts"], 1, IMAGES).alias("imageAlt"),
        post["originalAuthor"].alias("originalAuthor"), post["contentKind"].alias("contentKind"), post["hasMedia"].alias("hasMedia"),
    )
    english = lang == "en"
    payload = F.struct(F.when(english, "English").otherwise("Taiwan Traditional Chinese").alias("outputLanguage"), when_asked(at, zone).alias("temporalContext"), shown.alias("post"), deep.alias("tierB"), F.struct(scores.alias("scores")).alias("tierA"), risk(scores, deep).alias("riskProfile"))
    return F.concat(F.when(english, BRIEF_HEAD["en"]).otherwise(BRIEF_HEAD["zh-TW"]), F.lit("\n"), F.to_json(payload))
