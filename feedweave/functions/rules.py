"""Single rules as column expressions: lines, hashes, JSON helpers, labels, links and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import text as T
from feedweave.functions.clean import COMMENT_WORDS, let, trimmed

# Marks and lines that are no content, in the order in which they are looked for.
COMMENT_BOUNDARY = "(?is)(?:^|\\n)[^\\n]*(?:查看更多留言|顯示更多留言|View more comments?|View previous comments?).*\\z"
INLINE_NOISE = ("已驗證帳號", "已验证账号", "\\(已編輯\\)", "已編輯", "已编辑", "上線狀態指標", "在線上", "查看更多留言", "顯示更多留言", "分享對象：\\S*", "分享对象：\\S*", "(?i:Shared\\s+with\\s+Public)", "(?i:Shared\\s+with\\s+Friends)", "(?:Facebook\\s*){3,}", "你對這則貼文有興趣嗎？?")
# Words without which none of INLINE_NOISE is found.
NOISE_WORDS = ("已驗證帳號", "已验证账号", "已編輯", "已编辑", "上線狀態指標", "在線上", "查看更多留言", "顯示更多留言", "分享對象：", "分享对象：", "shared", "facebook", "你對這則貼文有興趣嗎")
DROPPED_LINES = (
    "(?i)^(?:Facebook\\s*)+\\z", "(?i)^[0-9]+\\s*[hmdwys]\\z", "^[0-9]+\\s*(?:小時|分鐘|秒|天|週|月|年)\\z", "(?i)^(?:昨天|今天|剛剛|上午|下午|am|pm)\\z",
    "(?i)^(?:Like|Comment|Share|Send|Save|讚|留言|分享|傳送|儲存|回覆|查看更多|顯示更多|追蹤|加入|關注|有興趣|沒興趣|已驗證帳號|上線狀態指標|在線上|發訊息)\\z", "^[·•]\\z", "^[0-9]{1,4}\\z",
)
ANY_DROPPED = f"^(?:{'|'.join(f'(?:{form})' for form in DROPPED_LINES)})"
TWO_LETTERS = "(?i)^(?:hi|he|we|do|go|no|me|my|to|on|at|in|of|is|it|so|up|be|by|if|or|us|am|pm)\\z"
ENGAGEMENT = {"reactions": "(?i)[0-9].*(?:心情|個讚|reactions?|others)", "comments": "(?i)[0-9].*(?:則留言|comments?)", "shares": "(?i)[0-9].*(?:次分享|shares?)"}
AD_BOILERPLATE = "(?i)^(?:贊助|赞助|Sponsored|廣告|广告|Ad Choices|右欄廣告|了解更多|Learn More|展開|隱私政策|服務條款|Cookie|More|更多)\\z"
DOMAIN = "(?i)^(?:https?://)?(?:www[.])?[a-z0-9-]+(?:[.][a-z0-9-]+)+(?:[/?#].*)?\\z"


def cleaned_lines(c: Column) -> Column:
    """The lines of a captured post that are content: noise, times, labels, counters and decoys go, counters at the end as well."""
    text = let(c, lambda x: F.when(T.holds(x, COMMENT_WORDS), F.regexp_replace(x, COMMENT_BOUNDARY, "")).otherwise(x))
    text = let(text, lambda x: F.when(T.holds(x, NOISE_WORDS), F.regexp_replace(x, "|".join(INLINE_NOISE), " ")).otherwise(x))

    def drop(x: Column) -> Column:
        n = F.length(x)
        return (n <= 1) | ((n == 2) & x.rlike("(?i)^[a-z]{2}\\z") & ~x.rlike(TWO_LETTERS)) | ((n > 20) & T.holds(x, ("facebook",)) & x.rlike("(?i)facebook")) | x.rlike(ANY_DROPPED)

    kept = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: ~drop(x))
    last = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(k), F.lit(1))), F.lit(0), lambda at, i: F.when(F.coalesce(~F.try_element_at(k, i).rlike("^[0-9,]+\\z"), F.lit(False)), i).otherwise(at))
    return trimmed(F.regexp_replace(let(kept, lambda k: F.array_join(F.slice(k, 1, last(k)), "\n")), "[ \\t]{2,}", " "))


def ad_name(c: Column) -> Column:
    """An advertiser's name without sponsor label and domain; null if nothing useful is left."""
    bare = F.regexp_replace(T.squeeze(c), r"(?i)^(?:贊助|赞助|Sponsored)\s*[·•:：-]?\s*", "")
    bare = trimmed(F.regexp_replace(bare, r"(?i)\s*(?:https?://)?(?:www[.])?[a-z0-9-]+(?:[.][a-z0-9-]+)+(?:/\S*)?\z", ""))
    return let(bare, lambda x: F.when(F.length(x).between(2, 80) & ~x.rlike(AD_BOILERPLATE) & ~x.rlike(DOMAIN), x))


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2 ** 32, without leaving 64 bits."""
    return (a.bitwiseAND(0xFFFF) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def fnv(c: Column, start: int, factor: int) -> Column:
    """A 32-bit hash of a string's UTF-16 units: exclusive or, then multiply."""
    return F.aggregate(T.unit_codes(c), F.lit(start).cast("long"), lambda h, x: _times(h.bitwiseXOR(x), factor))


def balanced_object(c: Column) -> Column:
    """The first object of a text, from its first brace to the one that closes it; null if none does."""

    def cut(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(state: Column, x: Column) -> Column:
            depth = state["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
            return F.when(state["end"] > 0, state).otherwise(F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), F.when(depth == 0, state["at"] + 1).otherwise(0).alias("end")))

        end = F.aggregate(F.split(s, ""), start, step, lambda state: state["end"])
        return let(end, lambda e: F.when(e > 0, F.left(s, e)))

    at = F.instr(c, "{")
    return F.when(at > 0, let(F.substring(c, at, F.length(c)), cut))


def unescaped(c: Column) -> Column:
    """A JSON string's text; what isn't one stays as it is."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), c, F.lit('"'))), "$", "string"), c)


def canonical(c: Column) -> Column:
    """A flat map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def post_type(v: Column) -> Column:
    """The kind of a post's node, by the first field that tells."""
    has = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "VOID", F.lit(False))
    return (
        F.when(has("$.attached_story"), "reshare").when(F.coalesce(F.contains(F.try_variant_get(v, "$.url", "string"), F.lit("/reel/")), F.lit(False)), "reel").when(has("$.target_group"), "group")
        .when(F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.is_text_only_story", "variant")) == "BOOLEAN") & F.try_variant_get(v, "$.is_text_only_story", "boolean"), F.lit(False)), "text_only")
        .when(~has("$.actors[0]"), "page").otherwise("standard")
    )


def issue(v: Column) -> Column:
    """A checker's issue with its defaults; null without what was found."""
    text = lambda path: F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    severity = F.try_variant_get(v, "$.severity", "string")
    suggestions = F.slice(F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.suggestions", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    at = F.greatest(F.lit(0), F.floor(F.coalesce(F.try_variant_get(v, "$.offset", "double"), F.lit(0.0))))
    return F.when(text("$.found").isNotNull(), F.struct(
        text("$.found").alias("found"), F.when(severity.isin("error", "warning", "info"), severity).otherwise("info").alias("severity"), F.coalesce(text("$.rule_type"), F.lit("unknown")).alias("rule_type"),
        at.alias("at"), suggestions.alias("suggestions"),
    ))


def model_key(c: Column) -> Column:
    """What names of the same model have in common."""
    bare = F.lower(F.regexp_replace(F.trim(c), r"(?i):latest\z", ""))
    return F.when(bare.isin("chrome-gemini-nano", "gemini nano"), "gemini-nano").otherwise(bare)


def shows_chip(headline: Column, label: Column) -> Column:
    """Whether a label is worth a chip of its own: not empty, and none of the headline's parts."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return (bare(label) != "") & ~F.array_contains(F.transform(F.split(headline, "｜"), bare), bare(label))


POST_PATH = "(?i)^/groups/[^/]+/posts/[^/]+|^/[^/]+/posts/[^/]+|^/(?:permalink|story|photo)[.]php\\z|^/photo/?\\z|^/share/[prv]?/[^/]+"


def is_post_url(c: Column) -> Column:
    h = T.host(c)
    return ((h == "facebook.com") | h.endswith(".facebook.com")) & T.path(c).rlike(POST_PATH)


def post_url_priority(c: Column) -> Column:
    p = T.path(c)
    return F.when(p.rlike("(?i)^/groups/[^/]+/posts/"), 1).when(p.rlike("(?i)^/[^/]+/posts/"), 2).when(p.rlike("(?i)^/(?:story|permalink)[.]php\\z"), 3).when(p.rlike("(?i)^/photo"), 4).otherwise(5)


def same_detail(a: Column, b: Column) -> Column:
    """Two details that say the same: equal without punctuation, white space and case, or one within the other from 24 characters on."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s，。！？；：、,.!?;:\"'「」『』（）()【】\[\]\-—]+", ""))
    x, y = bare(a), bare(b)
    return (x != "") & (y != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= 24) & (F.contains(x, y) | F.contains(y, x))))


def decided(posts: DataFrame) -> DataFrame:
    """Every decision that is given out on a post's way through the filters: ``event_id, step, stage, tier, filtered, pending, insufficient, error``.

    ``posts(event_id, enabled, allowed, sponsored, cached, shared, configured, n_chars, outcome)``; ``shared`` posts have no words of their own.
    Filters that are off give nothing, an allowed author one decision.  A sponsored post is filtered at once; then a cached result ends the
    way.  Others show their heuristic scores first, pending unless they are shares.  With a model and more than a character of its own words a
    post ends with the model's scores, with too little to judge, or with an error; with a model and less it ends with too little.
    """
    c = F.col
    cached = c("cached") & ~c("shared")
    runs = c("configured") & ~c("shared")
    made = lambda stage, tier=1, filtered=c("sponsored"), pending=False, insufficient=False, error=None: F.struct(
        F.lit(stage).alias("stage"), F.lit(tier).alias("tier"), filtered.alias("filtered"), F.lit(pending).alias("pending"), F.lit(insufficient).alias("insufficient"), F.lit(error).cast("string").alias("error"))
    result = (
        F.when(~runs, None).when(c("n_chars") <= 1, made("model", insufficient=True, error="too short")).when(c("outcome") == "timeout", made("model", error="timeout"))
        .when(c("outcome") == "empty", made("model", insufficient=True, error="empty")).otherwise(made("model", tier=3))
    )
    no = F.lit(False)
    steps = F.when(c("allowed"), F.array(made("allowed", filtered=no))).otherwise(F.array_compact(F.array(
        F.when(c("sponsored"), made("sponsored")), F.when(cached, made("cached", tier=3)), F.when(~cached & ~c("sponsored") & ~c("shared"), made("heuristic", filtered=no, pending=True)),
        F.when(~cached & ~c("sponsored") & c("shared"), made("heuristic", filtered=no)), F.when(~cached, result),
    )))
    return posts.where("enabled").select("event_id", F.posexplode(steps).alias("step", "d")).select("event_id", "step", "d.*")


def decisions(posts: DataFrame) -> DataFrame:
    """Each post of ``decided`` with its final state and tier, how many decisions were given out, and whether it is filtered in the end."""
    last = decided(posts).groupBy("event_id").agg(F.count("*").cast("int").alias("emitted"), F.max(F.struct("step", "stage", "tier", "filtered", "insufficient", "error")).alias("m"))
    state = F.when(F.col("m").isNull(), "none").when(F.col("m.stage") == "allowed", "kept").when(F.col("m.tier") == 3, "final").when(F.col("m.insufficient"), "insufficient").when(F.col("m.error").isNotNull(), "error").otherwise("heuristic")
    return posts.select("event_id").join(last, "event_id", "left").select("event_id", state.alias("state"), F.coalesce("emitted", F.lit(0)).alias("emitted"), F.col("m.tier").alias("tier"), F.coalesce("m.filtered", F.lit(False)).alias("filtered"))


def counted(posts: DataFrame) -> DataFrame:
    """One row: what a session counts of its posts: seen, sponsored, filtered, judged by heuristics, answered by the model, and answered with nothing."""
    seen = posts.where("enabled")
    open_ = ~F.col("allowed")
    runs = open_ & F.col("configured") & ~F.col("shared") & ~F.col("cached") & (F.col("n_chars") > 1)
    return seen.agg(
        F.count("*").alias("seen"), F.count_if(open_ & F.col("sponsored")).alias("sponsored"), F.count_if(open_).alias("tier1"), F.count_if(runs & (F.col("outcome") != "timeout")).alias("tier3"), F.count_if(runs & (F.col("outcome") == "empty")).alias("tier3_empty"),
    )


def new_rows(c: Column) -> Column:
    """The rows of an array that are not empty and say something that no earlier one says."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))

    def same(a: Column, b: Column) -> Column:
        return (a == b) | ((F.least(F.length(a), F.length(b)) >= 8) & (F.contains(a, b) | F.contains(b, a)))

    def step(kept: Column, x: Column) -> Column:
        return F.when((x == "") | F.exists(kept, lambda k: same(bare(k), bare(x))), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(F.transform(c, trimmed), F.array().cast("array<string>"), step)
