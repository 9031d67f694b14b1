"""Cleaning of post texts as column expressions: interface labels, identities in front, attributions behind, image descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import text as T

# Labels, marks and forms of time whose wording decides results.
EXPAND = ("查看更多", "顯示更多", "顯示較少", "查看全文", "收起", "See more", "See less", "Show more", "Show less", "さらに表示", "表示を減らす", "더 보기", "간략히 보기")
COMMENTS = "查看更多留言|顯示更多留言|View more comments?|View previous comments?"
FEEDBACK = "你對這[則篇]貼文有興趣嗎[？?]?"
OBSERVATION = r"(?i)^\s*(?:AI\s*)?(?:圖片|圖像|影像|Image)\s*(?:觀察|判讀|分析|observation|analysis)s?\s*[：:]"
IMAGE = "圖像|影像|圖片|相片|照片"
BADGES = "管理員|社團專家|保持發言的成員|最常發言的成員|熱衷發言的成員|版主|Admin|Moderator|Group expert|Top contributor"
VERIFIED = "已驗證帳號|已验证账号|已驗證|Verified|追蹤|Follow|加入|Join|關注"
SOURCES = "社團|討論區|交流|中心|貼圖區|新聞|News|Taiwan|Club|Group|AI|技術|協會|譯站|論壇|社群"
DATE = "(?:[0-9]{1,2}月[0-9]{1,2}日|[0-9]+ ?(?:秒|分鐘|小時|天|週|月|年)|昨天|今天|剛剛)"
CLOCK = "(?: ?(?:上午|下午)? ?[0-9]{1,2}:[0-9]{2})?"
TIME_CHARS = "0-9年月日時小分秒上午下午"
SEPARATORS = r"[\s·•:：-]"
# Words without which the patterns above find nothing.
VERIFIED_WORDS = ("已驗證", "已验证账号", "verified", "追蹤", "follow", "加入", "join", "關注")
COMMENT_WORDS = ("查看更多留言", "顯示更多留言", "view more comment", "view previous comment")
IMAGE_WORDS = tuple(IMAGE.split("|"))
LABEL_WORDS = ("查看", "回答", "回覆", *IMAGE_WORDS, *EXPAND)
CHROME_WORDS = (*COMMENT_WORDS, "你對這", "觀察", "判讀", "分析", "observation", "analysis", *LABEL_WORDS)


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(T.WS_CHARS))


def plain(c: Column) -> Column:
    """Direction marks off, white space squeezed: the form in which context texts are compared."""
    return T.squeeze(T.without_bidi(c))


def without_comment_tail(c: Column) -> Column:
    """Cut where the comments or a question for feedback begin."""
    c = F.regexp_replace(c, rf"(?is)(?:^|\s)(?:{COMMENTS}).*", "")
    return F.regexp_replace(c, rf"(?is)(?:^|\s)(?:{FEEDBACK}).*", "")


def without_observations(c: Column) -> Column:
    """Lines that state what a model saw in an image are dropped."""
    return F.array_join(F.filter(F.split(c, "\r?\n"), lambda line: ~line.rlike(OBSERVATION)), "\n")


def without_labels(c: Column) -> Column:
    """One pass over a squeezed text: reply counters, lone words of reply and image, expand labels."""
    c = F.regexp_replace(c, r"(?i)(?:^| )(?:回答|回覆)? ?查看(?:全部)? ?[0-9]+ ?則(?:回覆|留言|留言回覆)(?=\z| )", " ")
    c = F.regexp_replace(c, r"(?:^| )(?:回答|回覆)(?=\z| )", " ")
    c = F.regexp_replace(c, rf"(?:^| )(?:的 ?)?(?:{IMAGE})(?=\z|[。.!！?？ ])", " ")
    c = F.regexp_replace(c, rf"(?i)(?:[.。…⋯]{{0,6}} ?)?(?:{'|'.join(EXPAND)}) ?", " ")
    return T.squeeze(c)


def chrome(c: Column) -> Column:
    """A post's text on one line without the interface's labels: four passes, after which a text that still changes is left."""


    def passes(x: Column) -> Column:
        out = plain(without_observations(without_comment_tail(x)))
        for _ in range(4):
            out = let(out, lambda v: F.when(T.holds(v, LABEL_WORDS), without_labels(v)).otherwise(v))
        return out

    return let(c, lambda x: F.when(T.holds(x, CHROME_WORDS), passes(x)).otherwise(plain(x)))  # most texts hold no label


def name_of(c: Column) -> Column:
    """A display name without marks of verification, up to its first separator."""
    bare = let(trimmed(c), lambda x: F.when(T.holds(x, VERIFIED_WORDS), F.regexp_replace(x, rf"\s*(?:{VERIFIED})\s*", " ")).otherwise(x))
    return T.squeeze(F.regexp_extract(bare, "^[^·•─✓]*", 0))


def is_line_of(line: Column, name: Column) -> Column:
    """A line that is the name, alone or before a separator."""
    bare = name_of(line)
    return F.coalesce((name != "") & ((line == name) | (bare == name) | line.startswith(F.concat(name, F.lit(" ·"))) | line.startswith(F.concat(name, F.lit(" •")))), F.lit(False))


def after_name(line: Column, name: Column) -> Column:
    """The line without the name in front, if a separator or the end follows it."""

    def cut(rest: Column) -> Column:
        return F.when((rest == "") | rest.rlike(f"^{SEPARATORS}"), trimmed(F.regexp_replace(rest, f"^{SEPARATORS}+", "")))

    fits = F.coalesce(line.startswith(name) & (F.length(name) >= 2), F.lit(False))
    return F.coalesce(F.when(fits, let(F.substring(line, F.length(name) + 1, F.length(line)), cut)), line)


def looks_like_source(c: Column) -> Column:
    return c.rlike(r"^我是.{1,12}人\z") | c.rlike(f"(?i)(?:{SOURCES})")


def after_unknown_source(line: Column, author: Column) -> Column:
    """What follows the author in a line that starts with the name of a group or page nobody named."""
    at = F.position(author, line)
    before = trimmed(F.call_function("substring_index", line, author, F.lit(1)))
    rest = trimmed(F.regexp_replace(F.substring(line, at + F.length(author), F.length(line)), f"^{SEPARATORS}+", ""))
    fits = lambda x: (F.length(x["before"]) >= 2) & (F.length(x["rest"]) >= 2) & ~x["before"].rlike("[。！？!?，,；;]") & looks_like_source(x["before"])
    found = let(F.struct(before.alias("before"), rest.alias("rest")), lambda x: F.when(fits(x), x["rest"]))
    return F.coalesce(F.when((author != "") & (at > 1) & (at <= 81), found), line)


def without_badge(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, rf"(?i)^(?:{BADGES})\s*", ""))


def without_hidden_time(line: Column) -> Column:
    """Of segments between dots, those behind one that hides a time among single letters."""

    def hides(x: Column) -> Column:
        return let(F.filter(F.split(x, r"\s+"), lambda t: t != ""), lambda t: (F.size(t) >= 12) & (F.size(F.filter(t, lambda w: F.length(w) <= 2)) >= 10)) & x.rlike("[時小天週月日分秒]")

    def cut(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda x, i: (i > 0) & (i < F.size(parts) - 1) & hides(x)), F.lit(True)).cast("int")
        return F.when((F.size(parts) >= 3) & (at > 0), F.array_join(F.slice(parts, at + 1, F.size(parts)), " · "))

    return F.coalesce(let(F.filter(F.transform(F.split(line, r"\s*·\s*"), trimmed), lambda x: x != ""), cut), line)


def without_identity(c: Column, author: Column, source: Column, inline: bool = True) -> Column:
    """A text without the lines and prefixes in front that only say who wrote it, and where.

    Lines are read from the top; blank ones and those that are a name are dropped, with no source given also two lines of an unknown
    source and the author.  The first other line loses names, unknown sources, hidden times (``inline``) and badges in front; if
    nothing is left of it, it is dropped and the next one read, else the rest stays as it is.
    """

    def cut(x: Column) -> Column:
        lines, who, where = x["lines"], x["who"], x["where"]

        def step(state: Column, i: Column) -> Column:
            line = trimmed(F.get(lines, i))
            after = trimmed(F.coalesce(F.get(lines, i + 1), F.lit("")))
            made = lambda at, text, done: F.struct(at.cast("int").alias("at"), text.alias("text"), F.lit(done).alias("done"))

            def judged(v: Column) -> Column:
                known = (v == "") | ((F.length(where) >= 2) & is_line_of(v, where)) | ((F.length(who) >= 2) & is_line_of(v, who))
                pair = (where == "") & (who != "") & looks_like_source(v) & is_line_of(after, who)
                rest = v
                for _ in range(4):
                    rest = let(let(rest, lambda r: after_name(r, where)), lambda r: after_name(r, who))
                rest = let(rest, lambda r: F.when(where == "", after_unknown_source(r, who)).otherwise(r))
                rest = without_badge(let(rest, without_hidden_time) if inline else rest)
                moved = let(rest, lambda r: F.when(r == "", made(i + 1, F.lit(""), False)).otherwise(made(i, r, True)))
                return F.when(known, made(i + 1, F.lit(""), False)).when(pair, made(i + 2, F.lit(""), False)).otherwise(moved)

            return F.when(state["done"] | (i < state["at"]), state).otherwise(let(line, judged))

        start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("text"), F.lit(False).alias("done"))
        end = F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step)
        whole = lambda e: F.when(e["done"], trimmed(F.array_join(F.concat(F.array(e["text"]), F.slice(lines, e["at"] + 2, F.size(lines))), "\n"))).otherwise("")
        return F.when((F.length(where) < 2) & (who == ""), trimmed(F.array_join(lines, "\n"))).otherwise(let(end, whole))

    bound = lambda x: F.struct(F.split(x, "\r?\n").alias("lines"), F.coalesce(name_of(author), F.lit("")).alias("who"), F.coalesce(name_of(source), F.lit("")).alias("where"))
    return let(c, lambda x: F.when(x.isNotNull(), let(bound(x), cut)))


def without_shared_identity(c: Column, author: Column, source: Column) -> Column:
    """What is shared without names, times, badges and reaction counters at either end: four rounds."""
    who, where = F.coalesce(trimmed(author), F.lit("")), F.coalesce(trimmed(source), F.lit(""))

    def byline(v: Column) -> Column:
        parts = F.filter(F.transform(F.split(v, r"\s*[·•]\s*"), trimmed), lambda x: x != "")

        def cut(p: Column) -> Column:
            front, last = F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), " "), F.element_at(p, -1)
            named = ((F.length(who) >= 2) & F.contains(front, who)) | ((F.length(where) >= 2) & F.contains(front, where))
            timed = front.rlike("[0-9].*[年月日時小分秒]|[年月日時小分秒].*[0-9]|(?:昨天|今天|剛剛)")
            return F.when((F.size(p) >= 2) & (F.length(last) >= 4) & (named | timed), last)

        return F.coalesce(F.when(F.size(parts) > 0, let(parts, cut)), v)

    def leading(v: Column, name: Column) -> Column:
        def cut(rest: Column) -> Column:
            glued = (rest == "") | rest.rlike(rf"(?i)^(?:{BADGES}|body\b)") | rest.rlike(rf"^(?:{FOLLOWED}|[{TIME_CHARS}:：/\-.]|\s|[·•-])")
            glued = glued | F.coalesce((F.length(who) >= 2) & rest.startswith(who), F.lit(False)) | F.coalesce((F.length(where) >= 2) & rest.startswith(where), F.lit(False))
            return F.when(glued | (name.rlike(r"\s") & rest.rlike("^[A-Z0-9#「『一-鿿]")), trimmed(F.regexp_replace(rest, f"^{SEPARATORS}+", "")))

        tail = F.substring(v, F.length(name) + 1, F.length(v))
        open_ = tail.rlike(f"^{SEPARATORS}")
        found = F.coalesce(let(F.regexp_replace(tail, r"^\s+", ""), cut), F.when(open_, trimmed(F.regexp_replace(tail, f"^{SEPARATORS}+", ""))))
        return F.coalesce(F.when((F.length(name) >= 2) & v.startswith(name), found), v)

    def times(v: Column) -> Column:
        v = trimmed(F.regexp_replace(v, rf"(?i)^(?:{FOLLOWED})\s*", ""))
        return trimmed(F.regexp_replace(v, rf"(?i)^{DATE}{CLOCK}[\s·•-]*", ""))

    def behind(v: Column, name: Column) -> Column:
        """The name off the end, if white space stands before it."""
        cut = F.left(v, F.greatest(F.length(v) - F.length(name), F.lit(0)))
        return F.when(F.coalesce((F.length(name) >= 2) & F.lower(v).endswith(F.lower(name)) & cut.rlike(r"\s\z"), F.lit(False)), trimmed(cut)).otherwise(v)

    word = "讚|回覆|留言|分享|Like|Reply|Comment|Share"
    out = trimmed(c)
    for _ in range(4):
        for f in (byline, lambda v: leading(v, where), lambda v: leading(v, who), times, without_badge, lambda v: trimmed(F.regexp_replace(v, rf"(?i)\s+{DATE}{CLOCK}\z", "")), lambda v: behind(v, who), lambda v: behind(v, where)):
            out = let(out, f)
        out = trimmed(F.regexp_replace(out, rf"(?i)(?:\s*{DATE}{CLOCK})?\s*(?:{word})(?:\s*(?:{word}|[0-9]+))*\s*\z", ""))
    return out


def sanitized_preview(c: Column) -> Column:
    """The lines of a link's preview without scrambled tokens, domains and machine tokens in front; lines of a name before a sentence go."""

    def line(v: Column) -> Column:
        words = F.split(plain(v), " ")
        head = let(words, lambda w: F.when(is_scrambled(F.get(w, F.lit(0))), F.array_join(F.slice(w, 2, F.size(w)), " ")).otherwise(F.array_join(w, " ")))
        head = let(head, lambda x: trimmed(F.regexp_replace(x, r"(?i)^(?:https?://|www\.)?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+(?:[/?#][^\s一-鿿A-Z]*)?", "")))
        repeated = lambda x: x.rlike(r"(?i)^([a-z]*[0-9][a-z0-9]*)(?: \1){0,2}\z") & x.rlike("^[A-Za-z0-9]{6}")
        return let(head, lambda x: F.when(repeated(x) | is_scrambled(x), "").otherwise(x))

    kept = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), line), lambda x: F.length(x) >= 2)
    named = lambda k: F.filter(k, lambda x, i: ~(x.rlike("^[一-鿿]{2,4}\\z") & F.coalesce(F.get(k, i + 1), F.lit("")).rlike("^[A-Z「『我你妳他她它這那]")))
    return F.array_join(let(kept, named), "\n")


def without_attribution(c: Column, author: Column, source: Column) -> Column:
    """A closing note of the source off, if it holds a known name and ends with a time; it may be all there is."""
    form = r"(?s)(?:^|\s+)來源：([^。！？!?]{2,180})\z"
    who, where = F.coalesce(name_of(author), F.lit("")), F.coalesce(name_of(source), F.lit(""))
    known = lambda tail: ((where != "") & F.contains(tail, where)) | ((who != "") & F.contains(tail, who))
    fits = let(name_of(F.regexp_extract(c, form, 1)), lambda tail: known(tail) & tail.rlike(f"(?i){DATE}\\z"))
    return F.when(F.contains(c, F.lit("來源：")) & c.rlike(form) & fits, trimmed(F.regexp_replace(c, form, ""))).otherwise(c)


def authored(c: Column, author: Column, source: Column) -> Column:
    return chrome(let(chrome(c), lambda v: without_attribution(v, author, source)))


# Passes over descriptions of images, in their order: what they find, and whether that is text in an image or a description.
LETTERED = r"可能是[^。！？\n]{0,160}?顯示的文字是「"
CLOSED = rf"((?:[^」]|」(?!的圖像|的影像|的圖片)){{2,2000}})」(?:的圖像|的影像|的圖片)"
PASSES = (
    (LETTERED + CLOSED, 1, " ", True), (LETTERED + r"([^」]{2,2000})」", 1, " ", True), (rf"(?:的插圖\s*)?{LETTERED}([^」]{{2,2000}})\z", 1, " ", True),
    (r"(^|\s)「" + CLOSED, 2, "$1", True), (rf"可能是([^。！？\n]{{1,160}})(?:的)?(?:{IMAGE})", 1, " ", False),
)


def image_parts(c: Column) -> Column:
    """A text split into ``body``, ``image_texts`` (what is written in images) and ``image_alts`` (what they are said to show), each text once."""
    tidy = lambda x: F.regexp_replace(chrome(x), r"^[\s，,、：:]+|[\s，,、：:]+\z", "")
    none = F.array().cast("array<string>")
    state = F.struct(T.without_bidi(c).alias("rest"), none.alias("texts"), none.alias("alts"))

    def run(form: str, group: int, left: str, lettered: bool):
        def step(v: Column) -> Column:
            found = F.filter(F.transform(F.regexp_extract_all(v["rest"], F.lit(form), F.lit(group)), lambda x: tidy(x if lettered else F.regexp_replace(x, r"的\z", ""))), lambda x: x != "")
            return F.struct(
                F.regexp_replace(v["rest"], form, left).alias("rest"), (F.concat(v["texts"], found) if lettered else v["texts"]).alias("texts"), (v["alts"] if lettered else F.concat(v["alts"], found)).alias("alts")
            )

        return step

    def passes(v: Column) -> Column:
        out = v
        for form, group, left, lettered in PASSES:
            out = let(out, run(form, group, left, lettered))
        return F.when(F.contains(v["rest"], F.lit("可能是")) | F.contains(v["rest"], F.lit("「")), out).otherwise(v)

    state = let(state, passes)
    last = rf"(?:^|\s)(?:的\s*)?(?:{IMAGE})(?=\z|[。.!！?？\s])"
    rest = lambda x: F.when(T.holds(x, IMAGE_WORDS), F.regexp_replace(x, last, " ")).otherwise(x)
    return let(state, lambda v: F.struct(chrome(rest(v["rest"])).alias("body"), F.array_distinct(v["texts"]).alias("image_texts"), F.array_except(F.array_distinct(v["alts"]), v["texts"]).alias("image_alts")))


def without_reference(body: Column, reference: Column) -> Column:
    """A quoted text of four characters or more off, literally; a body that is nothing but the reference stays."""
    ref = trimmed(reference)
    fits = F.coalesce((F.length(ref) >= 4) & (plain(body) != plain(ref)), F.lit(False))
    return trimmed(F.regexp_replace(F.when(fits, F.replace(body, ref, F.lit(" "))).otherwise(body), r"\n{3,}", "\n\n"))


# Predicates -----------------------------------------------------------------------------------------------------------------


def han(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsHan}"))


TIME_WORD = r"(?i)^(?:[0-9]+\s*)?(?:秒|分鐘|小時|天|週|月|年|昨天|今天|剛剛|上午|下午|am|pm)\z"
NO_CAPTION = rf"(?i)^(?:的\s*)?(?:{IMAGE})?\s*未提供相片說明[。.]?\z"
FOLLOWED = "追蹤|已追蹤|Follow|Following"
TIMES = rf"[{TIME_CHARS}:：/\-.\s]"


def is_byline(c: Column) -> Column:
    """A text that is only a time, a button beside it, or rests of either."""

    def judged(text: Column) -> Column:
        bare = F.regexp_replace(text, r"\s+", "")
        body = text.rlike(r"(?i)\bbody\b") & ((han(text) <= 2) | ((F.length(text) <= 16) & ~F.regexp_replace(text, "[」』）)]", "").rlike("[。！？!?，,；;]")))
        return (
            text.rlike(rf"(?i)^(?:{FOLLOWED})?\s*{TIMES}{{2,32}}\z") | text.rlike(rf"(?i)^(?:{FOLLOWED})\s*{TIMES}{{0,32}}\z") | bare.rlike(rf"(?i)^[{TIME_CHARS}:：/\-.]{{2,32}}\z")
            | bare.rlike(r"^(?:小時|分鐘|秒|天|週|月|年)[0-9]{1,2}(?:[0-9]{1,2})?\z") | bare.rlike(r"^[0-9]{1,2}(?:小時|分鐘|秒|天|週|月|年)(?:[0-9]{1,2})?\z") | body
        )

    return let(F.regexp_replace(plain(c), "[·•]", " "), judged)


def is_useful_reference(c: Column, least: int = 6) -> Column:
    """A text worth showing as what was shared: ``least`` characters or three Han signs long, no time, date, byline or missing caption."""
    text = plain(F.coalesce(c, F.lit("")))
    dated = text.rlike(r"(?i)^[0-9]{1,2}月[0-9]{1,2}日(?:\s*(?:上午|下午)?\s*[0-9]{1,2}:[0-9]{2})?\z")
    return ~((F.length(text) < least) & (han(text) < 3)) & ~text.rlike(TIME_WORD) & ~dated & ~is_byline(text) & ~text.rlike(NO_CAPTION)


def is_scrambled(c: Column) -> Column:
    """A token of letters and digits mixed so that it can only be an obscured time or id."""
    bare = F.regexp_replace(c, r"[^\p{L}\p{N}:年月日時小分秒上午下午]", "")
    mixed = (F.length(bare) >= 12) & (F.regexp_count(bare, F.lit("[A-Za-z]")) >= 4) & (F.regexp_count(bare, F.lit("[0-9]")) >= 4) & (F.regexp_count(bare, F.lit("[一-鿿]")) <= 2)
    return (F.length(bare) >= 8) & bare.rlike("[0-9]") & (mixed | bare.rlike("[0-9]+[年月日時小分秒]|[年月日時小分秒][0-9]") | bare.rlike("[A-Za-z]{5,}"))


def is_scrambled_short(c: Column) -> Column:
    bare = F.regexp_replace(c, r"[^\p{L}\p{N}:年月日時小分秒上午下午]", "")
    return F.length(bare).between(4, 24) & bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & bare.rlike(f"[{TIME_CHARS[3:]}]")


def is_useful_comment(c: Column) -> Column:
    text = plain(c)
    return (text != "") & ~is_byline(text) & ~is_scrambled(text)


PLAYER = rf"(?i)^(?:的\s*)?(?:{IMAGE})?\s*(?:[0-9]{{1,2}}:)?[0-9]{{1,2}}:[0-9]{{2}}\s*/\s*(?:[0-9]{{1,2}}:)?[0-9]{{1,2}}:[0-9]{{2}}\z"


def is_useful_preview(c: Column) -> Column:
    text = plain(F.coalesce(c, F.lit("")))
    return (F.length(text) >= 2) & ~text.rlike(TIME_WORD) & ~text.rlike(NO_CAPTION) & ~text.rlike(r"^.{2,80}貼文的(?:相片|照片|圖片)\z") & ~text.rlike(PLAYER)


def is_time_only(c: Column) -> Column:
    """Only a time once white space is gone."""
    bare = F.regexp_replace(c, r"\s+", "")
    return bare.rlike(r"(?i)^(?:剛剛|昨天|今天|Justnow|Yesterday|Today)\z") | bare.rlike(r"^(?=.{2,28}\z)(?=.*[0-9])(?=.*[年月日時小分秒上午下午天週周])[0-9年月日時小分秒上午下午天週周:：/.-]+\z")


def is_byline_only(c: Column) -> Column:
    bare = F.regexp_replace(c, r"\s+", "")
    return (bare == "") | is_time_only(bare) | bare.rlike(rf"(?i)^(?:{FOLLOWED})?[0-9年月日時小分秒上午下午天週周:：/.-]{{2,28}}\z")


def is_audience_label(c: Column) -> Column:
    bare = F.regexp_replace(c, r"\s+", "")
    return (bare == "") | is_time_only(bare) | bare.rlike(r"(?i)^(?:分享對象[:：]?.*|你的朋友|所有人|公開|朋友|只限本人|自訂|Public|Friends|Onlyme|Custom)\z")


def starts_comments(c: Column) -> Column:
    return trimmed(c).rlike(f"(?i)^(?:{COMMENTS})\\z")


def is_time_chrome(c: Column) -> Column:
    """A short text with a digit and a sign of time, without punctuation of sentences."""
    text = without_toggles(plain(c))
    bare = F.regexp_replace(text, r"\s+", "")
    return (text != "") & ~text.rlike("[。！？!?，,；;]") & (F.length(bare) <= 80) & bare.rlike("[0-9]") & bare.rlike("[年月日時小分秒上午下午:：]")


def without_toggles(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, "(?i)查看更多|顯示較少|See more|See less", " "), "[·•]", " "))


def is_source_name(c: Column) -> Column:
    """Nothing but what looks like the name of a group: short, no punctuation, five words at most."""
    text = plain(c)
    return F.length(text).between(2, 60) & ~text.rlike("[。！？!?,，；;:：]") & (F.size(F.split(text, " ")) <= 5) & text.rlike("(?i)(?:社團|討論區|交流|中心|貼圖區|Club|Group|協會|論壇|社群|讀書會)")
