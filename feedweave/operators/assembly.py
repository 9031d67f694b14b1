"""Posts put together from what a page shows of them: the message, shared content, attachments, and what the network says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import clean as C
from feedweave.functions import panel as P
from feedweave.functions import rules as R
from feedweave.functions import text as T

# Labels of buttons, texts that are no message or attachment, and links that lead to content.
BUTTONS = ("讚", "Like", "留言", "Comment", "分享", "Share", "傳送", "Send", "儲存", "Save", "有興趣", "沒興趣", "傳送給朋友或在個人檔案上發佈。", "反應", "Reactions", "Reaction")
NO_MESSAGE = r"(?i)^Facebook\z|^[A-Za-z0-9]{12,}(?:\.com)?\z"
PICTURE_LABEL = "貼文的相片|個人檔案照片|封面相片"
BARE_URL = r"(?i)^(?:https?://|www\.)?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+(?:[/?#]\S*)?\z"
NO_ATTACHMENT = r"(?i)^(?:在 Reels 檢視畫面開啟 Reel|Open Reel in Reels|查看擁有者個人檔案|View owner profile|追蹤|Follow|原始音訊|Original audio)\z|^[a-z0-9]{10,}(?:\.com)?\z"
CONTENT_LINKS = ("/reel/", "/watch/", "/videos/", "/photo/?fbid=", "/photo.php?fbid=", "/posts/")
VERIFIED = "已驗證帳號|已验证账号|Verified"
LINES, ROOM, OTHER_LINK, UPGRADE = 3, 500, 40, 50


def is_message(text: Column, author: Column, source: Column) -> Column:
    """Whether a block of a post can be its message: long enough, and neither a label, a code, a link nor the name of author or source."""
    named = lambda who: F.coalesce((C.name_of(who) != "") & C.is_line_of(text, C.name_of(who)), F.lit(False))
    return (T.units(text) >= 8) & ~text.rlike(NO_MESSAGE) & ~text.rlike(PICTURE_LABEL) & ~text.rlike(BARE_URL) & ~named(source) & ~named(author)


def primary_message(blocks: DataFrame) -> DataFrame:
    """``post_id, message`` of each post that has one: its first block that can be the message.

    ``blocks(post_id, place, text, label, nested, after_comments, author_name, source_name)``: blocks of nested posts and those behind the
    beginning of the comments don't count, nor do buttons by their label.
    """
    open_ = ~F.col("nested") & ~F.col("after_comments") & ~F.coalesce(F.trim("label").isin(*BUTTONS), F.lit(False))
    empty = F.lit("")
    author, source = F.coalesce("author_name", empty), F.coalesce("source_name", empty)
    text = C.without_identity(R.cleaned_lines(F.col("text")), author, source, inline=False)
    # a generated row computes the text once; a filter would do so once for each test
    message = F.explode(F.filter(F.array(text), lambda x: is_message(x, author, source))).alias("message")
    rows = blocks.where(open_ & F.col("text").isNotNull()).select("post_id", "place", message)
    return rows.groupBy("post_id").agg(F.min(F.struct("place", "message")).alias("m")).select("post_id", "m.message")


def reshare_split(text: Column, authors: Column) -> Column:
    """``sharer_text, original_author, original_text``: a text cut at the first line that names one of the authors; null if none does between two parts that say something."""

    def cut(lines: Column) -> Column:
        at = lambda i: F.get(lines, i)
        named = lambda i: F.filter(authors, lambda a: C.is_line_of(at(i), a))
        before = lambda i: F.array_join(F.slice(lines, 1, i), "\n")
        after = lambda i: F.array_join(F.slice(lines, i + 2, F.size(lines)), "\n")
        fits = lambda i: (F.size(named(i)) > 0) & (T.units(before(i)) >= 2) & (T.units(after(i)) >= 4)
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - 2, F.lit(1))), fits)
        made = lambda i: F.struct(before(i).alias("sharer_text"), F.get(named(i), F.lit(0)).alias("original_author"), after(i).alias("original_text"))
        return F.when(F.size(lines) >= 3, F.get(F.transform(F.slice(places, 1, 1), made), F.lit(0)))

    return C.let(F.filter(F.transform(F.split(text, "\n"), C.trimmed), lambda x: x != ""), cut)


def repeats_own(own: Column, candidate: Column) -> Column:
    """Whether a candidate holds a post's own text, of 20 characters or more, or lies within it with as many."""
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), f"{T.WS}+", "") for c in (own, candidate))
    return (T.units(a) >= 20) & (F.contains(b, a) | ((T.units(b) >= 20) & F.contains(a, b)))


def useful_lines(text: Column) -> Column:
    """The lines of a cleaned link's text that may say what is attached."""
    lines = F.transform(F.split(text, "\n"), C.trimmed)
    return F.filter(lines, lambda x: (T.units(x) >= 2) & ~x.rlike(NO_ATTACHMENT) & ~x.rlike(BARE_URL))


def attachments(links: DataFrame) -> DataFrame:
    """``post_id, attachment``: up to three distinct lines of a post's links, content links first, then others that say enough; 500 units at most.

    ``links(post_id, place, href, text, own_text, names_author, shown, after_comments)``: hidden links and those behind the comments' beginning don't
    count, nor do links that only repeat the post's own text, and of the network's own pages not those that name an author.
    """
    content = F.lit(False)
    for mark in CONTENT_LINKS:
        content = content | F.contains("href", F.lit(mark))
    own = F.col("own_text")
    host = T.host(F.col("href"))
    author = F.coalesce(((host == "facebook.com") | host.endswith(".facebook.com")) & F.col("names_author"), F.lit(False))

    def fits(x: Column) -> Column:
        joined = F.array_join(x["lines"], "\n")
        return ~repeats_own(own, x["whole"]) & (x["content"] | (~repeats_own(own, joined) & (T.units(joined) >= OTHER_LINK) & ~author))

    read = F.struct(content.alias("content"), R.cleaned_lines(F.col("text")).alias("whole"))
    split = F.transform(F.array(read), lambda x: F.struct(x["content"].alias("content"), x["whole"].alias("whole"), useful_lines(x["whole"]).alias("lines")))
    rows = links.where("shown and not after_comments and href is not null").select("post_id", "place", F.explode(F.filter(split, fits)).alias("x"))
    lines = rows.select("post_id", (~F.col("x.content")).alias("late"), "place", F.posexplode("x.lines").alias("at", "line"))
    first = lines.groupBy("post_id", "line").agg(F.min(F.struct("late", "place", "at")).alias("o"))
    best = first.groupBy("post_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "line"))), 1, LINES).alias("l"))  # one row for each line of a post's links
    return best.select("post_id", T.left_units(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), ROOM).alias("attachment"))


def assembled(posts: DataFrame) -> DataFrame:
    """Each post as it is handed on, or ``skipped`` if it holds nothing: words of its own, what it shares, whose, and how sure they are.

    ``posts`` hold what the page shows (``post_id, dom_text, raw_author, source_name, marked_sponsored, recommended, attachment, reshare_authors, card_author,
    card_text, has_media``), what the network says of the matching post (``gql_text, gql_author, gql_type, gql_sponsored, gql_reshare_text,
    gql_reshare_author``, null without one) and whether its text is ``known_sponsored``.  The network's words go before the page's; attachments of
    recommended posts that the network doesn't call shares aren't evidence of a share.
    """
    c, said = F.col, lambda x: F.coalesce(x != "", F.lit(False))
    first = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))
    rows = posts.withColumn("author_name", F.coalesce(first(c("gql_author"), C.name_of(F.coalesce("raw_author", F.lit("")))), F.lit("")))
    whole = C.without_identity(F.coalesce(first(c("gql_text")), "dom_text", F.lit("")), c("author_name"), F.coalesce("source_name", F.lit("")), inline=False)
    rows = rows.withColumn("whole", whole).withColumn("is_sponsored", F.coalesce("gql_sponsored", F.lit(False)) | c("marked_sponsored") | c("known_sponsored"))
    rows = rows.withColumn("is_recommended", c("recommended") & ~c("is_sponsored"))
    reshare = F.coalesce(c("gql_type") == "reshare", F.lit(False))
    quiet = c("is_recommended") & ~reshare
    rows = rows.withColumn("seen", F.when(~quiet, c("attachment"))).withColumn("split", F.when(~quiet, reshare_split(c("whole"), c("reshare_authors"))))
    card = said(c("card_text"))
    told = reshare & said(c("gql_reshare_text"))
    silent_card = card & ((F.trim("whole") == "") | repeats_own(c("card_text"), c("whole")))
    silent = (said(c("seen")) & P.shares_without_comment(c("whole"), F.coalesce("seen", F.lit("")))) | silent_card | (told & (T.units(F.trim("whole")) <= 1))
    kind = F.when(silent, "share_without_comment").when(told | c("split").isNotNull() | card, "reshare_with_comment").otherwise("standard")
    rows = rows.withColumn("content_kind", kind).withColumn("original", first(c("gql_reshare_text"), c("card_text"), c("split.original_text")))
    alone = c("content_kind") == "share_without_comment"
    own = F.when(alone, "").when(c("content_kind") == "reshare_with_comment", first(c("split.sharer_text"), c("whole"))).otherwise(c("whole"))
    shared = F.when(alone, first(c("original"), c("gql_reshare_text"), c("seen"))).otherwise(c("seen"))
    by = first(F.when(card, c("card_author")), c("gql_reshare_author"), c("split.original_author"), F.when(alone, F.get("reshare_authors", F.lit(0))))
    fuller = F.coalesce(T.units(c("gql_text")) > T.units(F.coalesce("dom_text", F.lit(""))) + UPGRADE, F.lit(False))
    rows = rows.withColumn("text", F.coalesce(own, F.lit(""))).withColumn("shared", shared)
    return rows.select(
        "post_id", (~said(c("author_name")) & (F.trim("text") == "") & ~said(F.trim("shared")) & ~c("has_media")).alias("skipped"), "text", "author_name", "content_kind", c("shared").alias("shared_attachment"), c("original").alias("reshare_text"), by.alias("reshare_author"),
        "is_sponsored", "is_recommended", F.coalesce(c("raw_author").rlike(VERIFIED), F.lit(False)).alias("is_verified"), F.when(fuller, "expanded_or_upgraded").alias("completeness"), T.units(c("whole")).alias("classified_units"),
    )
