"""The structured context of a post: who says what, what is shared, what is previewed, and its segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import clean as C
from feedweave.functions import text as T

CAP, MOST_SEGMENTS, MOST_TEXTS = 2000, 12, 8
# Section heads of the serialised form.
HEAD, SHARER, COMMENT, ORIGINAL, SHARED, PREVIEW, NO_COMMENT = "## 分享文結構", "分享者：", "### 分享者評論", "### 原始作者：", "### 被分享內容", "### 連結/影片預覽", "（分享者沒有加上文字）"
SHARES = ("share_without_comment", "reshare_with_comment")
KINDS = ("sharer_comment", "shared_content", "post_text", "link_preview", "image_text", "image_alt")


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def capped(c: Column) -> Column:
    return F.when(F.length(c) > CAP, C.trimmed(F.left(c, F.lit(CAP)))).otherwise(c)


def segments(context: Column) -> Column:
    """Segments of a context in their order: a share's comment and content or the post's text, preview, image texts, image descriptions.

    Empty ones are dropped, texts capped, texts of a kind that differ in white space alone come once, and there are twelve at most.
    """

    def one(kind: str, text: Column, on: Column) -> Column:
        return F.when(on, F.struct(F.lit(kind).alias("kind"), capped(C.trimmed(F.coalesce(text, F.lit("")))).alias("text")))

    def tagged(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), capped(C.trimmed(x)).alias("text"))

    share = context["is_share"]
    fixed = F.array_compact(F.array(
        one("sharer_comment", context["sharer_comment"], share), one("shared_content", context["shared_content"], share), one("post_text", context["own_text"], ~share), one("link_preview", context["link_preview"], F.lit(True)),
    ))
    listed = F.concat(fixed, F.transform(context["image_texts"], tagged("image_text")), F.transform(context["image_alts"], tagged("image_alt")))
    return F.slice(distinct_segments(F.filter(listed, lambda s: s["text"] != "")), 1, MOST_SEGMENTS)


def distinct_segments(listed: Column) -> Column:
    """Segments of which no earlier one of the kind has the same text but for white space."""
    key = lambda s: F.concat(s["kind"], F.lit("\u0000"), C.plain(s["text"]))
    first = lambda v: F.filter(v["s"], lambda s, i: F.array_position(v["k"], F.get(v["k"], i)) == i + 1)
    return C.let(F.struct(listed.alias("s"), F.transform(listed, key).alias("k")), first)


def serialised(context: Column, kind: Column, author: Column, reshare_author: Column) -> Column:
    """A share as titled sections, any other post as its text: what a model is asked about."""
    shared = F.left(C.trimmed(filled(context["shared_content"], context["link_preview"])), F.lit(CAP))
    label = F.when(context["shared_content"] != "", SHARED).otherwise(PREVIEW)
    comment = F.when((kind == "share_without_comment") | (context["sharer_comment"] == ""), NO_COMMENT).otherwise(context["sharer_comment"])
    lines = F.array_compact(F.array(
        F.lit(HEAD), F.concat(F.lit(SHARER), filled(author, F.lit("unknown"))), F.lit(COMMENT), comment, F.when(filled(reshare_author) != "", F.concat(F.lit(ORIGINAL), reshare_author)),
        F.when(shared != "", label), F.when(shared != "", shared),
    ))
    return F.when(context["is_share"], F.array_join(lines, "\n")).otherwise(F.left(C.trimmed(context["own_text"]), F.lit(CAP)))


def scannable(listed: Column) -> Column:
    """The segments a language checker reads: image descriptions left out, texts in images split off, eight characters at least, each text once across kinds; texts that differ in white space or compatibility forms are one."""

    def split(s: Column) -> Column:
        return C.let(C.image_parts(s["text"]), lambda v: F.concat(F.array(F.struct(s["kind"].alias("kind"), v["body"].alias("text"))), F.transform(v["image_texts"], lambda x: F.struct(F.lit("image_text").alias("kind"), x.alias("text")))))

    parts = F.filter(F.transform(F.flatten(F.transform(F.filter(listed, lambda s: s["kind"] != "image_alt"), split)), lambda s: F.struct(s["kind"].alias("kind"), C.chrome(s["text"]).alias("text"))), lambda s: F.length(s["text"]) >= 8)
    bare = lambda v: F.transform(v, lambda s: F.regexp_replace(T.nfkc(s["text"]), r"\s+", ""))
    return C.let(C.let(parts, lambda v: F.struct(v.alias("s"), bare(v).alias("k"))), lambda v: F.filter(v["s"], lambda s, i: F.array_position(v["k"], F.get(v["k"], i)) == i + 1))
