"""Decisions around the panel: what is shown over a post, what a failed call leads to, what counts as one post, and what is searched for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import text as T
from feedweave.functions.clean import trimmed

# Sizes in pixels, words of labels, and the phrases that point back at a post.
OVER_WIDTH, OVER_HEIGHT = 800, 1800
SPONSORED, REELS, BIRTHDAYS = r"(?i)贊助|赞助|Sponsored", r"(?i)Reels?|短片", r"(?i)壽星|生日|Birthdays?"
LABEL_ROOM, CONTEXT_ROOM = 700, 420
POINTING = (
    (r"這篇(?:貼文|文章|內容)?", ""), (r"[此該本](?:貼文|文章|內容)", ""), (r"[這此該]則(?:貼文|內容)?", ""), (r"^貼文(?:中|裡|內)?(?:的)?", ""), (r"^[的之]", ""), (r"\s+", " "), (r"^[：:，,、\s]+", ""),
)
ARTIFACT = r"(?i)https?://|(?:^|\s)(?:curl|wget|npm|pnpm|brew|git)\s|fsSL|[a-z]{2,}:/{1,2}|\.g(?:\s|\z)"
PREVIEW = (
    (r"(?i)……\s*(?:查看更多|顯示更多|See more)", " "), (r"(?i)(?:查看更多|顯示更多|See more)\z", " "), (r"可能是[\s\S]{0,120}?顯示的文字是「[^」]{0,240}」(?:的圖像|的影像|的圖片)?", " "), (r"可能是[^。！？\n]{0,100}(?:圖像|影像|圖片|相片|照片)", " "),
)
GUESSED = r"^可能是(?:顯示的文字是|.*(?:圖像|影像|圖片|相片|照片))"
LINK = "(?i)https?://[^\\s)）\\]】>\"'「」]+"
NETWORK = r"(?:facebook\.com|fbcdn\.net|messenger\.com)\z"


def rewritten(c: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def surface(d: Column) -> Column:
    """What is done to a post's place on the page: ``fold, panel, oversized, nothing`` or ``overlay``.

    ``d``: ``filtered, fold_reason, mode, expanded, width, height, forced``.
    """
    fold = ~d["filtered"] & F.coalesce(d["fold_reason"] != "", F.lit(False)) & (d["mode"] == "collapse") & ~d["expanded"]
    return F.when(fold, "fold").when(~d["filtered"], "panel").when((d["width"] > OVER_WIDTH) | (d["height"] > OVER_HEIGHT), "oversized").when((d["mode"] == "none") & ~d["forced"], "nothing").otherwise("overlay")


def outcome(first: Column, second: Column, images: Column, dropped: Column) -> Column:
    """What a deep call ends with, tried again without images if these were at fault: ``ok, image_status, error, calls``.

    ``first`` and ``second`` hold ``ok, error``, ``first`` also ``retry_text_only, retry_status``; ``images`` were sent, ``dropped`` kept back.
    """
    again = ~first["ok"] & first["retry_text_only"] & (images > 0)
    fine = first["ok"] | (again & second["ok"])
    status = F.when(first["ok"], F.when(images > 0, "ok").when(dropped > 0, "filtered").otherwise("no_images")).when(fine, F.coalesce(first["retry_status"], F.lit("decode_failed")))
    error = F.when(~fine, F.coalesce(F.when(again, second["error"]), first["error"], F.lit("failed")))
    return F.struct(fine.alias("ok"), status.alias("image_status"), error.alias("error"), F.when(again, 2).otherwise(1).alias("calls"))


def without_pointing(question: Column) -> Column:
    """A question without words that only point at the post it is about."""
    return trimmed(rewritten(question, POINTING))


def preview_line(c: Column) -> Column:
    """A text on one line, without labels and guessed descriptions of pictures."""
    lines = F.filter(F.transform(F.split(rewritten(c, PREVIEW), "\r?\n"), trimmed), lambda x: (x != "") & ~x.rlike(GUESSED))
    return T.squeeze(F.array_join(lines, " "))


def search_text(c: Column, limit: int) -> Column:
    """A text as part of a search: its preview line within the room, without dots and marks at its end."""
    line = T.squeeze(F.regexp_replace(preview_line(c), "……+", " "))
    return F.trim(F.regexp_replace(F.trim(T.left_units(line, limit)), r"[。！？!?；;：:，,、\s]+\z", ""))


def first_outside_link(c: Column) -> Column:
    """The first link of a text that leaves the network, without tracking; null if none does."""
    links = F.filter(F.regexp_extract_all(c, F.lit(LINK), F.lit(0)), lambda u: (T.host(u) != "") & ~T.host(u).rlike(NETWORK))
    return T.without_tracking(F.get(links, F.lit(0)))


def search_query(question: Column, source: Column, link: Column, summary: Column, words: dict[str, str]) -> Column:
    """What is searched for a question: the context of the post, as much as fits, and the question without pointing words.

    ``words`` name the labels ``source, link, summary, question, officialInfo, publicSources`` and the ``separator``.  A question that holds
    commands or addresses isn't repeated.
    """
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    labelled = lambda name, c, room: F.when(said(search_text(c, room)), F.concat(F.lit(words[name] + words["separator"]), search_text(c, room)))
    context = F.array_join(F.array_compact(F.array(labelled("source", source, 180), labelled("link", link, 260), labelled("summary", summary, 180))), " ")
    context = F.when(T.units(context) <= CONTEXT_ROOM, context).otherwise("")
    bare = without_pointing(question)
    clean = search_text(F.when(bare != "", bare).otherwise(F.trim(question)), 120)
    asked = F.concat(context, F.lit(" " + words["question"] + words["separator"]), clean, F.lit(" " + words["publicSources"]))
    return F.when(context == "", clean).when(clean.rlike(ARTIFACT), F.concat(context, F.lit(" " + words["officialInfo"]))).otherwise(T.squeeze(asked))


def materials(p: Column) -> Column:
    """The names of what a post's reading rests on: ``is_share, sharer_comment, shared_content, original_author, link_preview, has_media, post_type, links``."""
    said = lambda n: F.coalesce(p[n] != "", F.lit(False))
    return F.array_compact(F.array(
        F.when(p["is_share"], F.when(said("sharer_comment"), "sharerComment").otherwise("noSharerComment")).otherwise("postText"),
        F.when(p["is_share"] & (said("shared_content") | (said("original_author") & p["has_media"] & ~said("link_preview"))), "sharedPost"),
        F.when(p["has_media"], F.when(F.coalesce(p["post_type"] == "reel", F.lit(False)), "video").otherwise("media")), F.when(p["links"] > 0, F.concat(F.lit("externalLinks:"), p["links"].cast("string"))),
    ))


def is_mixed(b: Column) -> Column:
    """Whether a container holds more than one post: ``height, reel_tray, child_posts, action_bars, nested_feed, composer, wrapper_author``."""
    tray, posts, bars = b["reel_tray"], b["child_posts"], b["action_bars"]
    return (
        (b["nested_feed"] & ((b["height"] > 900) | b["composer"])) | (b["wrapper_author"] & (bars >= 1)) | ((b["height"] > 3000) & (tray | (bars >= 2) | (posts >= 1))) | (tray & ((bars >= 2) | (posts >= 1))) | ((bars >= 2) & (posts >= 1)) | (posts >= 2)
    )


def surface_kind(s: Column, ads: Column, reels: Column) -> Column:
    """``right-rail-ad``, ``reel-section`` or null for a part of the page, if the setting for its kind is on: by place, size, links and the first words of its text.

    ``s``: ``text, place, collapsed, expanded, in_article, visible, has_content, reel_links, width, height``.
    """
    text = T.left_units(s["text"], LABEL_ROOM)
    free = ~s["collapsed"] & ~s["expanded"] & ~s["in_article"] & s["visible"]
    within = lambda v, low, high: (v <= 0) | ((v >= low) & (v <= high))
    ad = ads & free & (s["place"] == "rail") & ~text.rlike(BIRTHDAYS) & text.rlike(SPONSORED) & s["has_content"] & within(s["width"], 160, 520) & within(s["height"], 60, 800)
    reel = reels & free & (s["place"] == "feed") & (s["reel_links"] >= 3) & text.rlike(REELS) & within(s["width"], 320, 1 << 30) & within(s["height"], 120, 1200)
    return F.when(ad, "right-rail-ad").when(reel, "reel-section")
