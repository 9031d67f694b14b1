"""What happens next: the newest event patched, the next post to analyse, the last lines of a log, calls that took too long, briefs worth fetching ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.operators import history

LOG_LINES, AUDIT_LINES, REMEMBERED = 500, 200, 500
AHEAD = 2  # heights of the view within which a post is fetched ahead


def patched_latest(events: DataFrame, patches: DataFrame) -> DataFrame:
    """``events(post_id, seq, text, full_text, context)`` with the newest event of each post patched; what the patch leaves null stays.

    ``patches(post_id, text, full_text, context)``, one a post.  A patch that changes the text without bringing a context of its own drops
    the event's context, which belonged to the text before.  Patches of posts without events do nothing.
    """
    last = events.groupBy("post_id").agg(F.max("seq").alias("seq"))
    p = patches.select("post_id", F.col("text").alias("p_text"), F.col("full_text").alias("p_full"), F.col("context").alias("p_context")).join(last, "post_id")
    said = F.coalesce("p_full", "p_text")
    moved = F.coalesce(said != F.coalesce("full_text", "text"), said.isNotNull())
    context = F.when(F.col("p_context").isNotNull(), F.col("p_context")).when(moved, None).otherwise(F.col("context"))
    return events.join(p, ["post_id", "seq"], "left").select("post_id", "seq", F.coalesce("p_text", "text").alias("text"), F.coalesce("p_full", "full_text").alias("full_text"), context.alias("context"))


def next_in_queue(queue: DataFrame) -> DataFrame:
    """``tab, post_id``: of each tab's queue ``(tab, place, post_id, top, bottom, attached, mixed, view)`` the post in view nearest to its middle, else the first.

    Posts that left the page and containers of several posts aren't picked; ties go to the earlier place.
    """
    visible = (F.col("bottom") > 0) & (F.col("top") < F.col("view"))
    off = F.when(visible, F.abs((F.col("top") + F.col("bottom")) / 2 - F.col("view") / 2))
    return queue.where("attached and not mixed").groupBy("tab").agg(F.min(F.struct((~visible).alias("hidden"), F.coalesce(off, F.lit(0.0)).alias("off"), "place", "post_id")).alias("m")).select("tab", "m.post_id")


def next_ahead(posts: DataFrame) -> DataFrame:
    """``tab, post_id``: the nearest post below the view, within AHEAD of its heights, that is neither analysed nor waiting; ``(tab, place, post_id, top, attached, mixed, view, done, waiting)``."""
    below = F.col("top") - F.col("view")
    fit = posts.where(F.col("attached") & ~F.col("mixed") & ~F.col("done") & ~F.col("waiting") & (below > 0) & (below <= AHEAD * F.col("view")))
    return fit.groupBy("tab").agg(F.min(F.struct(below.alias("off"), "place", "post_id")).alias("m")).select("tab", "m.post_id")


def log_tail(logs: DataFrame, most: int = LOG_LINES) -> DataFrame:
    """The last ``most`` lines of each component's log ``(component, seq, level, line)``."""
    return history.last_n(logs, "component", "seq", most).drop("place")


def tab_statistics(parts: DataFrame) -> DataFrame:
    """Counts of a tab's parts ``(tab, kind, tagged, folded)``: articles, those tagged, and folded ones by kind."""
    return parts.groupBy("tab").agg(
        F.count_if(F.col("kind") == "article").alias("articles"), F.count_if("tagged").alias("tagged"), *(F.count_if(F.col("folded") & (F.col("kind") == k)).alias(n) for k, n in (("article", "folded_posts"), ("rail-ad", "folded_ads"), ("reels", "folded_reels"))),
    )


def answered_in_time(calls: DataFrame, replies: DataFrame, seconds: dict[str, int]) -> DataFrame:
    """``call_id, state, waited``: ``answered`` calls with the seconds they took, and those that ``timeout``; a reply that comes later changes nothing.

    ``calls(call_id, stage, sent)``, ``replies(call_id, came)``; the first reply counts, ``seconds`` is each stage's patience.
    """
    first = replies.groupBy("call_id").agg(F.min("came").alias("came"))
    patience = F.create_map(*(F.lit(x) for pair in seconds.items() for x in pair))[F.col("stage")]
    took = (F.unix_micros(F.col("came").cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))) / 1_000_000
    rows = calls.join(first, "call_id", "left").withColumn("took", took)
    fine = F.coalesce((F.col("took") >= 0) & (F.col("took") < patience), F.lit(False))
    return rows.select("call_id", F.when(fine, "answered").otherwise("timeout").alias("state"), F.when(fine, F.col("took")).otherwise(patience.cast("double")).alias("waited"))


def worth_fetching(events: DataFrame, completed: DataFrame, running: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The events whose brief is worth fetching ahead, one for each key of post, language and text: analysed, in view, allowed, without a brief, one that pends or an error.

    ``events(seq, post_id, lang, text_hash, analysed, brief, pending, failed, visible, allowed)``; ``completed(key, seq)`` holds only the ``most`` keys
    completed last, ``running(key)`` those on their way.
    """
    key = F.concat_ws(":", "post_id", "lang", "text_hash")
    open_ = events.where("analysed and not brief and not pending and not failed and visible and allowed").withColumn("key", key)
    known = history.lru(completed, "key", "seq", most).select("key")
    first = open_.join(known, "key", "left_anti").join(running.select("key"), "key", "left_anti").groupBy("key").agg(F.min("seq").alias("seq"))
    return first.select("key", "seq")
