"""Sponsored marks on a page: which container each label of an ad belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweave.functions import text as T
from feedweave.functions.clean import let, trimmed
from feedweave.operators.tables import stored

# How far up a label's post is looked for, and the sizes in pixels that a post has.
UP_TO_POST, UP_TO_BOX = 25, 20
WIDTHS, HEIGHTS = (450, 720), (100, 1500)


def is_ad_label(raw, visible):
    """Whether an element is the label of an ad, by its raw text (a scrambled header) or the text that is seen of it, of 60 units at most."""
    seen = let(trimmed(F.coalesce(visible, F.lit(""))), lambda t: (t != "") & (T.units(t) <= 60) & (T.is_short_label(t) | T.has_delimited_label(t)))
    return T.is_spaced_ad(F.coalesce(raw, F.lit(""))) | seen


def sponsored_marks(elements: DataFrame, containers: DataFrame) -> DataFrame:
    """``page, element, container, post_id, created``: the container that each label of an ad marks; labels that mark none have no row.

    ``elements(page, element, place, raw, visible, path)`` with the ids of an element's ancestors, nearest first, and its place in the page's
    order; ``containers(page, container, post_id, marked, mixed, width, height, likes, comments, path)`` of those ancestors, ``post_id`` null where
    no post was seen.  Labels take their turn in the page's order, ties by id.  Each looks through 25 ancestors for the nearest post that
    isn't marked yet; one that holds several posts stops it without a mark.  A label that finds no post takes the nearest of 20 ancestors of a
    post's size for a new one, if it has buttons to like and comment and neither is nor lies in a post.

    Labels ask for their nearest free post in rounds; a post keeps the first that asked and sends the others on, which gives the
    same marks as one label after the other would.  A round is two equality joins; there are at most as many as posts nest.
    """
    labels = elements.where(is_ad_label(F.col("raw"), F.col("visible"))).select("page", F.struct("place", "element").alias("turn"), "path")
    labels = stored(labels)
    up = labels.select("page", "turn", F.posexplode(F.slice("path", 1, UP_TO_POST)).alias("d", "container"))
    posts = containers.where(F.col("post_id").isNotNull() & ~F.coalesce("marked", F.lit(False))).select("page", "container", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    found = up.join(posts, ["page", "container"]).groupBy("page", "turn").agg(F.array_sort(F.collect_list(F.struct("d", "container", "mixed"))).alias("posts"))  # 25 at most
    asking = stored(found.select("page", "turn", "posts", F.lit(1).alias("k")))
    while True:
        at = asking.withColumn("ask", F.get("posts", F.col("k") - 1))
        first = at.where("ask is not null and not ask.mixed").groupBy("page", F.col("ask.container").alias("container")).agg(F.min("turn").alias("first"))
        judged = at.withColumn("container", F.col("ask.container")).join(first, ["page", "container"], "left")
        lost = F.coalesce(F.col("turn") != F.col("first"), F.lit(False))
        asking = stored(judged.select("page", "turn", "posts", (F.col("k") + lost.cast("int")).alias("k"), lost.alias("lost")))
        if not asking.where("lost").limit(1).count():
            break
        asking = asking.drop("lost")
    asking = asking.withColumn("ask", F.get("posts", F.col("k") - 1))
    own = asking.where("ask is not null and not ask.mixed").select("page", "turn", F.col("ask.container").alias("container")).join(containers.select("page", "container", "post_id"), ["page", "container"])
    old = own.select("page", F.col("turn.element").alias("element"), "container", "post_id", F.lit(False).alias("created"))

    left = labels.join(asking.where("ask is not null").select("page", "turn"), ["page", "turn"], "left_anti")
    boxes = containers.where(F.col("width").between(*WIDTHS) & F.col("height").between(*HEIGHTS)).select("page", "container")
    near = left.select("page", "turn", F.posexplode(F.slice("path", 1, UP_TO_BOX)).alias("d", "container")).join(boxes, ["page", "container"])
    near = near.groupBy("page", "turn").agg(F.min(F.struct("d", "container"))["container"].alias("container"))
    firsts = near.groupBy("page", "container").agg(F.min("turn").alias("turn"))
    around = containers.select("page", "container", F.posexplode(F.concat(F.array("container"), "path")).alias("d", "over"))
    seen = containers.where("post_id is not null").select("page", F.col("container").alias("over"))
    within = around.join(seen, ["page", "over"], "left_semi").select("page", "container").distinct()
    able = firsts.join(containers.where(F.col("likes") & F.col("comments")).select("page", "container"), ["page", "container"], "left_semi").join(within, ["page", "container"], "left_anti")
    able = stored(able)
    # one that an earlier label takes for a post holds all within it
    before = able.join(around.where("d > 0"), ["page", "container"]).join(able.select("page", F.col("container").alias("over"), F.col("turn").alias("earlier")), ["page", "over"]).where("earlier < turn").select("page", "container").distinct()
    new = able.join(before, ["page", "container"], "left_anti").select("page", F.col("turn.element").alias("element"), "container", F.lit(None).cast(containers.schema["post_id"].dataType).alias("post_id"), F.lit(True).alias("created"))
    return old.union(new)
