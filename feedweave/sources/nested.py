"""Posts and sponsorship signals at any depth of nested JSON, descended level by level as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import rules as R
from feedweave.functions import text as T
from feedweave.functions.variants import is_kind, part
from feedweave.operators.tables import stored

POST_DEPTH, SIGNAL_DEPTH = 30, 15
LEVELS = 4  # descended in one step

# The fields that mark a sponsored post, by what their value must be.
TRUE_FIELDS = ("is_sponsored", "is_pseudo_organic")
OBJECT_FIELDS = ("sponsored_data", "boosted_post_data", "th_dat_spo")
TEXT_FIELDS = ("ad_id", "ad_client_token")
TRACKED = ("tracking_data", ("ad_id", "campaign_id"))
ANY_FIELDS = ("sponsor_id",)


def is_signal(key: Column, value: Column) -> Column:
    """Whether a field of an object says that it is sponsored: each name has a test of its own, and only true booleans are true."""
    inside = [part(value, f"$.{k}").isNotNull() for k in TRACKED[1]]
    return (
        F.when(key.isin(*TRUE_FIELDS), is_kind(value, "BOOLEAN") & F.coalesce(part(value, "$", "boolean"), F.lit(False)))
        .when(key.isin(*OBJECT_FIELDS), is_kind(value, "OBJECT", "ARRAY"))
        .when(key.isin(*TEXT_FIELDS), is_kind(value, "STRING") & (F.length(part(value, "$", "string")) > 0))
        .when(key == TRACKED[0], is_kind(value, "OBJECT") & (inside[0] | inside[1]))
        .when(key.isin(*ANY_FIELDS), ~is_kind(value, "VOID"))
        .otherwise(F.lit(False))
    )


def inside(level: DataFrame) -> DataFrame:
    """``id, path, key, value`` of what the objects and arrays among ``level(id, path, value)`` contain; scalars contain nothing."""
    rows = level.select("id", F.col("path").alias("above"), F.col("value").alias("whole")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("whole").outer()))
    return rows.select("id", F.concat("above", F.array("pos")).alias("path"), "key", "value")


def descended(roots: DataFrame, depth: int, wanted: Callable[[Column, Column], Column]) -> list[DataFrame]:
    """``id, path, key, value`` of the ``wanted(key, value)`` and the containers that the walk goes on from, within the objects and arrays of ``roots(id, value)`` down to those at ``depth``, the root itself at 0.

    The key is null in arrays; the path holds the places from the root on, an object's keys in alphabetical order.  LEVELS levels are
    taken at a time, each from the one above without a shuffle, and written before the next are read from them; the walk ends with the
    deepest container.  What is neither wanted nor gone on from isn't written: each level holds again all that lies below it.
    """
    found: list[DataFrame] = []
    level = roots.select("id", F.array().cast("array<int>").alias("path"), "value")
    for d in range(0, depth + 1, LEVELS):
        steps = []
        for _ in range(min(LEVELS, depth + 1 - d)):
            level = inside(level)
            steps.append(level.withColumn("step", F.lit(len(steps))))
        rows = steps[0]
        for more in steps[1:]:
            rows = rows.union(more)
        edge = (F.col("step") == len(steps) - 1) & is_kind(F.col("value"), "OBJECT", "ARRAY")
        rows = stored(rows.where(F.coalesce(wanted(F.col("key"), F.col("value")), F.lit(False)) | F.coalesce(edge, F.lit(False))))
        level = rows.where(edge).select("id", "path", "value")
        found.append(rows.drop("step"))
        if level.isEmpty():
            break
    return found


def signalled(roots: DataFrame, depth: int = SIGNAL_DEPTH) -> DataFrame:
    """The ``id`` of each root with a sponsorship signal among the fields of its objects down to ``depth``, the root itself at 0."""
    found = roots.select("id").limit(0)
    named = lambda key, value: key.isNotNull() & is_signal(key, value)
    for rows in descended(roots, depth, named):
        found = found.union(rows.where(named(F.col("key"), F.col("value"))).select("id"))
    return found.distinct()


def post_fields(v: Column) -> list[Column]:
    """A post's fields; author and text are null where the value isn't a post: its message has over three units and it names an author."""
    first = lambda *paths: F.coalesce(*(F.when(~is_kind(part(v, p), "VOID"), part(v, p, "string")) for p in paths))
    text = F.when(is_kind(part(v, "$.message.text"), "STRING"), part(v, "$.message.text", "string"))
    kind = R.post_type(v)
    shared = lambda p: F.when(kind == "reshare", part(v, p, "string"))
    return [
        F.coalesce(first("$.post_id", "$.story_id", "$.id", "$.feedback_id", "$.creation_story.post_id", "$.creation_story.id"), F.lit("")).alias("post_id"),
        first("$.actors[0].name", "$.owning_profile.name", "$.comet_sections.context_layout.story.actors[0].name").alias("author_name"),
        F.when(T.units(text) > 3, text).alias("text"), kind.alias("post_type"), shared("$.attached_story.message.text").alias("reshare_text"), shared("$.attached_story.actors[0].name").alias("reshare_author"),
    ]


def posts(responses: DataFrame) -> DataFrame:
    """``id, pos`` and the fields of every post within ``responses(id, body)``: outer before inner, the first of equal 50-character beginnings of a response.

    ``is_sponsored`` asks the post's own subtree only, never what encloses it.  Bodies that aren't JSON hold no posts.  Rows that repeat
    an id are one response.
    """
    roots = stored(responses.select("id", F.try_parse_json("body").alias("value")).where("value is not null"))
    # what the containers at depth 29 hold are the values of depth 30
    every = roots.select("id", F.array().cast("array<int>").alias("path"), "value")
    told = lambda key, value: is_kind(part(value, "$.message.text"), "STRING")
    for rows in descended(roots, POST_DEPTH - 1, told):
        every = every.union(rows.select("id", "path", "value"))
    found = every.where(is_kind(part(F.col("value"), "$.message.text"), "STRING")).select("id", "path", "value", *post_fields(F.col("value")))
    found = stored(found.where("text is not null and author_name <> ''").withColumn("begins", F.left("text", F.lit(50))))
    first = found.groupBy("id", "begins").agg(F.min("path").alias("path"))
    kept = stored(found.join(first, ["id", "begins", "path"]).withColumn("pid", F.xxhash64("id", "path")))
    sponsored = signalled(kept.select(F.struct("id", "path").alias("id"), "value")).select("id.*")
    marked = kept.join(sponsored.withColumn("is_sponsored", F.lit(True)), ["id", "path"], "left")
    pos = F.row_number().over(Window.partitionBy("id").orderBy("path")) - 1
    return marked.select("id", pos.alias("pos"), "post_id", "author_name", "text", F.coalesce("is_sponsored", F.lit(False)).alias("is_sponsored"), "post_type", "reshare_text", "reshare_author")
