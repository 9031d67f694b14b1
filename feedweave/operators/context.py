"""Posts with their structured context, built in stages: each stage is a projection that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import clean as C
from feedweave.functions.context import COMMENT, NO_COMMENT, ORIGINAL, SHARED, SHARES, filled

INPUTS = ("text", "full_text", "author_name", "source_name", "post_type", "content_kind", "shared_attachment", "reshare_text", "reshare_author")


def with_context(posts: DataFrame, least: int = 6, useful_comment: Callable[[Column], Column] = C.is_useful_comment) -> DataFrame:
    """``posts`` with the columns INPUTS (strings, null or empty where unknown) and, behind all its own, the struct ``context``.

    The struct holds is_share, author_name, original_author, own_text, sharer_comment, shared_content, link_preview, image_texts
    and image_alts.  A share is what its kind or type says, or what holds a shared text.  The shared text is the given one, the
    text of a share without comment, or the section of a serialised one; a byline in its place gives way to the visible text.
    Names, times and labels are cleaned off; what is quoted from the shared text or the preview is taken out of a person's own
    words; a preview that says nothing new is left out.  A shared text shorter than ``least`` characters isn't shown, a
    comment isn't if ``useful_comment`` says no.
    """
    c = F.col
    text, full, kind = F.coalesce("text", F.lit("")), F.coalesce("full_text", F.lit("")), F.coalesce("content_kind", F.lit(""))
    author, source = c("author_name"), c("source_name")
    raw = filled(full, text)
    stage = posts.select(
        "*", text.alias("_text"), raw.alias("_raw"), (kind == "share_without_comment").alias("_silent"),
        ((F.coalesce("post_type", F.lit("")) == "reshare") | kind.isin(*SHARES) | (F.coalesce("reshare_text", F.lit("")) != "")).alias("_share"),
        F.nullif(filled(c("reshare_author"), C.trimmed(F.regexp_extract(raw, ORIGINAL + r"(.+?)(?:\n|\z)", 1))), F.lit("")).alias("_original"),
        C.trimmed(F.regexp_extract(raw, rf"(?s){COMMENT}\n(.*?)(?=\n{ORIGINAL}|\n{SHARED}|\z)", 1)).alias("_said"),
        filled(c("reshare_text"), F.when(kind == "share_without_comment", text), C.trimmed(F.regexp_extract(raw, rf"(?s){SHARED}\n(.*)\z", 1))).alias("_shown"),
    )
    visible = c("_share") & (c("_said") == "") & (c("_silent") | (c("_original").isNotNull() & C.is_time_chrome(c("_shown")))) & (F.length(C.trimmed(c("_raw"))) > F.length(C.trimmed(c("_shown"))) + 30)
    stage = stage.withColumns({"_whose": F.coalesce("_original", author), "_visible": visible})
    stage = stage.withColumns({
        "_a": C.without_identity(c("_shown"), c("_whose"), source), "_b": F.when(c("_visible"), C.without_identity(c("_raw"), c("_whose"), source)),
        "_plain": C.without_identity(c("_text"), author, source), "_plain_raw": C.without_identity(c("_raw"), author, source),
    })
    stage = stage.withColumns({k: C.without_shared_identity(c(k), c("_whose"), source) for k in ("_a", "_b")})
    stage = stage.withColumns({"_pa": C.image_parts(c("_a")), "_pb": C.image_parts(c("_b"))})
    useful = lambda t, p: C.is_useful_reference(c(t), least) & C.is_useful_reference(c(p)["body"], least)
    stage = stage.withColumns({"_ua": useful("_a", "_pa"), "_ub": c("_b").isNotNull() & useful("_b", "_pb")})
    stage = stage.withColumn("_swap", ~c("_ua") & c("_ub"))
    pick = lambda a, b: F.when(c("_swap"), c(b)).otherwise(c(a))
    stage = stage.withColumns({"_shared": pick("_a", "_b"), "_ps": pick("_pa", "_pb"), "_us": pick("_ua", "_ub")})
    attached = F.coalesce("shared_attachment", F.lit(""))
    own = F.when(c("_share"), F.when(c("_said") != "", c("_said")).when(c("_swap"), "").otherwise(c("_plain"))).otherwise(c("_plain_raw"))
    stage = stage.withColumns({"_preview": F.when((attached == "") | (attached == c("_shared")), "").otherwise(C.sanitized_preview(attached)), "_own": C.trimmed(own)})
    stage = stage.withColumn("_own", C.after_name(c("_own"), F.coalesce(C.trimmed(author), F.lit(""))))
    stage = stage.withColumn("_clean", C.without_reference(c("_own"), c("_shared")))
    stage = stage.withColumn("_clean", C.authored(C.without_reference(c("_clean"), c("_preview")), author, source))
    stage = stage.withColumns({"_po": C.image_parts(c("_clean")), "_pp": C.image_parts(c("_preview"))})
    low = lambda x: F.lower(C.plain(x))
    body, mine = c("_pp")["body"], c("_po")["body"]
    repeats = lambda x: (F.length(C.plain(body)) >= 20) & low(x).startswith(low(body))
    named = (C.plain(body) == C.plain(F.coalesce(author, F.lit("")))) | (C.plain(body) == C.plain(F.coalesce(source, F.lit(""))))
    said_before = ~c("_share") & (F.length(body) >= 20) & F.contains(low(c("_plain")), low(body))
    keep = C.is_useful_preview(body) & ~named & ~C.is_source_name(body) & ~said_before & ~repeats(c("_own")) & ~repeats(c("_clean")) & ~repeats(c("_shared"))
    comment = F.when(c("_silent") | c("_swap") | (c("_said") == NO_COMMENT) | ~c("_share") | ~useful_comment(mine), "").otherwise(mine)
    stage = stage.withColumns({"_keep": keep, "_comment": comment})
    every = lambda name: F.array_distinct(F.concat(c("_po")[name], c("_ps")[name], c("_pp")[name]))
    context: Column = F.struct(
        c("_share").alias("is_share"), author.alias("author_name"), c("_original").alias("original_author"), F.when(c("_share"), c("_comment")).otherwise(mine).alias("own_text"), c("_comment").alias("sharer_comment"),
        F.when(c("_us"), c("_ps")["body"]).otherwise("").alias("shared_content"), F.when(c("_keep"), body).otherwise("").alias("link_preview"), every("image_texts").alias("image_texts"), every("image_alts").alias("image_alts"),
    )
    return stage.select(*posts.columns, context.alias("context"))
