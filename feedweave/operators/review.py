"""Language review: segments, issue summaries, severities and replacements of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import text as T

# Terms and what replaces them.
REPLACEMENTS = (
    ("video", "視頻|视频", "影片"), ("quality", "質量|质量", "品質"), ("software", "軟件|软件", "軟體"), ("info", "信息", "資訊"),
    ("network", "網絡|网络", "網路"), ("link", "鏈接|链接", "連結"), ("user", "用戶|用户", "使用者"), ("account", "账户", "帳號"),
)
SEVERITY = {"info": 1, "warning": 2, "error": 3}


def rank(c: Column) -> Column:
    return F.when(c == "error", 3).when(c == "warning", 2).otherwise(1)


def replaced(c: Column) -> Column:
    for _, pattern, new in REPLACEMENTS:
        c = F.regexp_replace(c, pattern, new)
    return c


def term_findings(c: Column) -> Column:
    """How many outdated terms a text holds."""
    out = F.lit(0)
    for _, pattern, _ in REPLACEMENTS:
        out = out + F.regexp_count(c, F.lit(pattern))
    return out


def segments(posts: DataFrame, cap: int = 2000) -> DataFrame:
    """Scannable segments of posts: shares are a comment and what they share, others one text; equal texts of a kind once."""
    share = F.col("content_kind") != "standard"
    dom, full = F.left(T.squeeze(F.col("dom_text")), F.lit(cap)), F.left(T.squeeze(F.col("full_text")), F.lit(cap))
    listed = F.array(
        F.when(F.col("content_kind") == "reshare_with_comment", F.struct(F.lit(1).alias("ord"), F.lit("comment").alias("kind"), dom.alias("text"))),
        F.when(share, F.struct(F.lit(2).alias("ord"), F.lit("shared_content").alias("kind"), full.alias("text"))),
        F.when(~share, F.struct(F.lit(3).alias("ord"), F.lit("post_text").alias("kind"), full.alias("text"))),
    )
    return posts.select("post_id", F.explode(F.array_compact(listed)).alias("s")).select("post_id", "s.ord", "s.kind", "s.text").where(F.length("text") >= 8)


def rollup(parts: DataFrame) -> DataFrame:
    """Per post: segments, characters, terms found, and a signal that five findings saturate."""
    found = parts.withColumn("found", term_findings(F.col("text")) + F.regexp_count("text", F.lit("[!?]")))
    return found.groupBy("post_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("text")).alias("n_chars"), F.sum("found").alias("n_found"), F.least(F.lit(1.0), F.sum("found") / 5).alias("signal"))


def terms(issues: DataFrame, n: int = 3) -> DataFrame:
    """Per post the n leading terms: by count, then severity, then first seen."""
    groups = issues.groupBy("post_id", "found", "suggestion").agg(F.count("*").alias("n"), F.max(rank(F.col("severity"))).alias("sev"), F.min("seq").alias("first"))
    order = F.struct((-F.col("n")).alias("a"), (-F.col("sev")).alias("b"), F.col("first").alias("c"), "found", "suggestion")
    best = groups.groupBy("post_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, n).alias("t"))  # a post has as many rows as it has terms
    return best.select("post_id", F.posexplode("t").alias("pos", "x")).select("post_id", (F.col("pos") + 1).alias("place"), F.col("x.found").alias("found"), F.col("x.suggestion").alias("suggestion"), (-F.col("x.a")).alias("n"), (-F.col("x.b")).alias("sev"))


def findings(issues: DataFrame) -> DataFrame:
    """Per post and group of rules the issues' number and worst severity; posts with punctuation alone have none."""
    group = F.when(F.col("rule_type") == "punctuation", "punctuation").when(F.col("rule_type").isin("lexical", "cross_strait"), "wording").otherwise("style")
    rows = issues.groupBy("post_id", group.alias("issue_group")).agg(F.count("*").alias("n"), F.max(rank(F.col("severity"))).alias("sev"), F.count_distinct("found").alias("n_terms"))
    other = rows.where("issue_group <> 'punctuation'").select("post_id").distinct()
    return rows.join(other, "post_id", "left_semi")


# Words for pictures, whose exchange for one another isn't worth a hint; the room of a hint, and from how many issues on one shows.
PICTURES = ("圖像", "影像", "圖片", "相片", "照片")
HINT_ROOM, BADGE_FROM, EXAMPLES, FULL_SIGNAL = 16, 2, 3, 5
KINDS = ("post_text", "sharer_comment", "shared_content", "link_preview", "image_text")


def worth_showing(found: Column, suggestions: Column, rule_type: Column, severity: Column, room: int = HINT_ROOM) -> Column:
    """Whether an issue is worth showing: not about punctuation, no mere information, not empty or all signs, within the room, and not one word for pictures for another."""
    bare = F.trim(found)
    generic = bare.isin(*PICTURES) & (F.size(suggestions) > 0) & F.forall(suggestions, lambda x: F.trim(x).isin(*PICTURES))
    return (rule_type != "punctuation") & (severity != "info") & (bare != "") & ~bare.rlike(r"^[\p{P}\p{S}\s]+\z") & (T.units(bare) <= room) & ~F.coalesce(generic, F.lit(False))


def hints(issues: DataFrame) -> DataFrame:
    """``post_id, n, badge``: the issues worth a hint on each post that has any, and whether they are enough for a badge."""
    worthy = issues.where(worth_showing(F.col("found"), F.col("suggestions"), F.col("rule_type"), F.col("severity")))
    return worthy.groupBy("post_id").agg(F.count("*").alias("n"), (F.count("*") >= BADGE_FROM).alias("badge"))


def segment_reviews(issues: DataFrame) -> DataFrame:
    """One review per post and segment from its issues ``(post_id, kind, seq, found, suggestions, rule_type, severity)``: counts, badges, severities, rules, the first examples."""
    worthy = worth_showing(F.col("found"), F.col("suggestions"), F.col("rule_type"), F.col("severity"))
    by_rule = issues.groupBy("post_id", "kind", "rule_type").agg(
        F.count("*").alias("n"), F.count_if(worthy).alias("badges"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY), F.slice(F.array_sort(F.collect_list(F.struct("seq", F.trim("found").alias("found")))), 1, EXAMPLES).alias("first"),
    )
    examples = F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, EXAMPLES), lambda e: e["found"])
    return by_rule.groupBy("post_id", "kind").agg(
        F.sum("n").alias("issue_count"), F.sum("badges").alias("badge_count"), *(F.sum(s).alias(s) for s in SEVERITY), F.map_from_entries(F.collect_list(F.struct("rule_type", "n"))).alias("issue_summary"), examples.alias("examples"),
    )


def aggregated(segments: DataFrame) -> DataFrame:
    """A post's review from those of its segments: counts and badges added, rules added by name, examples in the segments' order, and a signal that five badges fill."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    merged = F.aggregate(F.collect_list("issue_summary"), F.expr("cast(map() as map<string,bigint>)"), lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
    examples = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "examples"))), lambda e: e["examples"]))
    return segments.groupBy("post_id").agg(
        F.sum("issue_count").alias("issue_count"), F.sum("badge_count").alias("badge_count"), *(F.sum(s).alias(s) for s in SEVERITY), merged.alias("issue_summary"), examples.alias("examples"), F.least(F.lit(1.0), F.sum("badge_count") / FULL_SIGNAL).alias("signal"),
    )
