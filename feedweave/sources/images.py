"""Images of a page that are worth a look: candidates from tags and styles, by size, host and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of content images, hosts of the interface's own images, and the least size of a side.
ROLES = ("media", "feed", "feedImage", "uniqueImageInPost", "feedRecentMedia", "feedTagging")
STATIC = r"static\.[^.]+\.fbcdn\.net|rsrc\.php"
LEAST, MOST = 100, 4

INNER = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
BACKGROUND = r"""(?i)background(?:-image)?\s*:[^;]*?url\(\s*(?:&quot;|&#x27;|['"])?(.*?)(?:&quot;|&#x27;|['"])?\s*\)"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, its character references resolved; empty if absent."""
    raw = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    plain = F.regexp_replace(raw, r"""^["']|["']\z""", "")
    for entity, char in (("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b{INNER}>"), F.lit(0))


def largest(srcset: Column) -> Column:
    """The URL of the largest candidate of a ``srcset``; the first on ties, empty without any."""
    parts = F.filter(F.transform(F.split(srcset, r",\s+|,\z"), F.trim), lambda p: p != "")
    sized = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\s([0-9.]+)[wx]\z", 1).try_cast("double"), F.lit(1.0)).alias("size"), (-i).alias("place"), F.regexp_extract(p, r"^\S+", 0).alias("url")))
    return F.coalesce(F.array_max(sized)["url"], F.lit(""))


def candidates(pages: DataFrame) -> DataFrame:
    """``page_id, place, kind, src, role, width, height`` of ``pages(page_id, html)``: images first, then posters of videos, then background images.

    An image is its largest ``srcset`` candidate, or its ``src``; sizes are those that the tag states, 0 if it states none.
    """
    size = lambda t, name: F.coalesce(F.regexp_extract(attribute(t, name), r"^\d+", 0).try_cast("int"), F.lit(0))
    one = lambda kind, t, src, role: F.struct(F.lit(kind).alias("kind"), src.alias("src"), role.alias("role"), size(t, "width").alias("width"), size(t, "height").alias("height"))
    best = lambda t: F.when(largest(attribute(t, "srcset")) != "", largest(attribute(t, "srcset"))).otherwise(attribute(t, "src"))
    images = F.transform(tags(F.col("html"), "img"), lambda t: one("img", t, best(t), attribute(t, "data-imgperflogname")))
    posters = F.transform(tags(F.col("html"), "video"), lambda t: one("video-poster", t, attribute(t, "poster"), F.lit("")))
    styled = F.filter(tags(F.col("html"), "(?:div|span|a)"), lambda t: F.contains(t, F.lit("url(")))
    backgrounds = F.flatten(F.transform(styled, lambda t: F.transform(F.regexp_extract_all(attribute(t, "style"), F.lit(BACKGROUND), F.lit(1)), lambda u: one("background-image", t, F.trim(u), F.lit("")))))
    rows = pages.select("page_id", F.posexplode(F.concat(images, posters, backgrounds)).alias("place", "c"))
    return rows.select("page_id", "place", "c.*")


def unsafe(src: Column) -> Column:
    """Content that can't be looked at as a still image: inline data, animations, video bytes."""
    query = F.regexp_extract(src, r"\?([^#]*)", 1)
    url = src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return src.startswith("data:") | (url & (F.lower(F.regexp_replace(src, r"[?#].*\z", "")).endswith(".gif") | (F.regexp_extract(query, r"(?:^|&)_nc_video=([^&]*)", 1) == "1")))


def chosen(pages: DataFrame, most: int = MOST) -> DataFrame:
    """``page_id, urls, n_filtered``: each page's first ``most`` distinct images of content, and how many unsafe ones came before the last of these."""
    small = (F.col("width") > 0) & (F.col("height") > 0) & ((F.col("width") < LEAST) | (F.col("height") < LEAST))
    fit = candidates(pages).where((F.col("src") != "") & ~F.col("src").rlike(STATIC) & ((F.col("role") == "") | F.col("role").isin(*ROLES)) & ~small)
    first = fit.groupBy("page_id", "src").agg(F.min("place").alias("place")).withColumn("unsafe", unsafe(F.col("src")))
    w = Window.partitionBy("page_id").orderBy("place")
    before = F.coalesce(F.sum((~F.col("unsafe")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("before", before).where(F.col("before") < most)
    urls = F.transform(F.array_sort(F.collect_list(F.when(~F.col("unsafe"), F.struct("place", "src")))), lambda c: c["src"])
    found = kept.groupBy("page_id").agg(urls.alias("urls"), F.count_if("unsafe").cast("int").alias("n_filtered"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"), F.coalesce("n_filtered", F.lit(0)).alias("n_filtered"))
