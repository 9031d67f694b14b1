"""Sponsored posts in the raw HTML of pages: fields and markers by position, and the nearest fields of each marker."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.functions import rules as R
from feedweave.functions import text as T
from feedweave.operators import enrich
from feedweave.operators.cache import AnswerCache

# What marks a sponsored post in a page's scripts and the fields around it; the first group is the value.
UNIT = r'(?:[^"\\]|\\[^\n\r\u2028\u2029])'
PATTERNS = {
    "marker": r'"th_dat_spo":\{[^{}]{0,500}\}',
    "message": r'"message":\{"text":"(' + UNIT + r'{10,8000})"',
    "actor": r'"actors":\[\{[^\]]*?"name":"(' + UNIT + r'{1,200})"',
    "post_id": r'"post_id":"([0-9]+)"',
}
FIELDS = ("message", "actor", "post_id")
ROWS = 50_000  # of a batch that is given out


def positions(html: str, patterns: dict[str, re.Pattern]) -> list[tuple[str, int, str]]:
    """``kind, pos, value`` of every match, positions counted in UTF-16 units as the pages' own scripts count."""
    wide = [] if html.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", html)]
    return [(kind, m.start() + bisect_left(wide, m.start()), m[m.re.groups]) for kind, p in patterns.items() for m in p.finditer(html)]


def scan(pages: DataFrame) -> DataFrame:
    """``page_id, kind, pos, value`` of all markers and fields in ``pages(page_id, html)``; values as they stand, still escaped.

    SQL has no function that gives the positions of all matches, so pages pass through Python in Arrow batches; what goes on are matches only.
    """

    def run(batches):
        compiled = {k: re.compile(p) for k, p in PATTERNS.items()}
        found: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["page_id", "kind", "pos", "value"])
        for batch in batches:
            for page, html in zip(batch["page_id"].to_pylist(), batch["html"]):
                found += [(page, *row) for row in positions(html.as_py() or "", compiled)]
                if len(found) >= ROWS:
                    yield batch_of()
                    found = []
        if found:
            yield batch_of()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, kind string, pos long, value string")


def sponsored_posts(pages: DataFrame) -> DataFrame:
    """``page_id, place, post_id, text, author_name`` for each marker that has a text of over ten units or an author of over one.

    Each field is the nearest of its kind on the page, the earlier on ties; without any post id on the page the id is ``ssr-`` and the marker's place.
    """
    near = enrich.nearest_each(scan(pages).withColumnRenamed("page_id", "doc_id"), FIELDS)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    text, author = (F.coalesce(R.unescaped(F.col(c)), F.lit("")) for c in ("message", "actor"))
    rows = near.select(F.col("doc_id").alias("page_id"), place.alias("place"), "post_id", text.alias("text"), author.alias("author_name"))
    return rows.withColumn("post_id", F.coalesce("post_id", F.concat(F.lit("ssr-"), "place"))).where((T.units(F.col("text")) > 10) | (T.units(F.col("author_name")) > 1))


# What a cached scan may hold.
MAX_POSTS, MAX_UNITS, MAX_URL, MAX_TEXT, MAX_FIELD = 30, 120_000, 2048, 5000, 240
TTL = 5 * 60
POSTS = "array<struct<post_id:string,text:string,author_name:string>>"


def cacheable(url: Column, posts: Column) -> Column:
    """Whether a page's posts may be kept: the page is the network's own, there are posts, and every one has all its fields within bounds."""
    fits = lambda c, most: F.coalesce((F.trim(c) != "") & (T.units(F.trim(c)) <= most), F.lit(False))
    sound = F.forall(posts, lambda p: fits(p["post_id"], MAX_FIELD) & fits(p["text"], MAX_TEXT) & fits(p["author_name"], MAX_FIELD))
    host = T.host(url)
    own = url.rlike("(?i)^https?://") & ((host == "facebook.com") | host.endswith(".facebook.com")) & (T.units(url) <= MAX_URL)
    return own & (F.size(posts) > 0) & (F.size(posts) <= MAX_POSTS) & sound & (T.units(F.to_json(posts)) <= MAX_UNITS)


def cached_scans(spark: SparkSession, folder: str, ttl: int = TTL) -> AnswerCache:
    """The cache of pages' sponsored posts by URL."""
    return AnswerCache(spark, folder, POSTS, ttl, cacheable)


def posts_by_key(pages: DataFrame) -> DataFrame:
    """``key, answer`` of ``pages(key, page_id, html)``: each page's sponsored posts in their order."""
    found = sponsored_posts(pages.select("page_id", "html")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "post_id", "text", "author_name"))).alias("p"))
    answer = F.transform(F.coalesce("p", F.array().cast("array<struct<place:int,post_id:string,text:string,author_name:string>>")), lambda p: F.struct(p["post_id"].alias("post_id"), p["text"].alias("text"), p["author_name"].alias("author_name")))
    return pages.select("key", "page_id").join(found, "page_id", "left").select("key", answer.alias("answer"))
