"""Not-modified captures resolved to the latest earlier full response of the same canonical URL.

An as-of join in DataFrame operations: points (URL, second) are pre-aggregated, so ties can't pile up; running maxima are
taken within fixed slices of time and carried from slice to slice, so neither level's group grows with a hot URL's captures
beyond the seconds of a slice or the slices of the archive's span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweave.llm.common import stored, table

SLICE = 100_000  # seconds; a URL has that many points in a slice at most
# What a 304 response may carry (RFC 9110, 15.4.5), and query parameters that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Scheme and fragment off, host in lower case without www., tracking parameters and a last slash off."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    tracked = "([?&])(?:" + "|".join(TRACKING) + ")=[^&]*"
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, tracked, "$1"), "&+", "&"), "[?]&", "?")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?&]+\\z", ""), "/\\z", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.", "")
    return F.concat(host, F.regexp_replace(bare, "^[^/?]*", ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per row of ``records(record_id long, url string, ts long, status int, headers map<string,string>)``.

    Rows of status 200 are full responses, those of status 304 revisits.  A revisit resolves to the full response of its
    canonical URL with the latest second before its own; of several in that second, the largest record_id.  Validators: where
    both sides have an etag, it must be equal (weak marks aside); else where both have last-modified, that; else none could
    be checked.  Returns ``record_id, canonical_url, outcome, base_id, headers``: outcome is ``response``, ``resolved``,
    ``validator_mismatch``, ``no_validator``, ``no_earlier_response`` or ``other``; headers are a response's own, and of a
    resolved revisit the base's with the permitted ones of the revisit put over them (names in lower case; of names that differ in
    case alone, the first in the order of the names as written stands).  Null url, ts or
    record_id: a revisit finds nothing.  Repeated record_ids of responses count once, the headers of the largest text
    stand; repeated revisits come back each.  An empty table gives an empty result; other columns are ignored.
    """
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(lowered, lambda e, i: F.array_position(F.transform(lowered, lambda x: x["key"]), e["key"]) == i + 1)
    named = F.map_from_entries(first)
    rows = stored(records.select("record_id", canonical_url(F.col("url")).alias("u"), "ts", "status", named.alias("h")))
    points = rows.where("u is not null and ts is not null and record_id is not null and status in (200, 304)").groupBy("u", "ts").agg(F.max(F.when(F.col("status") == 200, F.col("record_id"))).alias("rid"), F.max(F.col("status") == 304).alias("asked"))
    points = stored(points.withColumn("slice", F.floor(F.col("ts") / SLICE)))
    full = F.when(F.col("rid").isNotNull(), F.struct("ts", "rid"))
    before = (Window.unboundedPreceding, -1)
    near = points.withColumn("near", F.max(full).over(Window.partitionBy("u", "slice").orderBy("ts").rowsBetween(*before)))
    carried = points.groupBy("u", "slice").agg(F.max(full).alias("last")).withColumn("carried", F.max("last").over(Window.partitionBy("u").orderBy("slice").rowsBetween(*before)))
    # answers and bases are written, so that Spark can split the partition of a moment or base that many revisits share
    answer = near.where("asked").join(carried, ["u", "slice"]).select("u", "ts", F.coalesce("near", "carried")["rid"].alias("base_id"))

    asked = rows.where("status = 304").join(stored(answer), ["u", "ts"], "left")
    base = rows.where("status = 200 and record_id is not null").groupBy("record_id").agg(F.max(F.struct(F.to_json("h").alias("j"), F.map_entries("h").alias("e"))).alias("b")).select(F.col("record_id").alias("base_id"), F.map_from_entries("b.e").alias("bh"))
    joined = stored(asked).join(stored(base), "base_id", "left")
    h, b = F.col("h"), F.col("bh")
    get = F.try_element_at
    etag = lambda m: F.regexp_replace(get(m, F.lit("etag")), "^W/", "")
    modified = lambda m: get(m, F.lit("last-modified"))
    outcome = (
        F.when(F.col("base_id").isNull(), "no_earlier_response")
        .when(etag(h).isNotNull() & etag(b).isNotNull(), F.when(etag(h) == etag(b), "resolved").otherwise("validator_mismatch"))
        .when(modified(h).isNotNull() & modified(b).isNotNull(), F.when(modified(h) == modified(b), "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    allowed = F.map_filter(h, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(b, lambda k, v: get(allowed, k).isNull()), F.map_filter(allowed, lambda k, v: v.isNotNull()))
    found = joined.withColumn("outcome", outcome).select("record_id", F.col("u").alias("canonical_url"), "outcome", "base_id", F.when(F.col("outcome") == "resolved", merged).alias("headers"))
    rest = rows.where("status is null or status <> 304").select("record_id", F.col("u").alias("canonical_url"), F.when(F.col("status") == 200, "response").otherwise("other").alias("outcome"), F.lit(None).cast("long").alias("base_id"), F.when(F.col("status") == 200, h).alias("headers"))
    return found.union(rest)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures derived from ``pages``, which has no times and headers: see ORACLE for the same in SQL."""
    i = pages["page_id"]
    u = canonical_url(pages["url"])
    revisit = F.pmod(i, F.lit(3)) == 1
    version = F.md5(F.concat(u, F.lit("@"), F.floor(i / 20000).cast("string")))
    headers = F.map_filter(
        F.create_map(
            F.lit("Date"), (F.lit(1700000000) + i * 37).cast("string"),
            F.lit("ETag"), F.when(F.pmod(i, F.lit(5)) != 0, F.when(revisit, F.concat(F.lit("W/"), version)).otherwise(version)),
            F.lit("Last-Modified"), F.when(F.pmod(i, F.lit(7)) != 0, F.floor(i / 20000).cast("string")),
            F.lit("Content-Length"), F.when(revisit, "0").otherwise(F.length(pages["html"]).cast("string")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return pages.select(i.alias("record_id"), pages["url"].alias("url"), (F.lit(1700000000) + i * 37).alias("ts"), F.when(revisit, 304).otherwise(200).alias("status"), headers.alias("headers"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    get = lambda k: F.try_element_at("headers", F.lit(k)).alias(k.replace("-", "_"))
    return found.select("record_id", "canonical_url", "outcome", "base_id", get("date"), get("etag"), get("last-modified"), get("content-length"))


ORACLE = r"""
with c as (
  select page_id as i, html, regexp_replace(regexp_replace(url, '#.*', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages
), q as (
  select i, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b,
    '([?&])(?:utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?]&', '?', 'g'),
    '[?&]+$', ''), '/$', '') as b from c
), r as (
  select i, html, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.', '') || regexp_replace(b, '^[^/?]*', '') as u from q
), v as (
  select i, u, 1700000000 + i * 37 as ts, i % 3 = 1 as revisit, md5(u || '@' || cast(i // 20000 as varchar)) as tag,
    case when i % 7 <> 0 then cast(i // 20000 as varchar) end as modified, cast(length(html) as varchar) as size from r
), j as (
  select v.i, v.u, v.ts, v.tag, v.modified, b.i as base, b.tag as btag, b.modified as bmod, b.size as bsize
  from v asof left join (select * from v where not revisit) b on v.u = b.u and v.ts > b.ts where v.revisit
), o as (
  select *, case when base is null then 'no_earlier_response'
    when i % 5 <> 0 and base % 5 <> 0 then case when tag = btag then 'resolved' else 'validator_mismatch' end
    when modified is not null and bmod is not null then case when modified = bmod then 'resolved' else 'validator_mismatch' end
    else 'no_validator' end as outcome from j
)
select i as record_id, u as canonical_url, outcome, base as base_id,
  case when outcome = 'resolved' then cast(ts as varchar) end as "date",
  case when outcome = 'resolved' then case when i % 5 <> 0 then 'W/' || tag when base % 5 <> 0 then btag end end as etag,
  case when outcome = 'resolved' then coalesce(modified, bmod) end as last_modified,
  case when outcome = 'resolved' then bsize end as content_length
from o
union all
select i, u, 'response', null, cast(ts as varchar), case when i % 5 <> 0 then tag end, modified, size from v where not revisit
"""
