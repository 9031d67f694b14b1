"""Queries of what a panel shows over time: examples, counts, rows, dates, recycled containers, statuses and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedweave.functions import rules as R
from feedweave.functions import text as T
from feedweave.plans.catalog import _table, query, squeezed
from feedweave.plans.rule_queries import CATALOG
from feedweave.plans.views import view

KIND_ORDER = "case kind when 'post_text' then 1 when 'shared_content' then 2 when 'link_preview' then 3 else 4 end"


@query(f"select post_id, place, found from (select post_id, found, (row_number() over (partition by post_id order by {KIND_ORDER}, seq))::int as place from issues_v) where place <= 3", "issues_v")
def example_limits(spark, sf_dir):
    """The first three examples of a post across its segments, in their order."""
    w = Window.partitionBy("post_id").orderBy(F.expr(KIND_ORDER), "seq")
    return view(spark, sf_dir, "issues_v").select("post_id", F.row_number().over(w).alias("place"), "found").where("place <= 3")


@query("select post_id, count(*) as n, count(*) >= 2 as badge from issues_v where rule_type <> 'punctuation' and severity <> 'info' group by 1", "issues_v")
def issue_hints(spark, sf_dir):
    worthy = view(spark, sf_dir, "issues_v").where("rule_type <> 'punctuation' and severity <> 'info'")
    return worthy.groupBy("post_id").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("badge"))


@query("select * from (values ('n.click', 'zh'), ('n.purchase', 'en')) t(key, missing_in)")
def catalog_parity(spark, sf_dir):
    """Keys that one language's catalog has and another's lacks."""
    words = spark.createDataFrame(CATALOG, "lang string, key string, value string").select("lang", "key")
    every = words.select("key").distinct().crossJoin(words.select("lang").distinct())  # both are catalogs of fixed length
    return every.join(words, ["lang", "key"], "left_anti").select("key", F.col("lang").alias("missing_in"))


@query("""select event_id, case when length(event_type) >= 8 then event_type else concat(event_type, '|long enough row about ', event_type) end as rows from events""")
def fuzzy_rows(spark, sf_dir):
    """Rows of which none says what an earlier one does: equal, or one within the other from eight characters on, white space and case aside."""
    kind = F.col("event_type")
    rows = F.array(F.concat(F.lit(" "), kind), F.upper(kind), F.lit(" "), F.concat(F.lit("long enough row about "), kind), F.concat(F.lit("A long  enough row about "), kind, F.lit(" indeed")))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(R.new_rows(rows), "|").alias("rows"))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') as local_time, year(ts + interval 8 hour)::int as year from events")
def local_dates(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Taipei")
    return _table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local_time"), F.year(local).alias("year"))


@query("""select seq, not (pa is not null and author_name = pa and (t = '' or pt = '' or starts_with(t, pt) or starts_with(pt, t))) as reset from (select seq, author_name, t, lag(author_name) over w as pa, lag(t) over w as pt
  from (select *, case when seq % 3 = 0 then left(s, 10) when seq % 3 = 1 then s else '' end as t from (select seq, seq % 4 as place, concat('Author ', cast(floor(seq / 40) as bigint)) as author_name, left(""" + squeezed("text") + """, 80) as s from gql_v)) window w as (partition by place order by seq))""", "gql_v")
def container_recycling(spark, sf_dir):
    """Whether a container now holds another post: another author, or texts of which neither begins with the other."""
    seen = F.left(T.squeeze(F.col("text")), F.lit(80))
    rows = view(spark, sf_dir, "gql_v").select("seq", (F.col("seq") % 4).alias("place"), F.concat(F.lit("Author "), F.floor(F.col("seq") / 40).cast("string")).alias("author"), F.when(F.col("seq") % 3 == 0, F.left(seen, F.lit(10))).when(F.col("seq") % 3 == 1, seen).otherwise("").alias("t"))
    w = Window.partitionBy("place").orderBy("seq")
    author, t, pa, pt = F.col("author"), F.col("t"), F.lag("author").over(w), F.lag("t").over(w)
    return rows.select("seq", (~F.coalesce((author == pa) & ((t == "") | (pt == "") | t.startswith(pt) | pt.startswith(t)), F.lit(False))).alias("reset"))


# Milliseconds from which a stage counts as slow, and after which it is given up.
LIMITS = {"fast": (5_000, 30_000), "deep": (10_000, 45_000), "brief": (12_000, 45_000)}


@query("""select event_id, stage, case when ms > case stage when 'fast' then 30000 else 45000 end then 'timeout' when ms > case stage when 'fast' then 5000 when 'deep' then 10000 else 12000 end then 'slow_but_usable' else 'usable' end as status
  from (select event_id, case event_id % 3 when 0 then 'fast' when 1 then 'deep' else 'brief' end as stage, value * (event_id % 200) as ms from events)""")
def stage_status(spark, sf_dir):
    k = F.col("event_id") % 3
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "fast").when(k == 1, "deep").otherwise("brief").alias("stage"), (F.col("value") * (F.col("event_id") % 200)).alias("ms"))
    limit = lambda i: F.create_map(*(x for name, ms in LIMITS.items() for x in (F.lit(name), F.lit(ms[i]))))[F.col("stage")]
    return rows.select("event_id", "stage", F.when(F.col("ms") > limit(1), "timeout").when(F.col("ms") > limit(0), "slow_but_usable").otherwise("usable").alias("status"))


@query("""select post_id, left(dom_text, 200) as text, left(full_text, 2000) as full_text, content_kind, case when regexp_matches(dom_text, '(See more|查看更多|顯示更多)') then 'likely_truncated' else 'visible_complete' end as completeness, is_recommended from posts_v""", "posts_v")
def event_projection(spark, sf_dir):
    """What is told about a post: its text and whole text as far as they are shown, its kind and completeness."""
    complete = F.when(F.col("dom_text").rlike("See more|查看更多|顯示更多"), "likely_truncated").otherwise("visible_complete")
    return view(spark, sf_dir, "posts_v").select("post_id", F.left("dom_text", F.lit(200)).alias("text"), F.left("full_text", F.lit(2000)).alias("full_text"), "content_kind", complete.alias("completeness"), "is_recommended")
