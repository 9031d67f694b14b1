"""Queries of what happens around the panel: surfaces, retries, searches, queues, logs, timeouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.functions import flow as W
from feedweave.operators import flow
from feedweave.plans.catalog import _table, query
from feedweave.plans.views import view

WORDS = {"source": "Source", "link": "Link", "summary": "Summary", "officialInfo": "official information", "question": "Question", "publicSources": "Prioritize publicly verifiable sources.", "separator": ": "}


@query("""select event_id, case when not filtered and fold_reason <> '' and mode = 'collapse' and not expanded then 'fold' when not filtered then 'panel' when width > 800 or height > 1800 then 'oversized' when mode = 'none' and not forced then 'nothing' else 'overlay' end as surface,
  reel_tray and (bars >= 2 or posts >= 1) or bars >= 2 and posts >= 1 or posts >= 2 or nested and (height > 900 or composer) or wrapper and bars >= 1 or height > 3000 and (reel_tray or bars >= 2 or posts >= 1) as mixed from boxes_v""", "boxes_v")
def surfaces(spark, sf_dir):
    """What is done over each post, and whether its container holds several posts."""
    rows = view(spark, sf_dir, "boxes_v")
    box = F.struct("height", "reel_tray", F.col("posts").alias("child_posts"), F.col("bars").alias("action_bars"), F.col("nested").alias("nested_feed"), "composer", F.col("wrapper").alias("wrapper_author"))
    return rows.select("event_id", W.surface(F.struct(*rows.columns)).alias("surface"), W.is_mixed(box).alias("mixed"))


@query("""select doc_id, case when ads and free and place = 'rail' and not regexp_matches(t, '(?i)壽星|生日|Birthdays?') and regexp_matches(t, '(?i)贊助|赞助|Sponsored') and doc_id % 7 > 0 and (width <= 0 or width between 160 and 520) and (height <= 0 or height between 60 and 800) then 'right-rail-ad'
  when reels and free and place = 'feed' and links >= 3 and regexp_matches(t, '(?i)Reels?|短片') and (width <= 0 or width >= 320) and (height <= 0 or height between 120 and 1200) then 'reel-section' end as kind from (select *, left(text, 700) as t from parts_v)""", "parts_v")
def collapsible_parts(spark, sf_dir):
    """Parts of a page that the settings fold away: ads beside the feed and rows of short videos in it."""
    rows = view(spark, sf_dir, "parts_v")
    yes, no = F.lit(True), F.lit(False)
    part = F.struct("text", "place", (~F.col("free")).alias("collapsed"), no.alias("expanded"), no.alias("in_article"), yes.alias("visible"), (F.col("doc_id") % 7 > 0).alias("has_content"), F.col("links").alias("reel_links"), "width", "height")
    return rows.select("doc_id", W.surface_kind(part, F.col("ads"), F.col("reels")).alias("kind"))


@query("""select event_id, ok1 or again and ok2 as ok, case when ok1 then case when images > 0 then 'ok' when dropped > 0 then 'filtered' else 'no_images' end when again and ok2 then coalesce(why, 'decode_failed') end as image_status,
    case when not (ok1 or again and ok2) then coalesce(case when again then error2 end, error1, 'failed') end as error, 1 + again::int as calls from (
  select *, not ok1 and retry and images > 0 as again from (select event_id, event_id % 3 = 0 as ok1, event_id % 4 < 2 as retry, event_id % 5 as images, event_id % 2 as dropped, event_id % 7 < 4 as ok2, case when event_id % 11 = 0 then 'too large' end as why, case when event_id % 6 > 1 then 'http' end as error1, case when event_id % 8 = 2 then 'timeout' end as error2 from events))""")
def call_outcomes(spark, sf_dir):
    """What deep calls end with when a failure over images is tried once more without them."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    first = F.struct((i % 3 == 0).alias("ok"), F.when(i % 6 > 1, "http").otherwise(none).alias("error"), (i % 4 < 2).alias("retry_text_only"), F.when(i % 11 == 0, "too large").alias("retry_status"))
    second = F.struct((i % 7 < 4).alias("ok"), F.when(i % 8 == 2, "timeout").alias("error"))
    return _table(spark, sf_dir, "events").select("event_id", W.outcome(first, second, i % 5, i % 2).alias("o")).select("event_id", "o.*")


BARE = "trim(regexp_replace(regexp_replace(regexp_replace(q, '這篇(貼文|文章|內容)?', '', 'g'), '^貼文(中|裡|內)?(的)?', ''), '\\s+', ' ', 'g'))"


@query(f"""select doc_id, bare, case when regexp_matches(clean, '(?i)https?://|(^|\\s)(curl|wget|npm|pnpm|brew|git)\\s') then context || ' official information' else context || ' Question: ' || clean || ' Prioritize publicly verifiable sources.' end as query from (
  select doc_id, {BARE} as bare, left({BARE}, 120) as clean, 'Source: Some title' || case when doc_id % 3 = 0 then ' Link: https://example.org/a' else '' end || ' Summary: Summed up ' || doc_id as context from (
    select doc_id, case doc_id % 4 when 0 then '這篇貼文 says that ' || doc_id || ' is so' when 1 then '貼文中的 claim ' || doc_id when 2 then 'run git  clone ' || doc_id else 'plain  question ' || doc_id end as q from documents))""")
def search_queries(spark, sf_dir):
    """What is searched for a question about a post."""
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 4
    q = F.when(k == 0, F.concat(F.lit("這篇貼文 says that "), i, F.lit(" is so"))).when(k == 1, F.concat(F.lit("貼文中的 claim "), i)).when(k == 2, F.concat(F.lit("run git  clone "), i)).otherwise(F.concat(F.lit("plain  question "), i))
    link = W.first_outside_link(F.when(F.col("doc_id") % 3 == 0, "see https://www.facebook.com/x and https://example.org/a?fbclid=1 too").otherwise("https://scontent.fbcdn.net/y only"))
    query = W.search_query(q, F.lit("Some title。"), link, F.concat(F.lit("Summed up "), i), WORDS)
    return _table(spark, sf_dir, "documents").select("doc_id", W.without_pointing(q).alias("bare"), query.alias("query"))


@query("""select event_id, array_to_string(list_filter([case when share then case when event_id % 5 > 0 then 'sharerComment' else 'noSharerComment' end else 'postText' end, case when share and (event_id % 3 > 0 or event_id % 7 > 0 and media and event_id % 11 > 0) then 'sharedPost' end,
  case when media then case when event_id % 13 = 0 then 'video' else 'media' end end, case when event_id % 3 > 0 then 'externalLinks:' || event_id % 3 end], lambda x: x is not null), ',') as materials from (select event_id, event_id % 2 = 0 as share, event_id % 4 > 0 as media from events)""")
def material_labels(spark, sf_dir):
    """What the reading of a post rests on."""
    i = F.col("event_id")
    word = lambda on: F.when(on, "x").otherwise("")
    p = F.struct((i % 2 == 0).alias("is_share"), word(i % 5 > 0).alias("sharer_comment"), word(i % 3 > 0).alias("shared_content"), word(i % 7 > 0).alias("original_author"), word(i % 11 == 0).alias("link_preview"), (i % 4 > 0).alias("has_media"), F.when(i % 13 == 0, "reel").alias("post_type"), (i % 3).alias("links"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(W.materials(p), ",").alias("materials"))


@query("""select doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(case doc_id % 3 when 0 then text || ' ' when 1 then text else text end, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' '), '……', ' ', 'g'), '\\s+', ' ', 'g')) as line from documents""")
def preview_lines(spark, sf_dir):
    """Previews of posts without labels of the interface and guessed descriptions of pictures."""
    k = F.col("doc_id") % 3
    dressed = F.when(k == 0, F.concat("text", F.lit("……查看更多"))).when(k == 1, F.concat("text", F.lit("\n可能是一隻貓的圖像"))).otherwise(F.concat(F.lit("可能是顯示的文字是「HELLO」的圖像\n"), "text", F.lit(" See more")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(W.preview_line(dressed), "……", " ").alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))


@query("""select post_id, seq, coalesce(p_text, text) as text, coalesce(p_full, full_text) as full_text, case when p_context is not null then p_context when coalesce(coalesce(p_full, p_text) <> coalesce(full_text, text), coalesce(p_full, p_text) is not null) then null else context end as context from (
  select e.*, p.text as p_text, p.full_text as p_full, p.context as p_context from (select user_id as post_id, event_id as seq, event_type as text, case when event_id % 3 = 0 then event_type || ' in full' end as full_text, 'context ' || event_id as context, row_number() over (partition by user_id order by event_id desc) as r from events) e
  left join (select distinct user_id as post_id, case user_id % 4 when 0 then 'click' when 1 then 'new' end as text, case when user_id % 5 = 0 then 'whole' end as full_text, case when user_id % 3 = 0 then 'fresh' end as context from events where user_id % 6 > 0) p on p.post_id = e.post_id and e.r = 1)""")
def patched_latest(spark, sf_dir):
    """Events with the newest of each post patched; a changed text drops the context that belonged to the one before."""
    e, u, none = _table(spark, sf_dir, "events"), F.col("user_id"), F.lit(None).cast("string")
    rows = e.select(u.alias("post_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit(" in full"))).otherwise(none).alias("full_text"), F.concat(F.lit("context "), "event_id").alias("context"))
    patches = e.where("user_id % 6 > 0").select(u.alias("post_id"), F.when(u % 4 == 0, "click").when(u % 4 == 1, "new").alias("text"), F.when(u % 5 == 0, "whole").alias("full_text"), F.when(u % 3 == 0, "fresh").alias("context")).distinct()
    return flow.patched_latest(rows, patches)


@query("""select tab, q.post_id as queued, a.post_id as ahead from (select distinct tab from queue_v) left join (select tab, arg_min(post_id, (case when bottom > 0 and top < view then 0 else 1 end, case when bottom > 0 and top < view then abs((top + bottom) / 2e0 - view / 2e0) else 0 end, place)) as post_id from queue_v where attached and not mixed group by 1) q using (tab)
  left join (select tab, arg_min(post_id, (top - view, place)) as post_id from queue_v where attached and not mixed and not done and not waiting and top > view and top - view <= 2 * view group by 1) a using (tab)""", "queue_v")
def next_posts(spark, sf_dir):
    """The post of each tab's queue to analyse next, and the one below the view to fetch ahead."""
    q = view(spark, sf_dir, "queue_v")
    ahead = flow.next_ahead(q).withColumnRenamed("post_id", "ahead")
    return q.select("tab").distinct().join(flow.next_in_queue(q).withColumnRenamed("post_id", "queued"), "tab", "left").join(ahead, "tab", "left")


@query("""select component, seq, level, line from (select event_type as component, event_id as seq, case event_id % 3 when 0 then 'warn' else 'log' end as level, props as line, row_number() over (partition by event_type order by event_id desc) as r from events) where r <= 500""")
def log_tails(spark, sf_dir):
    """The last 500 lines of each component's log."""
    e = _table(spark, sf_dir, "events")
    return flow.log_tail(e.select(F.col("event_type").alias("component"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "warn").otherwise("log").alias("level"), F.col("props").alias("line")))


@query("""select user_id % 31 as tab, count(*) filter (event_id % 4 < 2) as articles, count(*) filter (event_id % 5 > 0) as tagged, count(*) filter (event_id % 3 = 0 and event_id % 4 < 2) as folded_posts, count(*) filter (event_id % 3 = 0 and event_id % 4 = 2) as folded_ads, count(*) filter (event_id % 3 = 0 and event_id % 4 = 3) as folded_reels from events group by 1""")
def tab_statistics(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 4 < 2, "article").when(i % 4 == 2, "rail-ad").otherwise("reels")
    return flow.tab_statistics(_table(spark, sf_dir, "events").select((F.col("user_id") % 31).alias("tab"), kind.alias("kind"), (i % 5 > 0).alias("tagged"), (i % 3 == 0).alias("folded")))


@query("""select event_id as call_id, case when took >= 0 and took < patience then 'answered' else 'timeout' end as state, case when took >= 0 and took < patience then took else patience end as waited from (
  select event_id, case event_id % 3 when 0 then 30 when 1 then 45 else 20 end::double as patience, case when event_id % 7 > 0 then least(event_id % 61, 5 + event_id % 55)::double end as took from events)""")
def calls_in_time(spark, sf_dir):
    """Calls answered within their stage's patience, and those given up."""
    e, i = _table(spark, sf_dir, "events"), F.col("event_id")
    calls = e.select(i.alias("call_id"), F.when(i % 3 == 0, "fast").when(i % 3 == 1, "deep").otherwise("device").alias("stage"), F.col("ts").cast("timestamp").alias("sent"))
    after = lambda s: F.timestamp_add("SECOND", s.cast("int"), F.col("ts").cast("timestamp"))
    replies = e.where("event_id % 7 > 0").select(i.alias("call_id"), F.explode(F.array(after(i % 61), after(5 + i % 55))).alias("came"))
    return flow.answered_in_time(calls, replies, {"fast": 30, "deep": 45, "device": 20})


@query("""with c as (select key from (select key, max(seq) as seq from (select user_id || ':' || case when event_id % 2 = 0 then 'en' else 'zh' end || ':' || event_id % 5 as key, event_id as seq from events where event_id % 3 = 1) group by 1 order by 2 desc limit 500)),
  r as (select user_id || ':en:' || event_id % 5 as key from events where event_id % 29 = 0)
  select key, min(event_id) as seq from (select *, user_id || ':' || case when event_id % 4 < 2 then 'en' else 'zh' end || ':' || event_id % 5 as key from events) where event_id % 2 = 0 and event_id % 7 > 0 and event_id % 11 > 0 and event_id % 13 > 0 and event_id % 3 < 2 and user_id % 5 > 0
    and key not in (select key from c) and key not in (select key from r) group by 1""".replace("with c as", "select * from (with c as", 1) + ")")
def briefs_ahead(spark, sf_dir):
    """The briefs worth fetching ahead that are neither known nor on their way."""
    e, i = _table(spark, sf_dir, "events"), F.col("event_id")
    key = lambda lang: F.concat_ws(":", "user_id", lang, i % 5).alias("key")
    events = e.select(i.alias("seq"), F.col("user_id").alias("post_id"), F.when(i % 4 < 2, "en").otherwise("zh").alias("lang"), (i % 5).alias("text_hash"), (i % 2 == 0).alias("analysed"), (i % 7 == 0).alias("brief"), (i % 11 == 0).alias("pending"), (i % 13 == 0).alias("failed"), (i % 3 < 2).alias("visible"), (F.col("user_id") % 5 > 0).alias("allowed"))
    completed = e.where("event_id % 3 = 1").select(key(F.when(i % 2 == 0, "en").otherwise("zh")), i.alias("seq"))
    return flow.worth_fetching(events, completed, e.where("event_id % 29 = 0").select(key(F.lit("en"))))
