"""Queries of single rules: cleaned lines, hashes, JSON helpers, labels, lookups, merges and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.functions import rules as R
from feedweave.functions import scores as S
from feedweave.functions import text as T
from feedweave.operators import history, review
from feedweave.plans.catalog import _table, query, squeezed
from feedweave.plans.context_queries import trim
from feedweave.plans.views import view

# Lines -----------------------------------------------------------------------------------------------------------------------

DROPPED = " or ".join(f"regexp_matches(x, '{p}')" for p in R.DROPPED_LINES)
BARE = f"regexp_replace(regexp_replace(text, '{R.COMMENT_BOUNDARY}', '', 'g'), '{'|'.join(R.INLINE_NOISE)}', ' ', 'g')"


@query(f"""select post_id, {trim("regexp_replace(array_to_string(case when last is null then [] else l[1:last] end, chr(10)), '[ \\t]{2,}', ' ', 'g')")} as text from (
  select post_id, l, list_max(list_filter(range(1, len(l) + 1), lambda i: not regexp_matches(l[i], '^[0-9,]+\\z'))) as last from (
  select post_id, list_filter(list_transform(string_split({BARE}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '' and not (length(x) = 1 or {DROPPED}
  or (regexp_matches(x, '(?i)facebook') and length(x) > 20) or (regexp_matches(x, '(?i)^[a-z]{{2}}\\z') and not regexp_matches(x, '{R.TWO_LETTERS}')))) as l from noisy_v))""", "noisy_v")
def line_cleaner(spark, sf_dir):
    return view(spark, sf_dir, "noisy_v").select("post_id", R.cleaned_lines(F.col("text")).alias("text"))


UNFOLDED = squeezed("regexp_replace(dom_text, '(?m)(See more|查看更多|顯示更多)[ \\t]*$', '', 'g')")


@query(f"select post_id, {UNFOLDED} as text from posts_v", "posts_v")
def dispatch_texts(spark, sf_dir):
    return view(spark, sf_dir, "posts_v").select("post_id", T.dispatch_text(F.col("dom_text")).alias("text"))


SPACED = "S s o p r n e o t d g"


@query("select post_id, post_id % 3 = 0 and length(concat(author_name, ' ', header)) < 100 as ad from posts_v", "posts_v")
def spaced_ad_header(spark, sf_dir):
    label = F.when(F.col("post_id") % 3 == 0, SPACED).when(F.col("post_id") % 3 == 1, SPACED.replace(" ", "")).otherwise("S s o p")
    return view(spark, sf_dir, "posts_v").select("post_id", T.is_spaced_ad(F.concat_ws(" ", "author_name", label, F.lit("·"), "header")).alias("ad"))


@query("""select post_id, case when length(n) between 2 and 80 and not regexp_matches(n, '(?i)^(贊助|赞助|Sponsored|廣告|广告|Ad Choices|右欄廣告|了解更多|Learn More|展開|隱私政策|服務條款|Cookie|More|更多)\\z')
  and not regexp_matches(n, '(?i)^[a-z0-9-]+(?:[.][a-z0-9-]+)+\\z') then n end as name from (select post_id, case post_id % 5 when 0 then concat('Shop ', post_id) when 1 then concat('Shop ', post_id) when 2 then 'Learn More' when 3 then '' else 'x' end as n from posts_v)""", "posts_v")
def ad_names(spark, sf_dir):
    k, shop = F.col("post_id") % 5, F.concat(F.lit("Shop "), F.col("post_id").cast("string"))
    raw = F.when(k == 0, F.concat(F.lit("Sponsored · "), shop, F.lit(" www.shop.example.com/a"))).when(k == 1, F.concat(shop, F.lit("  shop.example.org"))).when(k == 2, "贊助 Learn More").when(k == 3, "www.only-a.example.com").otherwise("x")
    return view(spark, sf_dir, "posts_v").select("post_id", R.ad_name(raw).alias("name"))


# Hashes and truncation -------------------------------------------------------------------------------------------------------


@query("""select event_id, length(t) as n, list_reduce(list_prepend(2166136261::hugeint, cs), lambda h, x: (xor(h, x) * 16777619) % 4294967296)::bigint as h1, list_reduce(list_prepend(2654435769::hugeint, cs), lambda h, x: (xor(h, x) * 2246822507) % 4294967296)::bigint as h2
  from (select event_id, t, list_transform(string_split(t, ''), lambda x: unicode(x)::hugeint) as cs from (select event_id, concat(event_type, ' ', event_id, ' ', props) as t from events))""")
def dual_hash_keys(spark, sf_dir):
    t = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), "props")
    return _table(spark, sf_dir, "events").select("event_id", F.length(t).cast("long").alias("n"), R.fnv(t, 0x811C9DC5, 0x01000193).alias("h1"), R.fnv(t, 0x9E3779B9, 0x85EBCA6B).alias("h2"))


@query("select doc_id, case when length(text) > 120 then concat(left(text, 120), '…') else text end as short, case when length(text) > 0 and n_chars % 100 / 100e0 >= 0.6 then 'high' when n_chars % 100 / 100e0 >= 0.3 then 'mid' else 'low' end as band from documents where text <> ''")
def truncation_and_band(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.truncated(F.col("text"), 120).alias("short"), S.band(F.col("n_chars") % 100 / 100).alias("band"))


# JSON ------------------------------------------------------------------------------------------------------------------------


@query("""select event_id, case when strpos(r, '{') > 0 then (select substr(s, 1, list_min(list_filter(range(1, length(s) + 1), lambda i: length(replace(left(s, i), '{', '')) = length(replace(left(s, i), '}', ''))))) from (select substr(r, strpos(r, '{')) as s)) end as object
  from (select event_id, case when event_id % 4 = 0 then concat('x ', raw, ' {"again":{}}') when event_id % 4 = 1 then concat('{"a":', raw, '} tail }') else raw end as r from llm_v)""", "llm_v")
def first_balanced_object(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("x "), "raw", F.lit(' {"again":{}}'))).when(k == 1, F.concat(F.lit('{"a":'), "raw", F.lit("} tail }"))).otherwise(F.col("raw"))
    return view(spark, sf_dir, "llm_v").select("event_id", R.balanced_object(raw).alias("object"))


@query(r"""select conv_id, turn, case turn % 3 when 0 then concat('a"b', chr(10), 'é ', conv_id) when 1 then concat('bad \x ', conv_id) else concat('plain ', conv_id) end as text from conversations""")
def json_unescaped(spark, sf_dir):
    k = F.col("turn") % 3
    raw = F.concat(F.when(k == 0, r"a\"b\né ").when(k == 1, r"bad \x ").otherwise("plain "), F.col("conv_id").cast("string"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", R.unescaped(raw).alias("text"))


@query("""select event_id, concat('{"a":"', event_type, '","k":"', event_id % 7, '","z":"', user_id, '"}') as canonical, event_id % 2 = 0 as fresh from events""")
def canonical_fingerprints(spark, sf_dir):
    """Settings as JSON with sorted keys; a record is fresh if its fingerprint is the current one."""
    pairs = lambda *names: F.create_map(*(x for n, v in names for x in (F.lit(n), v.cast("string"))))
    kind, k, user = F.col("event_type"), F.col("event_id") % 7, F.col("user_id")
    now = R.canonical(pairs(("z", user), ("k", k), ("a", kind)))
    then = R.canonical(pairs(("k", F.when(F.col("event_id") % 2 == 0, k).otherwise(k + 1)), ("a", kind), ("z", user)))
    return _table(spark, sf_dir, "events").select("event_id", now.alias("canonical"), (now == then).alias("fresh"))


@query("""select event_id, case k when 0 then 'reshare' when 1 then 'reel' when 2 then 'group' when 3 then 'text_only' when 4 then 'page' else 'standard' end as post_type from (select event_id, event_id % 6 as k from events)""")
def post_types(spark, sf_dir):
    k = F.col("event_id") % 6
    node = (
        F.when(k == 0, '{"attached_story":{},"target_group":{}}').when(k == 1, '{"url":"https://h/reel/5","target_group":{}}').when(k == 2, '{"target_group":{"id":1},"is_text_only_story":true}')
        .when(k == 3, '{"is_text_only_story":true}').when(k == 4, '{"actors":[]}').otherwise('{"actors":[{"name":"a"}],"attached_story":null,"is_text_only_story":"true"}')
    )
    return _table(spark, sf_dir, "events").select("event_id", R.post_type(F.try_parse_json(node)).alias("post_type"))


@query("""select event_id, event_type as found, case event_id % 3 when 0 then 'error' when 1 then 'info' else 'warning' end as severity, case when event_id % 4 = 0 then 'unknown' else 'lexical' end as rule_type,
  greatest(0, (event_id % 50) - 5)::bigint as at, case when event_id % 2 = 0 then 'a|b|c' else '' end as suggestions from events where event_id % 5 > 0""")
def checker_issues(spark, sf_dir):
    i = F.col("event_id")
    raw = F.to_json(F.struct(
        F.when(i % 5 > 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise("  ").alias("found"), F.when(i % 3 == 0, "error").when(i % 3 == 1, "loud").otherwise("warning").alias("severity"),
        F.when(i % 4 > 0, "lexical").alias("rule_type"), ((i % 50) - 5 + 0.5).alias("offset"), F.when(i % 2 == 0, F.array(*map(F.lit, ("a", " ", "b ", "c", "d")))).alias("suggestions"),
    ))
    found = _table(spark, sf_dir, "events").select("event_id", R.issue(F.try_parse_json(raw)).alias("i")).where("i is not null")
    return found.select("event_id", "i.found", "i.severity", "i.rule_type", F.col("i.at").alias("at"), F.array_join("i.suggestions", "|").alias("suggestions"))


# Labels and lookups ----------------------------------------------------------------------------------------------------------


@query("""select user_id, arg_max(label, event_id) filter (kind = 0) as reactions, arg_max(label, event_id) filter (kind = 1) as comments, arg_max(label, event_id) filter (kind = 2) as shares from (
  select user_id, event_id, event_id % 4 as kind, concat(event_id % 500, case event_id % 4 when 0 then ' reactions' when 1 then ' 則留言' when 2 then ' Shares' else ' views' end) as label from events) group by 1""")
def engagement_labels(spark, sf_dir):
    i = F.col("event_id")
    label = F.concat((i % 500).cast("string"), F.when(i % 4 == 0, " reactions").when(i % 4 == 1, " 則留言").when(i % 4 == 2, " Shares").otherwise(" views"))
    last = lambda form: F.max_by(F.when(F.col("label").rlike(form), F.col("label")), F.when(F.col("label").rlike(form), i))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", label.alias("label")).groupBy("user_id").agg(*(last(form).alias(name) for name, form in R.ENGAGEMENT.items()))


@query("""select event_id, case event_id % 3 when 0 then concat('model', event_id % 5) when 1 then concat('model', event_id % 5, ':7b') else 'gemini-nano' end as key from events""")
def model_keys(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit(" Model"), (i % 5).cast("string"), F.lit(":LATEST "))).when(i % 3 == 1, F.concat(F.lit("model"), (i % 5).cast("string"), F.lit(":7B"))).otherwise("Gemini Nano")
    return _table(spark, sf_dir, "events").select("event_id", R.model_key(raw).alias("key"))


@query("select event_id, event_id % 3 > 0 as shown from events where event_id % 4 > 0 union all select event_id, false from events where event_id % 4 = 0")
def personal_chip(spark, sf_dir):
    k = F.col("event_id") % 3
    headline = F.when(k == 0, "a｜ per sonal ｜b").when(k == 1, "a｜personally").otherwise("")
    return _table(spark, sf_dir, "events").select("event_id", R.shows_chip(headline, F.when(F.col("event_id") % 4 > 0, "personal ").otherwise(" ")).alias("shown"))


@query("""select event_id, case when event_id % 4 = 0 then 'supported' when event_id % 4 = 1 then 'supported' when event_id % 4 = 2 then 'unsupported' else 'unknown' end as vision from events""")
def cloud_model_vision(spark, sf_dir):
    k = F.col("event_id") % 4
    asked = F.when(k == 0, " SEE:27B ").when(k == 1, "see:27b-cloud").when(k == 2, "read:1t").otherwise("other")
    registry = spark.createDataFrame([("see:27b", ["text", "image"]), ("see:27b-cloud", ["text", "image"]), ("read:1t:cloud", ["text"])], "id string, input array<string>")
    keys = registry.select(F.explode(F.array_distinct(F.array(F.lower("id"), F.regexp_replace(F.lower("id"), ":cloud\\z", "")))).alias("name"), F.array_contains("input", "image").alias("image"))
    e = _table(spark, sf_dir, "events").select("event_id", F.lower(F.trim(asked)).alias("name"))
    return e.join(F.broadcast(keys), "name", "left").select("event_id", F.when(F.col("image").isNull(), "unknown").when(F.col("image"), "supported").otherwise("unsupported").alias("vision"))


CATALOG = [("zh", "n.view", "看 {n} 次"), ("en", "n.view", "{n} views"), ("en", "n.click", "{n} clicks"), ("zh", "n.purchase", "買 {n}")]


@query("""select event_id, case event_type when 'view' then concat('看 ', event_id % 9, ' 次') when 'click' then concat(event_id % 9, ' clicks') when 'purchase' then concat('買 ', event_id % 9) else concat('n.', event_type) end as label from events""")
def localized_labels(spark, sf_dir):
    """A label in the language asked for, else in English, else its key; the placeholder filled in."""
    words = spark.createDataFrame(CATALOG, "lang string, key string, value string")
    own, english = words.where("lang = 'zh'").select("key", F.col("value").alias("own")), words.where("lang = 'en'").select("key", F.col("value").alias("english"))
    e = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("n."), "event_type").alias("key"))
    found = e.join(F.broadcast(own), "key", "left").join(F.broadcast(english), "key", "left")
    return found.select("event_id", F.replace(F.coalesce("own", "english", "key"), F.lit("{n}"), (F.col("event_id") % 9).cast("string")).alias("label"))


@query("""select 'author' as kind, lower(author_name) as key, arg_max(post_id, seq) as post_id, min(seq) as first_seq from gql_v group by 2
  union all select 'text', left(text, 40), arg_max(post_id, seq), min(seq) from gql_v where length(text) > 20 group by 2""", "gql_v")
def network_indexes(spark, sf_dir):
    """By author and by the first 40 characters the last network post, in the order in which the key first came."""
    g = view(spark, sf_dir, "gql_v")
    index = lambda kind, key, rows: rows.groupBy(F.lit(kind).alias("kind"), key.alias("key")).agg(F.max(F.struct("seq", "post_id"))["post_id"].alias("post_id"), F.min("seq").alias("first_seq"))
    return index("author", F.lower("author_name"), g).union(index("text", F.left("text", F.lit(40)), g.where("length(text) > 20")))


@query("""select e.event_id, r.score from (select event_id, user_id, event_type from events) e left join (select event_id, concat(event_type, case when event_id % 3 = 0 then 'x' else '' end) as text_key, event_id * 7 % 100 / 100e0 as score from events where event_id % 2 = 0) r
  on r.event_id = e.event_id and r.text_key = e.event_type""")
def late_results(spark, sf_dir):
    """Results that come late count only while the post's text is still the one they were made for."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text_key"))
    made = _table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "x").otherwise("")).alias("text_key"), (F.col("event_id") * 7 % 100 / 100).alias("score"))
    return e.join(made, ["event_id", "text_key"], "left").select("event_id", "score")


@query("""select bucket, url from (select page_id % 20 as bucket, url, row_number() over (partition by page_id % 20 order by case when regexp_matches(p, '(?i)^/groups/[^/]+/posts/[^/]+') then 1 when regexp_matches(p, '(?i)^/[^/]+/posts/[^/]+') then 2
  when regexp_matches(p, '(?i)^/(story|permalink)[.]php\\z') then 3 when regexp_matches(p, '(?i)^/photo([.]php|/?\\z)') then 4 else 5 end, length(url), url) as r from (select page_id, regexp_replace(url, '#.*', '') as url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as p,
  lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as h from links_v) where (h = 'facebook.com' or h like '%.facebook.com') and regexp_matches(p, '(?i)^/groups/[^/]+/posts/[^/]+|^/[^/]+/posts/[^/]+|^/(permalink|story|photo)[.]php\\z|^/photo/?\\z|^/share/[prv]?/[^/]+')) where r = 1""", "links_v")
def permalink_by_priority(spark, sf_dir):
    u = F.col("url")
    links = view(spark, sf_dir, "links_v").where(R.is_post_url(u)).select((F.col("page_id") % 20).alias("bucket"), F.regexp_replace("url", "#.*", "").alias("url"))
    return links.groupBy("bucket").agg(F.min(F.struct(R.post_url_priority(u).alias("p"), F.length("url").alias("n"), "url")).alias("m")).select("bucket", "m.url")


@query("""select post_id, concat(found, case when suggestion <> '' then concat(' → ', suggestion) else '' end, case when n > 1 then concat(' ×', n) else '' end) as term,
  case when suggestion <> '' then 'lexical' when style then 'style' else 'other' end as display_group from (select post_id, found, suggestion, count(*) as n, bool_or(rule_type = 'translationese') as style from issues_v group by 1, 2, 3)""", "issues_v")
def formatted_terms(spark, sf_dir):
    t = view(spark, sf_dir, "issues_v").groupBy("post_id", "found", "suggestion").agg(F.count("*").alias("n"), F.bool_or(F.col("rule_type") == "translationese").alias("style"))
    term = F.concat("found", F.when(F.col("suggestion") != "", F.concat(F.lit(" → "), "suggestion")).otherwise(""), F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    return t.select("post_id", term.alias("term"), F.when(F.col("suggestion") != "", "lexical").when(F.col("style"), "style").otherwise("other").alias("display_group"))


@query("""select post_id, case when post_id % 2 = 0 then 0 else i end as info, case when post_id % 2 = 0 then 3 else w end as warning, case when post_id % 2 = 0 then 0 else e end as error from (
  select post_id, count(*) filter (severity = 'info') as i, count(*) filter (severity = 'warning') as w, count(*) filter (severity = 'error') as e from issues_v group by 1)""", "issues_v")
def severity_counts_given(spark, sf_dir):
    """Counts that come with a scan stand, unless all are zero: then the issues are counted."""
    given = F.array(F.lit(0), F.when(F.col("post_id") % 2 == 0, 3).otherwise(0), F.lit(0))
    names = ("info", "warning", "error")
    counted = view(spark, sf_dir, "issues_v").groupBy("post_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in names))
    some = F.exists(given, lambda x: x > 0)
    return counted.select("post_id", *(F.when(some, given[i]).otherwise(F.col(s)).alias(s) for i, s in enumerate(names)))


@query("""select event_id, event_id % 4 in (0, 1) as duplicate from events""")
def duplicate_details(spark, sf_dir):
    k = F.col("event_id") % 4
    a = F.lit("The claim about the river, and what it says!")
    b = F.when(k == 0, "the claim about THE river and what it says").when(k == 1, "Note: the claim about the river and what it says (twice)").when(k == 2, "the claim").otherwise("")
    return _table(spark, sf_dir, "events").select("event_id", R.same_detail(a, b).alias("duplicate"))


# States ----------------------------------------------------------------------------------------------------------------------


@query("select text_key, max(seq) as seq from cache_v group by 1 order by 2 desc limit 500", "cache_v")
def lru_cache(spark, sf_dir):
    return history.lru(view(spark, sf_dir, "cache_v"), "text_key", "seq")


BRIEFS = """with recursive o as (select *, row_number() over (partition by post_id order by seq) as r from brief_v), f as (
  select post_id, seq, r, text, deep_lang, deep, brief, false as stale, pending from o where r = 1
  union all select o.post_id, o.seq, o.r, case when o.text <> '' then o.text else f.text end, o.deep_lang, o.deep,
    case when o.brief is not null or o.pending then o.brief when f.brief is null and not f.pending then null when f.brief is not null and o.deep_lang is not null and f.brief <> o.deep_lang then null
      when (case when o.text <> '' then o.text else f.text end) is distinct from f.text or o.deep is distinct from f.deep or o.deep_lang is distinct from f.deep_lang then f.brief else f.brief end,
    case when o.brief is not null or o.pending then false when f.brief is null and not f.pending then false when f.brief is not null and o.deep_lang is not null and f.brief <> o.deep_lang then false
      when (case when o.text <> '' then o.text else f.text end) is distinct from f.text or o.deep is distinct from f.deep or o.deep_lang is distinct from f.deep_lang then f.brief is not null else f.stale end,
    case when o.brief is not null or o.pending then o.pending when f.brief is null and not f.pending then false when f.brief is not null and o.deep_lang is not null and f.brief <> o.deep_lang then false
      when (case when o.text <> '' then o.text else f.text end) is distinct from f.text or o.deep is distinct from f.deep or o.deep_lang is distinct from f.deep_lang then false else f.pending end
  from f join o on o.post_id = f.post_id and o.r = f.r + 1)"""


@query(f"select * from ({BRIEFS} select post_id, seq, text, brief, stale, pending from f)", "brief_v")
def ingest_fold(spark, sf_dir):
    """Each event merged with the post's state before it: text kept, a brief carried on, stale once text or analysis change, dropped if the language does."""
    return history.ingested(view(spark, sf_dir, "brief_v"))


HOLDS = """with recursive o as (select *, row_number() over (partition by user_id order by seq) as r from focus_v), f as (
  select user_id, seq, r, follow and true as accepted, case when follow then post_id end as current, case when manual then tick + 10 else 0 end as hold from o where r = 1
  union all select o.user_id, o.seq, o.r, o.follow and not (o.tick < f.hold and f.current is not null and f.current <> o.post_id) and f.current is distinct from o.post_id,
    case when o.follow and not (o.tick < f.hold and f.current is not null and f.current <> o.post_id) then o.post_id else f.current end, case when o.manual then o.tick + 10 else f.hold end
  from f join o on o.user_id = f.user_id and o.r = f.r + 1)"""


@query(f"select * from ({HOLDS} select user_id, seq, accepted, current from f)", "focus_v")
def current_view_hold(spark, sf_dir):
    """Which post a panel shows as others come into view: while a hand-chosen one is held, no other; the same one again changes nothing."""
    return history.held(view(spark, sf_dir, "focus_v"), hold=10)


@query("""select post_id, seq, case when share and kind2 = 'standard' then text1 else text2 end as text, case when share and kind2 = 'standard' then kind1 else kind2 end as kind,
  case when share and kind2 = 'standard' then case when kind1 = 'share_without_comment' then coalesce(nullif(shared2, ''), text2) else coalesce(nullif(shared2, ''), shared1) end else shared2 end as shared
  from (select post_id, seq, kind1 <> 'standard' as share, kind1, kind2, text1, text2, shared1, shared2 from expanded_v)""", "expanded_v")
def live_expanded_merge(spark, sf_dir):
    """A post read again after it was unfolded: a share stays one, with its own text, even if the new reading looks like a plain post."""
    c = F.col
    keep = (c("kind1") != "standard") & (c("kind2") == "standard")
    given = F.nullif("shared2", F.lit(""))
    shared = F.when(c("kind1") == "share_without_comment", F.coalesce(given, "text2")).otherwise(F.coalesce(given, "shared1"))
    return view(spark, sf_dir, "expanded_v").select("post_id", "seq", F.when(keep, c("text1")).otherwise(c("text2")).alias("text"), F.when(keep, c("kind1")).otherwise(c("kind2")).alias("kind"), F.when(keep, shared).otherwise(c("shared2")).alias("shared"))


WAY = """select event_id, enabled, case when not enabled then 'none' when allowed then 'kept' when cached and not shared then 'final' when configured and not shared then case when n_chars <= 1 then 'insufficient' when outcome = 'timeout' then 'error' when outcome = 'empty' then 'insufficient' else 'final' end else 'heuristic' end as state,
  case when not enabled then 0 when allowed then 1 when cached and not shared then 1 + sponsored::int else 1 + (configured and not shared)::int end as emitted, enabled and not allowed and sponsored as filtered from pipeline_v"""


@query(f"select event_id, state, emitted, case when state = 'none' then null when state = 'final' then 3 else 1 end as tier, filtered from ({WAY})", "pipeline_v")
def decision_pipeline(spark, sf_dir):
    """A post's way through the filters: its final state and tier, how many decisions are given out on the way, and whether it is filtered."""
    return R.decisions(view(spark, sf_dir, "pipeline_v"))


@query("""select event_id, (row_number() over (partition by event_id order by place) - 1)::int as step, stage, tier, filtered, pending, insufficient, error from (
  select event_id, 1 as place, 'allowed' as stage, 1 as tier, false as filtered, false as pending, false as insufficient, null::varchar as error from pipeline_v where enabled and allowed
  union all select event_id, 2, 'sponsored', 1, true, false, false, null from pipeline_v where enabled and not allowed and sponsored
  union all select event_id, 3, 'cached', 3, sponsored, false, false, null from pipeline_v where enabled and not allowed and cached and not shared
  union all select event_id, 4, 'heuristic', 1, false, not shared, false, null from pipeline_v where enabled and not allowed and not sponsored and (shared or not cached)
  union all select event_id, 5, 'model', case when n_chars > 1 and outcome = 'scores' then 3 else 1 end, sponsored, false, n_chars <= 1 or outcome = 'empty', case when n_chars <= 1 then 'too short' when outcome <> 'scores' then outcome end from pipeline_v where enabled and not allowed and not shared and not cached and configured)""", "pipeline_v")
def decisions_given(spark, sf_dir):
    """Every decision that is given out, step by step."""
    return R.decided(view(spark, sf_dir, "pipeline_v"))


@query("""select count(*) as seen, count(*) filter (not allowed and sponsored) as sponsored, count(*) filter (not allowed) as tier1, count(*) filter (not allowed and configured and not shared and not cached and n_chars > 1 and outcome <> 'timeout') as tier3,
  count(*) filter (not allowed and configured and not shared and not cached and n_chars > 1 and outcome = 'empty') as tier3_empty from pipeline_v where enabled""", "pipeline_v")
def pipeline_counts(spark, sf_dir):
    return R.counted(view(spark, sf_dir, "pipeline_v"))


UNITS = """(select event_id, list_concat([]::bigint[], flatten(list_transform(list_filter(string_split(t, ''), lambda x: x <> ''), lambda x: case when unicode(x) > 65535 then [55296 + (unicode(x) - 65536) // 1024, 56320 + (unicode(x) - 65536) % 1024] else [unicode(x)] end))) as cs
  from (select event_id, case event_id % 4 when 0 then concat('😀', event_type, event_id) when 1 then concat('é中', event_id) when 2 then '' else concat(event_type, '𝄞', props) end as t from events))"""
FNV = "list_reduce(list_prepend({0}::hugeint, list_transform(cs, lambda x: x::hugeint)), lambda h, x: (xor(h, x) * {1}) % 4294967296)::bigint"


@query(f"""select event_id, len(cs)::bigint as n, {FNV.format(2166136261, 16777619)} as h1, {FNV.format(2654435769, 2246822507)} as h2, list_reduce(list_prepend(5381::hugeint, list_transform(cs, lambda x: x::hugeint)), lambda h, x: (h * 33 + x) % 4294967296)::bigint as djb2 from {UNITS}""")
def utf16_hash_keys(spark, sf_dir):
    """Hashes over UTF-16 units, as scripts take them: characters beyond the basic plane count as two."""
    i = F.col("event_id") % 4
    t = F.when(i == 0, F.concat(F.lit("😀"), "event_type", "event_id")).when(i == 1, F.concat(F.lit("é中"), "event_id")).when(i == 2, "").otherwise(F.concat("event_type", F.lit("𝄞"), "props"))
    return _table(spark, sf_dir, "events").select("event_id", T.units(t).cast("long").alias("n"), R.fnv(t, 0x811C9DC5, 0x01000193).alias("h1"), R.fnv(t, 0x9E3779B9, 0x85EBCA6B).alias("h2"), T.djb2(t).alias("djb2"))


TERMS = r"""(select post_id, seq, severity, rule_type, kind, trim(found) as found, list_transform(list_filter(string_split(suggestions, '|'), lambda x: x <> ''), lambda x: trim(x)) as suggested from worded_v)"""
WORTHY = r"""rule_type <> 'punctuation' and severity <> 'info' and found <> '' and not regexp_matches(found, '^[\p{P}\p{S}\s]+$') and length(found) <= 16
  and not (found in ('圖像', '影像', '圖片', '相片', '照片') and len(suggested) > 0 and len(list_filter(suggested, lambda x: x not in ('圖像', '影像', '圖片', '相片', '照片'))) = 0)"""


@query(f"select post_id, count(*) as n, count(*) >= 2 as badge from {TERMS} where {WORTHY} group by 1", "worded_v")
def hint_counts(spark, sf_dir):
    """How many issues a hint on a post counts: only those worth showing in little room."""
    return review.hints(view(spark, sf_dir, "worded_v").withColumn("suggestions", F.filter(F.split("suggestions", "[|]"), lambda x: x != "")))


@query(f"""select post_id, issue_count, badge_count, info, warning, error, rules, signal, examples from (with parts as (
    select post_id, kind, count(*) as issue_count, count(*) filter ({WORTHY}) as badge_count, count(*) filter (severity = 'info') as info, count(*) filter (severity = 'warning') as warning, count(*) filter (severity = 'error') as error from {TERMS} group by 1, 2),
  summed as (select post_id, sum(issue_count)::bigint as issue_count, sum(badge_count)::bigint as badge_count, sum(info)::bigint as info, sum(warning)::bigint as warning, sum(error)::bigint as error, least(1, sum(badge_count) / 5e0)::double as signal from parts group by 1),
  rules as (select post_id, string_agg(rule_type || ':' || n, ',' order by rule_type) as rules from (select post_id, rule_type, count(*) as n from worded_v group by 1, 2) group by 1),
  shown as (select post_id, string_agg(found, '|' order by k, seq) as examples from (select *, case kind when 'post_text' then 1 when 'shared_content' then 2 when 'link_preview' then 3 else 4 end as k, row_number() over (partition by post_id, kind order by seq) as r from {TERMS}) where r <= 3 group by 1)
  select * from summed join rules using (post_id) join shown using (post_id))""", "worded_v")
def review_totals(spark, sf_dir):
    """A post's review from its segments' reviews: counts, badges, severities and rules added up, examples one after the other."""
    issues = view(spark, sf_dir, "worded_v").withColumn("suggestions", F.filter(F.split("suggestions", "[|]"), lambda x: x != ""))
    found = review.aggregated(review.segment_reviews(issues))
    rules = F.array_join(F.transform(F.array_sort(F.map_entries("issue_summary")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return found.select("post_id", "issue_count", "badge_count", "info", "warning", "error", rules.alias("rules"), "signal", F.array_join("examples", "|").alias("examples"))
