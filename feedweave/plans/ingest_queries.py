"""Queries of what comes in: markers in pages, posts and signals in nested JSON, late marks and cached scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import enrich
from feedweave.operators.tables import shared_folder
from feedweave.plans.catalog import AUTHORS, SEED, _table, compacted, query
from feedweave.plans.views import view
from feedweave.sources import markers, nested

WIDE = r"[\x{10000}-\x{10FFFF}]"


def sql_units(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '{WIDE}')))"


def sql_scan(kind: str) -> str:
    """A kind's matches with their positions: the lengths of what lies between matches, and of the matches before."""
    pattern, group = markers.PATTERNS[kind], 0 if kind == "marker" else 1
    pattern = pattern.replace("{10,8000}", "{10,}").replace(r"\u2028\u2029", r"\x{2028}\x{2029}")  # the engine's patterns repeat 1,000 times at most
    most = " where length(regexp_replace(value, '\\\\.', 'x', 'g')) <= 8000" if kind == "message" else ""
    return f"""select page_id, '{kind}' as kind, {sql_units("before")} as pos, value from (
      select page_id, array_to_string(gaps[1:i], '') || array_to_string(hits[1:i - 1], '') as before, vals[i] as value from (
        select *, unnest(range(1, len(hits) + 1)) as i from (
          select page_id, string_split_regex(html, '{pattern}') as gaps, regexp_extract_all(html, '{pattern}') as hits, regexp_extract_all(html, '{pattern}', {group}) as vals from scripts_v))){most}"""


SCAN = " union all ".join(sql_scan(k) for k in markers.PATTERNS)
UNESCAPED = "coalesce(try(json_extract_string(concat(chr(34), {0}, chr(34)), '$')), {0})"
NEAR = "(select value from marks o where o.page_id = m.page_id and o.kind = '{0}' order by abs(o.pos - m.pos), o.pos, o.value limit 1)"
PAGE_POSTS = f"""select page_id, place, coalesce(post_id, 'ssr-' || place) as post_id, coalesce({UNESCAPED.format("message")}, '') as text, coalesce({UNESCAPED.format("actor")}, '') as author_name from (
  select page_id, (row_number() over (partition by page_id order by pos))::int as place, {", ".join(f"{NEAR.format(k)} as {k}" for k in markers.FIELDS)} from marks m where kind = 'marker')"""
PAGE_POSTS = f"select * from ({PAGE_POSTS}) where {sql_units('text')} > 10 or {sql_units('author_name')} > 1"


@query(SCAN, "scripts_v")
def ssr_marker_scan(spark, sf_dir):
    """Every marker and field in the pages' scripts, with its position."""
    return markers.scan(view(spark, sf_dir, "scripts_v"))


@query(f"select * from (with marks as ({SCAN}) {PAGE_POSTS})", "scripts_v")
def ssr_sponsored_posts(spark, sf_dir):
    return markers.sponsored_posts(view(spark, sf_dir, "scripts_v"))


VALID = f"""regexp_matches(url, '(?i)^https?://') and regexp_matches(url, '^https?://([^/]*[.])?facebook[.]com(/|$)') and {sql_units("url")} <= 2048 and count(place) between 1 and 30
  and bool_and(trim(post_id) <> '' and {sql_units("trim(post_id)")} <= 240 and trim(text) <> '' and {sql_units("trim(text)")} <= 5000 and trim(author_name) <> '' and {sql_units("trim(author_name)")} <= 240)"""


@query(f"""select run::int as run, page_id, hit, n_posts::int as n_posts from (with marks as ({SCAN}), posts as ({PAGE_POSTS}),
  judged as (select page_id, url, count(place) as n_posts, coalesce({VALID}, false) as valid from urls_v left join posts using (page_id) group by 1, 2),
  reps as (select url, min(page_id) filter (page_id % 2 = 0) as even, min(page_id) as first from urls_v group by 1),
  known as (select r.url, coalesce(e.valid, false) as valid0, e.n_posts as n0, f.valid as valid1, f.n_posts as n1 from reps r left join judged e on e.page_id = r.even join judged f on f.page_id = r.first)
  select run, page_id, case run when 1 then valid0 when 2 then valid0 or valid1 else false end as hit, case when run = 0 then n0 when run in (1, 2) and valid0 then n0 else n1 end as n_posts
  from urls_v join known using (url) cross join range(0, 4) t(run) where run > 0 or page_id % 2 = 0)""", "scripts_v", "urls_v")
def ssr_cache_aside(spark, sf_dir):
    """Four rounds of requests for pages' posts: half of the pages, all a minute later, all again, and all once every entry has expired."""
    urls = view(spark, sf_dir, "urls_v").join(view(spark, sf_dir, "scripts_v"), "page_id").select(F.col("url").alias("key"), "page_id", "html")
    cache = markers.cached_scans(spark, shared_folder(spark))
    rounds = [(urls.where("page_id % 2 = 0"), 0), (urls, 60), (urls, 120), (urls, 360)]
    found = [cache.ask(rows, markers.posts_by_key, now).select(F.lit(i).alias("run"), "page_id", "hit", F.size("answer").alias("n_posts")) for i, (rows, now) in enumerate(rounds)]
    return found[0].union(found[1]).union(found[2]).union(found[3])


# A page's posts in their order and the sponsored ones that come late, session by session.
MATCHED = f"length(a.t) >= 8 and length(g.t) >= 8 and (contains(a.t, {SEED.format('g.t')}) or contains(g.t, {SEED.format('a.t')}))"


@query(f"""select session, post_id, late_id from (with recursive shown as (select doc_id % 12 as session, doc_id as post_id, doc_id as place, {compacted('text')} as t from documents where doc_id % 9 <> 4),
  late as (select session, late_id, t, row_number() over (partition by session order by came, late_id) as k from (select seq % 12 as session, post_id as late_id, 0 - seq as came, text, {compacted('text')} as t from gql_v where is_sponsored or seq % 5 = 0) where {sql_units('text')} >= 30),
  pairs as (select g.session, g.k, any_value(g.late_id) as late_id, list(a.post_id order by a.place, a.post_id) as wanted from late g join shown a on a.session = g.session and {MATCHED} group by 1, 2),
  steps as (select session, 0::bigint as k, []::bigint[] as taken, null::bigint as post_id, null::varchar as late_id from (select distinct session from late)
    union all select s.session, p.k, case when len(w) > 0 then s.taken || w[1:1] else s.taken end, w[1], p.late_id from steps s join (
      select *, row_number() over (partition by session order by k) as j, lag(k, 1, 0) over (partition by session order by k) as before from pairs) p on p.session = s.session and p.before = s.k, lateral (select list_filter(p.wanted, lambda x: not list_contains(s.taken, x)) as w) f)
  select * from steps) where post_id is not null""", "gql_v")
def late_sponsored_marks(spark, sf_dir):
    """Which posts already on a page the sponsored posts mark that come after them, the newest first; some were marked before."""
    shown = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 12).alias("session"), F.col("doc_id").alias("post_id"), F.col("doc_id").alias("seq"), "text", (F.col("doc_id") % 9 == 4).alias("marked"))
    late = view(spark, sf_dir, "gql_v").where("is_sponsored or seq % 5 = 0").select((F.col("seq") % 12).alias("session"), F.col("post_id").alias("late_id"), (-F.col("seq")).alias("seq"), "text")
    return enrich.late_marks(shown, late)


@query(f"""select post_id, late_id, before, after from (with shown as (select doc_id % 12 as session, doc_id as post_id, {compacted('left(text, 300)')} as t, length(text) as classified from documents where doc_id % 9 <> 4),
  late as (select seq % 12 as session, post_id as late_id, 0 - seq as came, length(t0) as u, {compacted('t0')} as t from (select *, case when seq % 3 = 0 then text || ' and much more than fifty characters that only the network knows of' when seq % 3 = 1 then text || ' a bit' else left(text, 200) || repeat('x', 400) end as t0 from gql_v) where length(t0) > 30),
  met as (select g.session, g.late_id, any_value(g.came) as came, any_value(g.u) as u, min(a.post_id) as post_id, arg_min(a.classified, a.post_id) as classified from late g join shown a on a.session = g.session and {MATCHED} group by 1, 2),
  folded as (select post_id, list_reduce(list({{'u': u, 'late_id': late_id}} order by came, late_id), lambda s, x: {{'last': case when x.u > s.last + 50 then x.u else s.last end, 'got': case when x.u > s.last + 50 then list_append(s.got, {{'late_id': x.late_id, 'before': s.last, 'after': x.u}}) else s.got end}},
    {{'last': any_value(classified), 'got': []::struct(late_id varchar, before bigint, after bigint)[]}}) as f from met where classified > 0 group by 1)
  select post_id, g.late_id as late_id, g.before::int as before, g.after::int as after from (select post_id, unnest(f.got) as g from folded))""", "gql_v")
def late_text_upgrades(spark, sf_dir):
    """Posts whose text the network's fuller ones replace, one after the other, as long as each is much longer than the one before."""
    d = _table(spark, sf_dir, "documents")
    shown = d.where("doc_id % 9 <> 4").select((F.col("doc_id") % 12).alias("session"), F.col("doc_id").alias("post_id"), F.col("doc_id").alias("seq"), F.left("text", F.lit(300)).alias("text"), F.length("text").alias("classified"))
    k, text = F.col("seq") % 3, F.col("text")
    fuller = F.when(k == 0, F.concat(text, F.lit(" and much more than fifty characters that only the network knows of"))).when(k == 1, F.concat(text, F.lit(" a bit"))).otherwise(F.concat(F.left("text", F.lit(200)), F.repeat(F.lit("x"), F.lit(400))))
    late = view(spark, sf_dir, "gql_v").select((F.col("seq") % 12).alias("session"), F.col("post_id").alias("late_id"), (-F.col("seq")).alias("seq"), fuller.alias("text"))
    return enrich.text_upgrades(shown, late)


@query("""select post_id, greatest(post_id, came) as marked_at, came > post_id as late from (select p.post_id, min(g.seq) as came from posts_v p join gql_v g on g.is_sponsored and length(g.text) > 20 and contains(left(p.full_text, 200), left(g.text, 30)) group by 1)""", "posts_v", "gql_v")
def sponsored_when_known(spark, sf_dir):
    """When a post is known for sponsored: as it is seen, or once the text that gives it away has come."""
    posts = view(spark, sf_dir, "posts_v").select("post_id", F.col("post_id").alias("seq"), F.col("full_text").alias("text"))
    return enrich.known_when(posts, view(spark, sf_dir, "gql_v").where("is_sponsored"))


# Nested JSON ------------------------------------------------------------------------------------------------------------

NODES = "select n.*, d.doc_id as root, len(regexp_extract_all(n.path, '[.\\[]')) as depth from nested_v d, json_tree(d.body) n"
SIGNAL = """(key in ('is_sponsored', 'is_pseudo_organic') and type = 'BOOLEAN' and value::varchar = 'true' or key in ('sponsored_data', 'boosted_post_data', 'th_dat_spo') and type in ('OBJECT', 'ARRAY')
  or key in ('ad_id', 'ad_client_token') and type = 'VARCHAR' and atom::varchar <> '""' or key = 'sponsor_id' and type <> 'NULL'
  or key = 'tracking_data' and type = 'OBJECT' and (list_contains(json_keys(value), 'ad_id') or list_contains(json_keys(value), 'campaign_id')))"""


@query(f"select doc_id, count(s.root) > 0 as sponsored from nested_v left join (select root from ({NODES}) where depth <= 15 and {SIGNAL}) s on s.root = doc_id group by 1", "nested_v")
def sponsorship_signals(spark, sf_dir):
    """Whether a sponsorship field lies anywhere in a nested value, down to the objects at depth 15."""
    rows = view(spark, sf_dir, "nested_v").select(F.col("doc_id").alias("id"), F.parse_json("body").alias("value"))
    return rows.select(F.col("id").alias("doc_id")).join(nested.signalled(rows).withColumn("s", F.lit(True)), F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("s", F.lit(False)).alias("sponsored"))


def field(*paths: str) -> str:
    """The first of these that is neither absent nor null."""
    return "coalesce(" + ", ".join(f"json_extract_string(value, '{p}')" for p in paths) + ")"


KIND = """case when coalesce(json_type(value, '$.attached_story'), 'NULL') <> 'NULL' then 'reshare' when json_type(value, '$.url') = 'VARCHAR' and contains(json_extract_string(value, '$.url'), '/reel/') then 'reel'
  when coalesce(json_type(value, '$.target_group'), 'NULL') <> 'NULL' then 'group' when json_type(value, '$.is_text_only_story') = 'BOOLEAN' and json_extract_string(value, '$.is_text_only_story') = 'true' then 'text_only'
  when coalesce(json_array_length(value, '$.actors'), 0) = 0 then 'page' else 'standard' end"""
INNER = SIGNAL.replace("key ", "i.key ").replace("type ", "i.type ").replace("value", "i.value").replace("atom", "i.atom")


@query(f"""with nodes as ({NODES}), posts as (
    select root, id, path, depth, fullkey, value, json_extract_string(value, '$.message.text') as text, {field('$.actors[0].name', '$.owning_profile.name', '$.comet_sections.context_layout.story.actors[0].name')} as author_name,
      coalesce({field('$.post_id', '$.story_id', '$.id', '$.feedback_id', '$.creation_story.post_id', '$.creation_story.id')}, '') as post_id, {KIND} as post_type from nodes
    where type = 'OBJECT' and json_type(value, '$.message.text') = 'VARCHAR' and len(regexp_extract_all(fullkey, '[.\\[]')) <= 30
  ), kept as (select *, row_number() over (partition by root, left(text, 50) order by id) as r from posts where {sql_units('text')} > 3 and author_name <> ''),
  signals as (select distinct k.root, k.id from kept k join nodes i on i.root = k.root and r = 1 and (i.path = k.fullkey or starts_with(i.path, k.fullkey || '.') or starts_with(i.path, k.fullkey || '['))
    and i.depth - len(regexp_extract_all(k.fullkey, '[.\\[]')) <= 15 and {INNER})
  select k.root as doc_id, (row_number() over (partition by k.root order by k.id) - 1)::int as pos, post_id, author_name, text, s.id is not null as is_sponsored, post_type,
    case when post_type = 'reshare' then json_extract_string(value, '$.attached_story.message.text') end as reshare_text, case when post_type = 'reshare' then json_extract_string(value, '$.attached_story.actors[0].name') end as reshare_author
  from kept k left join signals s on s.root = k.root and s.id = k.id where r = 1""".replace("with nodes as", "select * from (with nodes as", 1) + ")", "nested_v")
def nested_posts(spark, sf_dir):
    """Every post at any depth of a response, whatever encloses it, with its kind and whether its own subtree is sponsored."""
    return nested.posts(view(spark, sf_dir, "nested_v").select(F.col("doc_id").alias("id"), "body")).withColumnRenamed("id", "doc_id")
