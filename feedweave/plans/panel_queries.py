"""Queries of the reading panel: names, gates, policies, briefs, health and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedweave.functions import panel as P
from feedweave.functions import text as T
from feedweave.operators import enrich, history
from feedweave.plans.catalog import OBJECT, _table, compacted, query, squeezed
from feedweave.plans.views import rules, view


@query("""select post_id, seq, (length(a) < 2 or length(b) < 2 or contains(lower(a), lower(b)) or contains(lower(b), lower(a))) as compatible
  from (select p.post_id, g.seq, p.author_name as a, g.author_name as b from posts_v p join gql_v g using (seq))""", "posts_v", "gql_v")
def author_compat(spark, sf_dir):
    g = view(spark, sf_dir, "gql_v").select("seq", F.col("author_name").alias("other"))
    return view(spark, sf_dir, "posts_v").join(g, "seq").select("post_id", "seq", T.compatible_authors(F.col("author_name"), F.col("other")).alias("compatible"))


@query("""select event_id, rule_id, substr(raw, 4 + k, 1)::double / 10 as score from (select event_id, concat(raw, right(concat('00', event_id % 100), 2)) as raw from llm_v where regexp_matches(raw, '^[0-9]+\\z')),
  (select rule_id, row_number() over (order by ord) as k from rules_v where enabled) r where r.k <= 2""", "llm_v")
def rule_positional_zip(spark, sf_dir):
    listed = enrich.active_rules(rules(spark), 2).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rule_id"))), lambda r: r["rule_id"]).alias("ids"))
    raw = F.concat("raw", F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    rows = view(spark, sf_dir, "llm_v").where(F.col("raw").rlike(r"^[0-9]+\z")).withColumn("raw", raw).join(F.broadcast(listed), F.lit(True))  # one row: the rules
    return rows.select("event_id", "raw", F.posexplode("ids").alias("pos", "rule_id")).select("event_id", "rule_id", (F.substring(F.col("raw"), F.col("pos") + 5, F.lit(1)).cast("double") / 10).alias("score"))


@query("""select e.event_id, coalesce(substr(l.raw, 1, 1)::double / 10, 0e0) as commercial, l.event_id is not null as answered from events e left join (select * from llm_v where regexp_matches(raw, '^[0-9]{4}\\z')) l using (event_id)""", "llm_v")
def request_result_defaults(spark, sf_dir):
    answers = view(spark, sf_dir, "llm_v").where(F.col("raw").rlike(r"^[0-9]{4}\z")).select("event_id", (F.left("raw", F.lit(1)).cast("double") / 10).alias("c"))
    return _table(spark, sf_dir, "events").select("event_id").join(answers, "event_id", "left").select("event_id", F.coalesce("c", F.lit(0.0)).alias("commercial"), F.col("c").isNotNull().alias("answered"))


MODELS = [("alpha:latest", 1), ("alpha:7b", 2), ("beta:1b", 3), ("gamma:latest", 4), ("gamma:2b", 5), ("delta", 6), ("beta:9b", 7)]


@query(f"""with m(name, ord) as (values {', '.join(map(str, MODELS))}), w as (select event_id, case event_id % 6 when 0 then 'alpha' when 1 then 'beta' when 2 then 'gamma:2b' when 3 then 'delta' when 4 then 'omega' else 'beta:9b' end as asked from events)
  select event_id, asked, (select name from m where name = asked or split_part(name, ':', 1) = asked order by name <> asked, name not like '%:latest', ord limit 1) as model from w""")
def model_name_resolve(spark, sf_dir):
    i = F.col("event_id") % 6
    asked = F.when(i == 0, "alpha").when(i == 1, "beta").when(i == 2, "gamma:2b").when(i == 3, "delta").when(i == 4, "omega").otherwise("beta:9b")
    m = spark.createDataFrame(MODELS, "name string, ord int")
    keys = m.select(F.explode(F.array_distinct(F.array("name", F.split("name", ":")[0]))).alias("asked"), "name", "ord")
    best = keys.groupBy("asked").agg(F.min(F.struct((F.col("name") != F.col("asked")).alias("a"), (~F.col("name").endswith(":latest")).alias("b"), "ord", "name"))["name"].alias("model"))
    return _table(spark, sf_dir, "events").select("event_id", asked.alias("asked")).join(F.broadcast(best), "asked", "left").select("event_id", "asked", "model")


@query("""select post_id, regexp_extract(header, '^[^·•─✓]*') as raw, """ + squeezed("regexp_replace(regexp_extract(header, '^[^·•─✓]*'), '(?i)\\b(verified account|follow|join)\\b', '', 'g')") + " as name from posts_v", "posts_v")
def identity_names(spark, sf_dir):
    return view(spark, sf_dir, "posts_v").select("post_id", F.regexp_extract("header", "^[^·•─✓]*", 0).alias("raw"), P.identity(F.col("header")).alias("name"))


@query("""select post_id, case when post_id % 2 = 0 then full_text else full_text end as text from posts_v""", "posts_v")
def inline_author_prefix(spark, sf_dir):
    body = F.col("full_text")
    text = F.concat(F.when(F.col("post_id") % 2 == 0, F.concat("author_name", F.lit(" · "))).otherwise(""), body)
    return view(spark, sf_dir, "posts_v").select("post_id", P.without_author(text, F.col("author_name")).alias("text"))


@query(f"""select post_id, b <> '' and (length(a) <= 1 or (length(b) >= 2 and (contains(a, b) or contains(b, a)))) as silent, length(b) >= 20 and (a = b or contains(b, a) or contains(a, b)) as duplicate
  from (select post_id, {compacted('dom_text')} as a, {compacted('full_text')} as b from posts_v)""", "posts_v")
def share_without_own_comment(spark, sf_dir):
    own, shared = F.col("dom_text"), F.col("full_text")
    return view(spark, sf_dir, "posts_v").select("post_id", P.shares_without_comment(own, shared).alias("silent"), P.duplicates_own(own, shared).alias("duplicate"))


@query("""select event_id, case when v < 1 then '<1ms' when v < 1000 then concat(cast(floor(v) as bigint), 'ms') else concat(cast(floor(floor(v / 100 + 0.5) / 10) as bigint), '.', cast(floor(v / 100 + 0.5) as bigint) % 10, 's') end as took,
  case when v > 10000 then 'slow' else 'ok' end as latency from (select event_id, value * event_id / 100e0 as v from events)""")
def durations(spark, sf_dir):
    v = F.col("value") * F.col("event_id") / 100
    return _table(spark, sf_dir, "events").select("event_id", P.duration(v).alias("took"), F.when(v > 10000, "slow").otherwise("ok").alias("latency"))


@query("""select page_id, regexp_replace(regexp_replace(url, '/+\\z', ''), '/v1\\z', '') as endpoint, case when not regexp_matches(url, '(?i)^https?://') then 'scheme' when regexp_matches(url, '(?i)[?&](key|token|api_key)=') then 'secret'
  when regexp_matches(url, '(?i)^http://') and not regexp_matches(url, '(?i)^http://(localhost|127[.]0[.]0[.]1)([:/]|\\z)') then 'plain_http' end as problem from pages""")
def endpoint_checks(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", P.endpoint(F.col("url")).alias("endpoint"), P.endpoint_problem(F.col("url")).alias("problem"))


@query("""select post_id, regexp_matches(q, '(?i)GitHub|API|docs?|source') and not regexp_matches(q, '低風險') as act from (select post_id, concat(case post_id % 4 when 0 then 'Where are the API docs?' when 1 then '低風險 API' when 2 then 'GitHub' else 'why' end, '') as q from posts_v)""", "posts_v")
def question_policy(spark, sf_dir):
    k = F.col("post_id") % 4
    q = F.when(k == 0, "Where are the API docs?").when(k == 1, "低風險 API").when(k == 2, "GitHub").otherwise("why")
    return view(spark, sf_dir, "posts_v").select("post_id", P.is_actionable(q).alias("act"))


@query("""select event_id, array_to_string(list_distinct_ordered, ',') as tags from (select event_id, case when event_id % 2 = 0 then [event_type, concat('k', event_id % 10)] else [event_type] end as list_distinct_ordered from events)""")
def tags_normalize(spark, sf_dir):
    extra = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" k"), (F.col("event_id") % 10).cast("string"), F.lit(" "))).otherwise("not a tag!")
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(P.tags(F.array("event_type", extra, "event_type")), ",").alias("tags"))


@query(f"""select event_id, left(json_extract_string(j, '$.qs[0].q'), 20) as question, json_array_length(j, '$.qs') as n from (select event_id, json(concat('{{"qs":[{{"q":"what about ', event_type, ' in full"}},{{"q":"b"}}],"bg":[]}}')) as j from events)""")
def brief_normalize(spark, sf_dir):
    schema = "struct<qs:array<struct<q:string,kind:string>>,bg:array<struct<t:string>>>"
    raw = F.concat(F.lit('{"qs":[{"q":"what about '), "event_type", F.lit(' in full"},{"q":"b"},{"kind":"x"},{"q":""}],"bg":[]}'))
    kept = F.slice(F.filter(F.from_json(raw, schema)["qs"], lambda x: F.coalesce(x["q"], F.lit("")) != ""), 1, 3)
    return _table(spark, sf_dir, "events").select("event_id", F.left(kept[0]["q"], F.lit(20)).alias("question"), F.size(kept).cast("long").alias("n"))


@query("""select event_id, case event_id % 4 when 0 then 0.9e0 when 1 then 0.55e0 when 2 then 0.2e0 else 0e0 end as risk from events""")
def device_risk_levels(spark, sf_dir):
    k = F.col("event_id") % 4
    level = F.when(k == 0, "High").when(k == 1, "medium").when(k == 2, "LOW").otherwise("odd")
    return _table(spark, sf_dir, "events").select("event_id", P.risk(level).alias("risk"))


SENSITIVE = "coalesce(needs_fact_check, false) or coalesce(factual_risk, 0) >= 0.7"


@query(f"""select event_id, array_to_string(list_filter([case when is_sponsored then 'sponsored' end, case when coalesce(deep_commercial, commercial) >= 0.75 then 'commercial' end, case when political >= 0.6 then 'political' end,
  case when emotional >= 0.75 then 'emotional_strong' when emotional >= 0.6 then 'emotional' end, case when personal >= 0.7 then 'personal' end, case when {SENSITIVE} then 'needs_check' end,
  case when text_ai >= 0.7 then 'text_ai' end, case when image_ai >= 0.7 then 'image_ai' end], lambda x: x is not null), ',') as signals,
  case when {SENSITIVE} then 'fact_check' when text_ai >= 0.7 or image_ai >= 0.7 then 'ai' when coalesce(deep_commercial, commercial) >= 0.75 then 'commercial' end as action,
  array_to_string(list_filter([case when {SENSITIVE} then 'fact_check' end, case when factual_risk >= 0.7 then 'fact_risk' end, case when manipulation >= 0.5 then 'manipulation' end, case when low_quality >= 0.5 then 'low_quality' end], lambda x: x is not null), ',') as quality
  from decisions_v""", "decisions_v")
def investigation_signals(spark, sf_dir):
    """Main signals, recommended action and signs of quality of each decision."""
    sensitive = F.coalesce("needs_fact_check", F.lit(False)) | (F.coalesce("factual_risk", F.lit(0.0)) >= 0.7)
    intent, ai = F.coalesce("deep_commercial", "commercial"), (F.coalesce("text_ai", F.lit(0.0)) >= 0.7) | (F.coalesce("image_ai", F.lit(0.0)) >= 0.7)
    named = lambda *rows: F.array_join(F.array_compact(F.array(*(F.when(on, name) for on, name in rows))), ",")
    c = F.col
    signals = named(
        (c("is_sponsored"), "sponsored"), (intent >= 0.75, "commercial"), (c("political") >= 0.6, "political"), (c("emotional") >= 0.75, "emotional_strong"), ((c("emotional") >= 0.6) & (c("emotional") < 0.75), "emotional"),
        (c("personal") >= 0.7, "personal"), (sensitive, "needs_check"), (c("text_ai") >= 0.7, "text_ai"), (c("image_ai") >= 0.7, "image_ai"),
    )
    quality = named((sensitive, "fact_check"), (c("factual_risk") >= 0.7, "fact_risk"), (c("manipulation") >= 0.5, "manipulation"), (c("low_quality") >= 0.5, "low_quality"))
    return view(spark, sf_dir, "decisions_v").select("event_id", signals.alias("signals"), F.when(sensitive, "fact_check").when(ai, "ai").when(intent >= 0.75, "commercial").alias("action"), quality.alias("quality"))


@query(f"""select event_id, array_to_string(list_filter([case when {SENSITIVE} then 'fact_check' end, case when text_ai >= 0.7 then 'text_ai' end, case when image_ai >= 0.7 and has_media then 'image_support' end,
  case when coalesce(deep_commercial, commercial) >= 0.75 then 'commercial' end, case when low_quality >= 0.5 then 'quality' end, case when emotional >= 0.6 or manipulation >= 0.5 then 'emotional' end, case when political >= 0.6 then 'neutral' end],
  lambda x: x is not null)[1:4], ',') as questions from decisions_v""", "decisions_v")
def suggested_questions(spark, sf_dir):
    """Kinds of questions worth asking about a decision: the first four that apply."""
    c = F.col
    sensitive = F.coalesce("needs_fact_check", F.lit(False)) | (F.coalesce("factual_risk", F.lit(0.0)) >= 0.7)
    rows = (
        (sensitive, "fact_check"), (c("text_ai") >= 0.7, "text_ai"), ((c("image_ai") >= 0.7) & c("has_media"), "image_support"), (F.coalesce("deep_commercial", "commercial") >= 0.75, "commercial"),
        (c("low_quality") >= 0.5, "quality"), ((c("emotional") >= 0.6) | (F.coalesce("manipulation", F.lit(0.0)) >= 0.5), "emotional"), (c("political") >= 0.6, "neutral"),
    )
    return view(spark, sf_dir, "decisions_v").select("event_id", F.array_join(F.slice(F.array_compact(F.array(*(F.when(on, n) for on, n in rows))), 1, 4), ",").alias("questions"))


@query("""select event_id from (select event_id, user_id, ts, event_type, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where event_type = 'view' and (nxt is null or epoch_us(nxt) - epoch_us(ts) >= 60e6)""")
def candidate_delay(spark, sf_dir):
    """Views that nothing interrupts for a minute."""
    return history.debounced(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 60).where("event_type = 'view'").select("event_id")


DENIED = "messages|settings|marketplace|watch|gaming|events|notifications|photo|stories|reel|help|privacy|policies|legal|about|business|ads|developers"


@query(f"""select user_id, event_id, case when bool_or(emitted) over r then 'healthy' when epoch_us(ts) - epoch_us(min(ts) over r) < 20e6 or not has_main or regexp_matches(path, '^/({DENIED})')
  or not regexp_matches(path, '^/\\z|^/groups/[^/]+/?\\z|^/[^/]+/?\\z') then 'unknown' else 'unhealthy' end as health from (select *, sum(moved) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (
  select *, case when path = lag(path) over (partition by user_id order by ts, event_id) then 0 else 1 end as moved from ticks_v)) window r as (partition by user_id, run order by ts, event_id rows unbounded preceding)""", "ticks_v")
def health_state(spark, sf_dir):
    """Per tick: healthy once a post was found on the path, unhealthy 20 seconds after its first tick if it looks like a feed, else unknown; a new path starts anew."""
    return history.health(view(spark, sf_dir, "ticks_v"), "user_id", "ts", "event_id")


@query(f"""select user_id, event_id, not regexp_matches(path, '^/({DENIED})') and regexp_matches(path, '^/\\z|^/groups/[^/]+/?\\z|^/[^/]+/?\\z') as feed_like from ticks_v""", "ticks_v")
def feed_like_paths(spark, sf_dir):
    return view(spark, sf_dir, "ticks_v").select("user_id", "event_id", T.is_feed_like(F.col("path")).alias("feed_like"))


@query("""select user_id, event_id, coalesce(event_type <> lag(event_type) over (partition by user_id order by ts, event_id), true) as reset from events""")
def recycle_detection(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).alias("reset"))


@query("""select conv_id, case when bool_or(length(text) > 5000) or count(*) > 30 then 'rejected' else 'accepted' end as batch, count(*) as n, sum(length(text))::bigint as n_chars from conversations group by 1""")
def batch_validation(spark, sf_dir):
    bad = F.bool_or(F.length("text") > 5000) | (F.count("*") > 30)
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.when(bad, "rejected").otherwise("accepted").alias("batch"), F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("""select event_id, json_object('id', event_id, 'c', floor(commercial * 100)::int, 'sponsored', is_sponsored)::varchar as evidence from decisions_v""", "decisions_v")
def evidence_json(spark, sf_dir):
    return view(spark, sf_dir, "decisions_v").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.floor(F.col("commercial") * 100).cast("int").alias("c"), F.col("is_sponsored").alias("sponsored"))).alias("evidence"))


@query(f"""select doc_id from (select doc_id, min(doc_id) over (partition by {compacted('text')}) as first from documents) where doc_id = first""")
def deduped_rows(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(T.compact(F.col("text")).alias("t")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""select doc_id, list_reduce(list_prepend(5381::bigint, list_transform(string_split(text, ''), lambda x: unicode(x)::bigint)), lambda h, x: (h * 33 + x) & 4294967295) as h from documents where text <> ''""")
def text_hash_keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.djb2(F.col("text")).alias("h"))


@query("""select post_id, seq, max(completeness_rank) over (partition by post_id order by seq rows unbounded preceding)::int as best_rank from (select *, case completeness when 'likely_truncated' then 1 when 'visible_complete' then 2 else 3 end as completeness_rank from event_log_v)""", "event_log_v")
def richer_text_kept(spark, sf_dir):
    rank = F.create_map(*(x for k, v in history.RANK.items() for x in (F.lit(k), F.lit(v))))[F.col("completeness")]
    w = Window.partitionBy("post_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf_dir, "event_log_v").select("post_id", "seq", F.max(rank).over(w).alias("best_rank"))


@query("select rule_id, k::int as k from (select rule_id, row_number() over (order by ord) as k from rules_v where enabled) where k <= 10")
def active_rules(spark, sf_dir):
    return enrich.active_rules(rules(spark)).select("rule_id", "k")
