"""Queries of what of a reading is shown, of labels by locale, and of sponsored marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.functions import gates as G
from feedweave.functions import text as T
from feedweave.operators import marks
from feedweave.plans.catalog import _table, query
from feedweave.plans.views import view

WORDS = {"fallback": "What are the main sources or evidence for {topic}?", "image": "Is this image AI-generated or template material?"}
SHOWS = f"(?i){G.TEXT_EVIDENCE}"


@query(f"""select doc_id, not filtered and coalesce(text_ai >= 0.7, false) and reason is not null and not (regexp_matches(post_text, '(?i){G.AI_TOPIC}') and not regexp_matches(post_text, '{SHOWS}')
    and (regexp_matches(post_text, '{G.PERSONAL}') or coalesce(regexp_matches(summary, '{G.PERSONAL_SUMMARY}'), false)) and not regexp_matches(sentence, '(?i){G.TEXT_STYLE}')) as text_chip,
  not filtered and coalesce(image_ai >= 0.7, false) and regexp_matches(regexp_replace(trim(concat(coalesce(summary, ''), ' ', coalesce(insight, ''))), '{G.NOT_GENERATED}', '', 'g'), '(?i){G.IMAGE_EVIDENCE}') as image_chip
  from (select *, case when regexp_matches(reason, '^[^\\n]{{1,90}}?[。！？!?]') then regexp_extract(reason, '^[^\\n]{{1,90}}?[。！？!?]') else left(reason, 90) end as sentence from (
    select *, coalesce(case when regexp_matches(explanation, '{SHOWS}') then explanation end, case when regexp_matches(summary, '{SHOWS}') then summary end) as reason from readings_v))""", "readings_v")
def ai_chips(spark, sf_dir):
    """Which posts show a chip for generated text or images."""
    d = F.struct("filtered", "text_ai", "image_ai", "explanation", "summary", F.array("insight").alias("insights"), "post_text")
    chips = view(spark, sf_dir, "readings_v").select("doc_id", G.ai_chips(d).alias("chips"))
    has = lambda kind: F.exists("chips", lambda x: x["kind"] == kind).alias(f"{kind}_chip")
    return chips.select("doc_id", has("text"), has("image"))


ACTS = "regexp_matches({0}, '(?i)GitHub|API|docs?|source|repo|SDK|CLI|arXiv|benchmark') and not regexp_matches(context, '低風險')"


@query(f"""select doc_id, case when worthy and image then case when q <> '' then q else 'Is this image AI-generated or template material?' end when regexp_matches(shown, '{G.LOW_ACTION}') then ''
    when worthy then case when q <> '' then q when lookup or risky then coalesce(own, '') else '' end when q = '' then case when lookup then coalesce(own, '') else '' end
    when q1 is not null and not low and {ACTS.format("q1 || ' ' || context")} then q1 when q2 is not null and {ACTS.format("q2 || ' ' || context")} then q2 else '' end as questions from (
  select *, concat_ws('|', case when not low then q1 end, q2) as q, regexp_matches(shown, '{G.WORTHY}') and not regexp_matches(shown, '{G.NOT_WORTHY}') as lookup,
    case when asked is not null and not regexp_matches(asked, '{G.LOW_VALUE}') then trim(asked) when length(topic) >= 4 then 'What are the main sources or evidence for ' || topic || '?' end as own from (
    select *, coalesce(regexp_matches(q1, '{G.LOW_VALUE}'), false) as low, has_media and image_ai >= 0.8 as image, row1 || case when row1 <> '' then ' x' else 'x' end || ' ' || note as shown, concat_ws(' ', note, summary, text) as context,
      regexp_replace(regexp_replace(case when summary <> '' then summary else row1 || case when row1 <> '' then ' x' else 'x' end end, '^待確認：', ''), '[。！？!?；;：:]+\\z', '') as topic from briefs_v))""", "briefs_v")
def visible_questions(spark, sf_dir):
    """The questions of each brief that are shown."""
    b = view(spark, sf_dir, "briefs_v")
    item = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("q"), F.lit("context").alias("kind")))
    row = F.array(F.concat("row1", F.when(F.col("row1") != "", " x").otherwise("x")))
    brief = F.struct(row.alias("rows"), "note", F.array_compact(F.array(item("q1"), item("q2"))).alias("questions"), F.array_compact(F.array("asked")).alias("asked"), "summary", F.lit("").alias("short"), "text", "has_media", "image_ai", "worthy", "risky")
    return b.select("doc_id", F.array_join(F.transform(G.visible_questions(brief, WORDS), lambda x: x["q"]), "|").alias("questions"))


@query(f"""select doc_id, case when locale = 'zh_TW' then 'zh_TW' when locale[1:2] in ('ja', 'en') then locale[1:2] else 'en' end as locale, {' or '.join(f"contains(t, '{x}')" for x in G.ALL_SPONSORED)} as sponsored, {' or '.join(f"contains(t, '{x}')" for x in G.ALL_SUGGESTED)} as suggested,
  case when locale = 'zh_TW' then 2 when locale like 'ja%' then 3 else 2 end as labels from (select *, text || label as t from widths_v)""", "widths_v")
def locale_labels(spark, sf_dir):
    """Labels of all locales in texts, and the locale that serves each reader."""
    t = F.concat("text", "label")
    holds = lambda labels: t.rlike("|".join(labels))
    return view(spark, sf_dir, "widths_v").select("doc_id", G.locale_of(F.col("locale")).alias("locale"), holds(G.ALL_SPONSORED).alias("sponsored"), holds(G.ALL_SUGGESTED).alias("suggested"), F.size(G.labels_for(F.col("locale"), "sponsored")).alias("labels"))


@query("""select doc_id, translate(text, 'ＡＤ１２　', 'AD12 ') = text as plain, true as same from widths_v""", "widths_v")
def compatible_forms(spark, sf_dir):
    """Texts that are equal but for white space and full-width forms."""
    w, bare = view(spark, sf_dir, "widths_v"), lambda c: F.regexp_replace(T.nfkc(F.col(c)), r"\s+", "")
    return w.select("doc_id", (T.nfkc(F.col("text")) == F.col("text")).alias("plain"), (bare("wide") == bare("narrow")).alias("same"))


@query("""with l as (select user_id, event_id, event_id % 3 as inner_ from events where event_id % 4 < 2),
  a as (select *, row_number() over (partition by user_id, inner_ order by event_id) as r from l where inner_ < 2),
  b as (select user_id, min(event_id) as event_id from (select user_id, event_id from a where r > 1 union all select user_id, event_id from l where inner_ = 2) group by 1)
  select user_id as page, event_id as element, user_id || '-' || inner_ as container, false as created from a where r = 1
  union all select user_id, event_id, user_id || case when user_id % 3 > 0 then '-o' else '-new' end, user_id % 3 = 0 from b""")
def sponsored_marks(spark, sf_dir):
    """Posts that the labels of ads mark on pages of two levels, and new posts where there is none."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("element"))
    box = lambda name: F.concat_ws("-", "page", name)
    k = F.col("element") % 3
    outer = F.when(F.col("page") % 3 > 0, box(F.lit("o"))).otherwise(box(F.lit("new")))
    path = F.when(k < 2, F.array(box(k), outer)).otherwise(F.array(outer))
    elements = e.select("page", "element", F.col("element").alias("place"), F.when(F.col("element") % 4 == 0, "S s o p r n e o t d g").otherwise("x").alias("raw"), F.when(F.col("element") % 4 == 1, "Sponsored · 2h").otherwise("Sponsors").alias("visible"), path.alias("path"))
    parts = e.select("page", F.explode(F.array(*(F.struct(c.alias("container"), p.alias("path")) for c, p in ((box(F.lit(0)), F.array(outer)), (box(F.lit(1)), F.array(outer)), (outer, F.slice(F.array(outer), 1, 0)))))).alias("c")).select("page", "c.*").distinct()
    new = F.col("container").endswith("-new")
    yes, no = F.lit(True), F.lit(False)
    containers = parts.select("page", "container", F.when(~new, F.col("container")).alias("post_id"), no.alias("marked"), no.alias("mixed"), F.lit(500).alias("width"), F.when(new, 400).otherwise(4000).alias("height"), yes.alias("likes"), yes.alias("comments"), "path")
    return marks.sponsored_marks(elements, containers).select("page", "element", "container", "created")
