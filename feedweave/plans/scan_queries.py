"""Queries of scans over whole files and pages and of what is written out: boundary violations, images, secrets, canonical JSON, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import boundary, export
from feedweave.plans.catalog import _table, query
from feedweave.plans.views import view
from feedweave.sources import images


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ABOVE = "len(list_filter(range(1, len(m) + 1), lambda i: list_sum(m[1:i]) + depth < 0)) > 0"
MOVES = "list_transform(string_split(r, '/'), lambda s: case when s in ('', '.') then 0 when s = '..' then -1 else 1 end)"
CONTENT = " union all ".join(f"select path, line, {literal(f'forbidden content ({label})')} as finding from lines where " + " or ".join(f"regexp_matches(text, {literal(p)})" for other, _, p in boundary.CONTENT if other == label) for label in dict.fromkeys(x for x, _, _ in boundary.CONTENT))


@query(f"""select * from (with lines as (select path, i::int as line, t[i] as text from (select path, string_split(content, chr(10)) as t from files_v where kind = 'file'), lateral (select unnest(range(1, len(t) + 1)) as i))
  select path, null::int as line, 'symlink is not allowed' as finding from files_v where kind = 'symlink'
  union all {" union all ".join(f"select path, null, {literal(f'denied path ({label})')} from files_v where kind <> 'symlink' and regexp_matches(path, {literal(p)})" for label, p in boundary.DENIED)}
  union all {CONTENT} union all select path, line, {literal(f"forbidden content ({boundary.PARENT_LABEL})")} from (
    select path, line, len(string_split(path, '/')) - 1 as depth, unnest(regexp_extract_all(text, {literal(boundary.PARENT)}, 1)) as r from lines where not regexp_matches(path, {literal(boundary.EXEMPT)}))
    where len(list_filter([{MOVES}], lambda m: {ABOVE})) > 0 group by path, line)""", "files_v")
def boundary_violations(spark, sf_dir):
    """Files and lines that must not be published, over whole contents."""
    return boundary.violations(view(spark, sf_dir, "files_v"))


TAG = r"""<{0}(?:\s(?:[^>"'']|"[^"]*"|''[^'']*'')*)?>"""
PLAIN = "replace(replace(replace({0}, '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"


def sql_attribute(name: str) -> str:
    raw = rf"""regexp_extract(t, '(?is)\s{name}\s*=\s*("([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1)"""
    return PLAIN.format(f"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")


SIZE = "coalesce(try_cast(regexp_extract({0}, '^\\d+') as int), 0)"
SRCSET = "list_transform(list_filter(string_split_regex({0}, ',\\s+'), lambda p: trim(p) <> ''), lambda p: {{'size': coalesce(try_cast(regexp_extract(trim(p), '\\s([0-9.]+)[wx]$', 1) as double), 1), 'url': regexp_extract(trim(p), '^\\S+')}})".format(sql_attribute("srcset"))
IMAGES = f"""select page_id, place, kind, src, role, width, height from (
  select page_id, (row_number() over (partition by page_id order by grp, i, j) - 1)::int as place, kind, src, role, width, height from (
    select page_id, 1 as grp, i, 0 as j, 'img' as kind, coalesce(list_max({SRCSET}).url, {sql_attribute("src")}) as src, {sql_attribute("data-imgperflogname")} as role, {SIZE.format(sql_attribute("width"))} as width, {SIZE.format(sql_attribute("height"))} as height
      from (select page_id, i, t[i] as t from (select page_id, regexp_extract_all(html, '(?i){TAG.format("img")}') as t from pictured_v), lateral (select unnest(range(1, len(t) + 1)) as i))
    union all select page_id, 2, i, 0, 'video-poster', {sql_attribute("poster")}, '', {SIZE.format(sql_attribute("width"))}, {SIZE.format(sql_attribute("height"))}
      from (select page_id, i, t[i] as t from (select page_id, regexp_extract_all(html, '(?i){TAG.format("video")}') as t from pictured_v), lateral (select unnest(range(1, len(t) + 1)) as i))
    union all select page_id, 3, i, j, 'background-image', trim(u[j]), '', {SIZE.format(sql_attribute("width"))}, {SIZE.format(sql_attribute("height"))}
      from (select page_id, i, t[i] as t, regexp_extract_all({sql_attribute("style").replace("(t,", "(t[i],")}, '(?i)background(?:-image)?\\s*:[^;]*?url\\(\\s*["'']?(.*?)["'']?\\s*\\)', 1) as u
        from (select page_id, regexp_extract_all(html, '(?i){TAG.format("(?:div|span|a)")}') as t from pictured_v), lateral (select unnest(range(1, len(t) + 1)) as i)), lateral (select unnest(range(1, len(u) + 1)) as j)))"""


@query(IMAGES, "pictured_v")
def image_candidates(spark, sf_dir):
    return images.candidates(view(spark, sf_dir, "pictured_v"))


@query(f"""with fit as (select page_id, src, min(place) as place, starts_with(src, 'data:') or regexp_matches(src, '^[A-Za-z][A-Za-z0-9+.-]*:') and (regexp_matches(src, '(?i)^[^?#]*[.]gif([?#]|$)') or regexp_matches(src, '[?&]_nc_video=1(&|#|$)')) as unsafe
    from ({IMAGES}) where src <> '' and not regexp_matches(src, '{images.STATIC}') and role in ('', {", ".join(map(repr, images.ROLES))}) and not (width > 0 and height > 0 and (width < 100 or height < 100)) group by 1, 2),
  kept as (select * from (select *, coalesce(sum(case when unsafe then 0 else 1 end) over (partition by page_id order by place rows between unbounded preceding and 1 preceding), 0) as before from fit) where before < 4)
  select p.page_id, coalesce(list(src order by place) filter (not unsafe), []) as urls, coalesce(count(*) filter (unsafe), 0)::int as n_filtered from pages p left join kept using (page_id) group by 1""".replace("with fit as", "select page_id, array_to_string(urls, '|') as urls, n_filtered from (with fit as", 1) + ")", "pictured_v")
def images_chosen(spark, sf_dir):
    """The first four images of content of each page, and how many that can't be looked at came before."""
    return images.chosen(view(spark, sf_dir, "pictured_v")).withColumn("urls", F.array_join("urls", "|"))


@query("""select event_id, regexp_replace(body, '(?i)("[^"]*api[-_]?key":)("[^"]*"|[0-9]+|true|false|null)', '\\1"[redacted]"', 'g') as body from settings_v""", "settings_v")
def secrets_redacted(spark, sf_dir):
    """Settings without what stands under the names of secrets, at any depth; names that only look alike keep their values."""
    return view(spark, sf_dir, "settings_v").select("event_id", export.redacted_json(F.col("body")).alias("body"))


@query("""select event_id, concat('{"A":', floor(event_id / 4)::bigint, case event_id % 4 when 1 then '.25' when 2 then '.5' when 3 then '.75' else '' end, ',"a":[{"b":null,"c":"', event_type, '"},[],{}],"b":{"y":{"k":1e+21,"l":[true,false]},"z":"é😀"},"ä":1e-7}') as canonical from events""")
def canonical_texts(spark, sf_dir):
    """Equal values written in different ways give one text."""
    i = F.col("event_id")
    number = F.format_string("%.2f", i / 4)
    a = F.concat(F.lit('{ "ä" : 0.0000001, "b": {"z":"\\u00e9😀","y":{"l":[true, false],"k":1000000000000000000000}}, "a":[{"c":"'), "event_type", F.lit('","b":null},[],{}], "A":'), number, F.lit("}"))
    b = F.concat(F.lit('{"a":[{"b":null,"c":"'), "event_type", F.lit('"},[ ],{ }],"A":'), F.format_string("%.4f", i / 4), F.lit(',"b":{"y":{"k":1e21,"l":[true,false]},"z":"é\\ud83d\\ude00"},"ä":1E-7}'))
    return _table(spark, sf_dir, "events").select("event_id", export.canonical_json(F.when(i % 2 == 0, a).otherwise(b)).alias("canonical"))


@query("""select tab, concat('{"build":"b1","at":"2024-01-01T00:00:00Z","storage":', to_json(coalesce(storage, '{}'))::varchar, ',"logs":', to_json(coalesce(logs, []))::varchar, ',"events":', to_json(coalesce(events, []))::varchar, '}') as report from (
    select tab, list({'component': component, 'entries': entries} order by component) as logs from (select user_id % 23 as tab, event_type as component, list(concat(event_type, ' ', event_id) order by event_id) as entries from events where user_id % 23 <> 5 group by 1, 2) group by 1) a
  full join (select user_id % 23 as tab, list(event_id order by event_id desc) as events from events where user_id % 23 <> 7 group by 1) b using (tab)
  full join (select user_id % 23 as tab, max(concat('{"user":"', user_id % 23, '","apiKey":"[redacted]","n":{"x_api_key":"[redacted]"}}')) as storage from events where user_id % 23 < 20 group by 1) c using (tab)""")
def debug_reports(spark, sf_dir):
    """A report for each tab: its log lines by component, its settings without secrets, its newest events first."""
    e = _table(spark, sf_dir, "events").withColumn("tab", F.col("user_id") % 23)
    logs = e.where("tab <> 5").select("tab", F.col("event_type").alias("component"), F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", "event_id").alias("entry"))
    body = F.concat(F.lit('{"user":"'), F.col("tab").cast("string"), F.lit('","apiKey":"s","n":{"x_api_key":"t"}}'))
    events = e.where("tab <> 7").select("tab", F.col("event_id").alias("seq"), F.col("event_id").alias("event"))
    return export.snapshot(logs, e.where("tab < 20").select("tab", body.alias("body")).distinct(), events, "b1", "2024-01-01T00:00:00Z")
