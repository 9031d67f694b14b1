"""Queries of settings and of what models are asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.functions import prompts, settings
from feedweave.plans.catalog import _table, query
from feedweave.plans.views import view


def sql_text(record: str, name: str) -> str:
    return f"case when json_type({record}, '$.{name}') = 'VARCHAR' then json_extract_string({record}, '$.{name}') end"


def sql_flag(record: str, name: str) -> str:
    return f"case when json_type({record}, '$.{name}') = 'BOOLEAN' then json_extract_string({record}, '$.{name}') = 'true' end"


def sql_normalized(record: str) -> str:
    """The columns of normalised settings, from the record's text."""
    t, f = (lambda n: sql_text(record, n)), (lambda n: sql_flag(record, n))
    word = lambda n, accepted, default: f"case when {t(n)} in ({', '.join(map(repr, accepted))}) then {t(n)} else '{default}' end as \"{n}\""
    second = f"""case when {t("tierBProvider")} <> '' then {t("tierBProvider")} when coalesce({f("tierBUseTierAEndpoint")}, false) or coalesce({f("tierBUseTierAModel")}, false) then 'tier-a'
      when trim(coalesce({t("tierBEndpoint")}, '')) <> '' or trim(coalesce({t("vllmEndpoint")}, '')) <> '' then 'openai-compatible' else 'chrome-gemini-nano' end"""
    words = ", ".join(word(n, a, d) for n, (a, d) in settings.WORDS.items())
    return f"""{words}, coalesce({t("tierAProvider")}, {t("cloudProvider")}, 'chrome-gemini-nano') as first, {second} as second, coalesce({f("collapseReelsEnabled")}, false) as reels,
      {second} = 'tier-a' or coalesce({f("tierBUseTierAEndpoint")}, false) as shares_endpoint, coalesce({t("tierBEndpoint")}, {t("vllmEndpoint")}, '') as endpoint, coalesce({t("tierBModel")}, {t("vllmModel")}, 'gemma4:e4b') as model"""


def _columns(s) -> list:
    return [*(s[n].alias(n) for n in settings.WORDS), s["tierAProvider"].alias("first"), s["tierBProvider"].alias("second"), s["collapseReelsEnabled"].alias("reels"), s["tierBUseTierAEndpoint"].alias("shares_endpoint"), s["tierBEndpoint"].alias("endpoint"), s["tierBModel"].alias("model")]


@query(f"select event_id, {sql_normalized('current')} from stored_v", "stored_v")
def settings_normalized(spark, sf_dir):
    """Stored settings with aliases resolved, defaults filled in and values of a wrong type dropped."""
    rows = view(spark, sf_dir, "stored_v").withColumn("s", settings.normalized(settings.stored(F.try_parse_json("current"))))
    return rows.select("event_id", *_columns(F.col("s")))


FIELDS = ("themeMode", "language", "markdownDownloadMode", "sponsoredDisplayMode", "tierAProvider", "cloudProvider", "tierBProvider", "tierBUseTierAEndpoint", "tierBUseTierAModel", "collapseReelsEnabled", "tierBEndpoint", "vllmEndpoint", "tierBModel", "vllmModel")
HAS = "json_exists(patch, '$.{0}')"
RAW = "(case when {1} then json_extract({0}, '$.{2}') end)"


def sql_patched(name: str) -> str:
    """A field of the patched record, as JSON text or null."""
    now, new = f"json_extract(current, '$.{name}')", f"json_extract(patch, '$.{name}')"
    other = next((b if name == a else a for a, b in settings.ALIASES if name in (a, b)), None)
    stated = lambda n: f"coalesce({sql_flag('patch', n)}, case when coalesce(json_type(patch, '$.{n}'), 'NULL') = 'NULL' then {sql_flag('current', n)} end, false)"
    when = f"when {HAS.format(name)} then {new} "
    if other:
        when += f"when {HAS.format(other)} then json_extract(patch, '$.{other}') "
    if name in settings.SHARED_FLAGS:
        when = f"when {HAS.format('tierBProvider')} then (case when {sql_text('patch', 'tierBProvider')} = 'tier-a' then 'true' else 'false' end)::json " + when
    if name == "tierBProvider":
        a, b = settings.SHARED_FLAGS
        when += f"when ({HAS.format(a)} or {HAS.format(b)}) and {stated(a)} and {stated(b)} then '\"tier-a\"'::json "
    return f"case {when}else {now} end"


MERGED = "json_object(" + ", ".join(f"'{n}', {sql_patched(n)}" for n in FIELDS) + ")"


@query(f"select event_id, {sql_normalized('merged')} from (select event_id, {MERGED} as merged from stored_v)", "stored_v")
def settings_patched(spark, sf_dir):
    """Settings after a patch, whichever of a field's two names it uses."""
    rows = view(spark, sf_dir, "stored_v")
    merged = settings.patched(settings.stored(F.try_parse_json("current")), settings.stored(F.try_parse_json("patch")))
    return rows.withColumn("s", settings.normalized(merged)).select("event_id", *_columns(F.col("s")))


CONFIG = "json_extract(config, '$.\"{0}\"')"


@query(f"""select event_id, provider, case when provider in ('ollama', 'openai-compatible') then coalesce(nullif(case provider {" ".join(f"when '{p}' then trim(coalesce({sql_text(CONFIG.format(p), 'endpoint')}, ''))" for p in settings.ENDPOINT_PROVIDERS)} end, ''),
    case provider when 'ollama' then 'http://localhost:11434' else 'http://localhost:8000/v1' end) else '' end as endpoint,
  coalesce(nullif(case provider {" ".join(f"when '{p}' then trim(coalesce({sql_text(CONFIG.format(p), 'model')}, ''))" for p in settings.ENDPOINT_PROVIDERS)} end, ''), 'gemma4:e4b') as model, is_message from (
  select event_id, case when json_valid(config) then config end as config, coalesce(json_type(current) = 'OBJECT' and json_type(current, '$.type') = 'VARCHAR', false) as is_message, coalesce({sql_text("current", "tierAProvider")}, {sql_text("current", "cloudProvider")}, 'chrome-gemini-nano') as provider from stored_v)""", "stored_v")
def model_sources(spark, sf_dir):
    """Where each one's first model is reached: the configured endpoint and model of its provider, or the provider's defaults."""
    rows = view(spark, sf_dir, "stored_v").withColumn("v", F.try_parse_json("current"))
    rows = rows.withColumn("provider", settings.first_provider(settings.stored(F.col("v")))).withColumn("c", settings.config_or_default(settings.provider_configs(F.try_parse_json("config")), F.col("provider")))
    return rows.select("event_id", "provider", "c.endpoint", "c.model", settings.is_message(F.col("v")).alias("is_message"))


# Prompts ----------------------------------------------------------------------------------------------------------------

RULES = "[{'rule_id': 'r-a', 'prompt': 'Is it about food?'}, {'rule_id': 'r-b', 'prompt': 'Does it sell?'}]"
LABELS = "case post_type " + " ".join(f"when '{k}' then '{v}'" for k, v in prompts.KINDS.items()) + " else post_type end"
QUOTED = "concat(chr(34), chr(34), chr(34), {0}, chr(34), chr(34), chr(34))"


def sql_lines(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x is not null), chr(10))"


SECTIONED = sql_lines(
    "'## 貼文資訊'", f"'- 類型：' || {LABELS}", "case when author_name <> '' then '- 作者：' || author_name || case when is_verified then '（已認證）' else '' end end", "case when is_sponsored then '- 贊助：是（Facebook 標記的付費廣告）' end", "case when has_media then '- 媒體：有圖片/影片' end",
    "case when reactions <> '' or comments <> '' then '- 互動：' || array_to_string(list_filter([reactions, comments], lambda x: x <> ''), '、') end", "''", "'## 貼文內容'",
    "case when post_type = 'reshare' and reshare_text <> '' then " + sql_lines("'### 轉發者評論'", QUOTED.format("left(text, 300)"), "''", "'### 原始貼文（' || case when reshare_author <> '' then reshare_author else 'unknown' end || '）'", QUOTED.format("left(reshare_text, 400)")) + " else " + QUOTED.format("left(text, 500)") + " end",
)


@query(f"select doc_id, {SECTIONED} as prompt from asked_v", "asked_v")
def prompts_sectioned(spark, sf_dir):
    """Posts with what is known of them, shares with both texts, each within its bound."""
    rows = view(spark, sf_dir, "asked_v")
    return rows.select("doc_id", prompts.sectioned(F.struct(*rows.columns)).alias("prompt"))


BLOCK = {c: "array_to_string(list_concat([" + ", ".join(f"'{x}'" for x in head) + "], list_transform(rules, lambda r, i: " + row + ")), chr(10))" for c, head, row in ((False, prompts.RULES_HEAD, "'- r' || i || '：' || r.prompt"), (True, prompts.COMPACT_HEAD, "'第 ' || (i + 4) || ' 碼 ' || r.rule_id || ': ' || r.prompt"))}


ZEROS = """array_to_string(list_transform(range(1, len(rules) + 1), lambda i: ',"r' || i || '":0'), '')"""


@query(f"""select doc_id, 4::bigint as n, '{{"c":0.9' || {ZEROS} || '}}' as answer, left(text, 500) || case when len(rules) > 0 then {BLOCK[False]} else '' end as question,
    '9000' || repeat('0', len(rules)::int) as digits, left(text, 500) || case when len(rules) > 0 then {BLOCK[True]} else '' end as compact_question
  from (select *, case doc_id % 3 when 0 then {RULES} when 1 then {RULES}[1:1] else {RULES}[1:0] end as rules from asked_v)""", "asked_v")
def prompts_fast(spark, sf_dir):
    """The messages of the fast stage, with none, one or two rules of the user's own."""
    rule = lambda i, p: F.struct(F.lit(i).alias("rule_id"), F.lit(p).alias("prompt"))
    two = F.array(rule("r-a", "Is it about food?"), rule("r-b", "Does it sell?"))
    rows = view(spark, sf_dir, "asked_v").withColumn("rules", F.slice(two, 1, F.element_at(F.array(F.lit(2), F.lit(1), F.lit(0)), (F.col("doc_id") % 3 + 1).cast("int"))))
    rows = rows.select("doc_id", prompts.fast_messages("sys", [("post one", '{"c":0.9}')], F.col("text"), F.col("rules")).alias("m"), prompts.compact_messages("sys", [("post one", "9000")], F.col("text"), F.col("rules")).alias("c"))
    return rows.select("doc_id", F.size("m").cast("long").alias("n"), F.col("m")[2]["content"].alias("answer"), F.col("m")[3]["content"].alias("question"), F.col("c")[2]["content"].alias("digits"), F.col("c")[3]["content"].alias("compact_question"))


def sql_deep(lang: str) -> str:
    t = prompts.TIME[lang]
    stated = [t[0], *(f"{t[k]}' || {v} || '" for k, v in ((1, "utc"), (2, "local"), (3, "'Asia/Taipei'"), (4, "year(ts + interval 8 hour)"))), t[5]]
    joined = "' || chr(10) || '".join(x.replace("model's", "model''s") for x in stated)
    return f"'{joined}' || '" + prompts.ANSWER[lang].replace("\n", "' || chr(10) || '") + f"' || chr(10) || chr(10) || '{prompts.TEXT_HEAD[lang]}' || chr(10) || left(text, 8192)"


@query(f"""select doc_id, array_to_string([case when lang = 'en' then {sql_deep("en")} else {sql_deep("zh-TW")} end] || list_transform(coalesce(images, [])[1:4], lambda u: 'image ' || u), chr(30)) as content
  from (select *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as utc, strftime(ts + interval 8 hour, '%Y-%m-%dT%H:%M:%S') as local from asked_v)""", "asked_v")
def prompts_deep(spark, sf_dir):
    """The parts of the deep stage's question: time, language, the whole text within its bound, and the first images."""
    parts = prompts.deep_content(F.col("text"), F.col("images"), F.col("ts").cast("timestamp"), "Asia/Taipei", F.col("lang"))
    shown = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("image "), p["url"]))), chr(30))
    return view(spark, sf_dir, "asked_v").select("doc_id", shown.alias("content"))


LOW = "(coalesce(political, 0) >= 0.6 or coalesce(deep_commercial, commercial, 0) >= 0.6 or coalesce(text_ai, 0) >= 0.8 or coalesce(image_ai, 0) >= 0.8 or coalesce(low_quality, 0) >= 0.6 or coalesce(manipulation, 0) >= 0.6)"


@query(f"""select event_id, json_extract_string(j, '$.outputLanguage') as lang, json_extract_string(j, '$.post.text') as text, array_to_string(list_sort(json_keys(j, '$.post')), ',') as shown, json_extract_string(j, '$.temporalContext.localDateTime') as local, high, lookup, low from (
  select event_id, json_object('outputLanguage', case when event_id % 2 = 0 then 'English' else 'Taiwan Traditional Chinese' end, 'temporalContext', json_object('localDateTime', '2024-05-01T12:00:00'), 'post', json_merge_patch('{{}}', json_object('author', case when event_id % 5 > 0 then 'A' || user_id end,
      'text', case when event_id % 3 = 0 then 'said of it' else 'own words ' || event_id end, 'sharedText', case when event_id % 3 = 0 then left(repeat('shared ', 300), 1600) else '' end, 'linkPreview', '', 'imageText', [], 'imageAlt', [], 'contentKind', 'standard', 'hasMedia', has_media))) as j,
    coalesce(needs_fact_check, false) or coalesce(factual_risk, 0) >= 0.7 as high, coalesce(needs_fact_check, false) or coalesce(factual_risk, 0) >= 0.5 or {LOW} as lookup, not coalesce(needs_fact_check, false) and coalesce(factual_risk, 0) < 0.4 and not {LOW} as low from decisions_v)""", "decisions_v")
def prompts_brief(spark, sf_dir):
    """The question for a brief as a JSON record, absent values left out, read back: what is shown of the post, and its risk."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    share = i % 3 == 0
    words = F.array().cast("array<string>")
    post = F.struct(
        F.when(i % 5 > 0, F.concat(F.lit("A"), F.col("user_id").cast("string"))).alias("author"), F.concat(F.lit("own words "), i.cast("string")).alias("ownText"), F.lit("said of it").alias("sharerComment"), share.alias("isShare"),
        F.when(share, F.repeat(F.lit("shared "), F.lit(300))).otherwise("").alias("sharedContent"), F.lit("").alias("linkPreview"), words.alias("imageTexts"), words.alias("imageAltTexts"), none.alias("originalAuthor"), F.lit("standard").alias("contentKind"), F.col("has_media").alias("hasMedia"),
    )
    deep = F.struct(F.col("deep_commercial").alias("commercialIntent"), F.col("text_ai").alias("textAiLikelihood"), F.col("image_ai").alias("imageAiLikelihood"), F.col("low_quality").alias("lowQualitySignal"), F.col("factual_risk").alias("factualRisk"), F.col("manipulation").alias("manipulationRisk"), F.col("needs_fact_check").alias("needsFactCheck"))
    scores = F.struct("commercial", "political", "emotional", "personal")
    asked = prompts.brief(post, scores, deep, F.lit("2024-05-01 04:00:00").cast("timestamp"), "Asia/Taipei", F.when(i % 2 == 0, "en").otherwise("zh-TW"))
    rows = view(spark, sf_dir, "decisions_v").select("event_id", F.parse_json(F.regexp_extract(asked, r"(?s)\n(.*)", 1)).alias("j"))
    get = lambda p, kind="string": F.variant_get("j", p, kind)
    names = F.to_json(F.json_object_keys(F.to_json(get("$.post", "variant"))))
    return rows.select("event_id", get("$.outputLanguage").alias("lang"), get("$.post.text").alias("text"), F.array_join(F.array_sort(F.from_json(names, "array<string>")), ",").alias("shown"), get("$.temporalContext.localDateTime").alias("local"), get("$.riskProfile.highRisk", "boolean").alias("high"), get("$.riskProfile.lookupWorthy", "boolean").alias("lookup"), get("$.riskProfile.lowRiskPersonal", "boolean").alias("low"))
