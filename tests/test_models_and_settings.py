"""Settings, patches, provider maps and prompts on edge cases."""

import json

from pyspark.sql import functions as F

from feedweave.functions import prompts, settings
from feedweave.functions import text as T


def rows(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, current string, patch string").withColumns({n: F.try_parse_json(n) for n in ("current", "patch")})


def results(df, column):
    return [json.loads(r["r"]) for r in df.select("i", F.to_json(column).alias("r")).orderBy("i").collect()]


def test_settings_made_whole(spark):
    cases = ["{}", None, "[1]", '{"cloudProvider":"ollama","themeMode":"dark","language":5,"cacheEnabled":false,"collapseReelsEnabled":1}', '{"tierAProvider":"x","cloudProvider":"y","tierBUseTierAModel":true,"vllmEndpoint":" e "}', '{"vllmEndpoint":" e ","vllmModel":"m","tierBModel":"n"}', '{"tierBProvider":"tier-a","tierBUseTierAEndpoint":false}']
    df = rows(spark, *((c, None) for c in cases))
    found = results(df, settings.normalized(settings.stored(F.col("current"))))
    plain = found[0]
    assert plain["themeMode"] == "auto" and plain["tierAProvider"] == plain["tierBProvider"] == "chrome-gemini-nano" and plain["cacheEnabled"] is True and plain["tierBModel"] == plain["vllmModel"] == "gemma4:e4b" and found[1] == found[2] == plain
    assert (found[3]["tierAProvider"], found[3]["cloudProvider"], found[3]["themeMode"], found[3]["language"], found[3]["collapseReelsEnabled"]) == ("ollama", "ollama", "dark", "auto", False)
    assert (found[4]["tierAProvider"], found[4]["tierBProvider"], found[4]["tierBUseTierAEndpoint"], found[4]["tierBEndpoint"]) == ("x", "tier-a", True, " e ")
    assert (found[5]["tierBProvider"], found[5]["tierBModel"], found[5]["vllmModel"]) == ("openai-compatible", "n", "n") and found[6]["tierBUseTierAEndpoint"] is True
    report = df.select("i", settings.replaced(settings.stored(F.col("current"))).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in report] == [[], [], [], ["cacheEnabled", "collapseReelsEnabled", "language"], ["cloudProvider"], ["vllmModel"], ["tierBUseTierAEndpoint"]]


def test_patches(spark):
    cases = [
        ('{"tierAProvider":"a","cloudProvider":"a"}', '{"cloudProvider":"b"}', ("tierAProvider", "b")), ('{"vllmEndpoint":"old","tierBEndpoint":"old"}', '{"vllmEndpoint":"new"}', ("tierBEndpoint", "new")),
        ('{"tierBProvider":"tier-a","tierBUseTierAEndpoint":true}', '{"tierBProvider":"ollama"}', ("tierBUseTierAEndpoint", False)), ('{"tierBProvider":"ollama"}', '{"tierBProvider":"tier-a"}', ("tierBUseTierAModel", True)),
        ('{"tierBProvider":"ollama","tierBUseTierAModel":true}', '{"tierBUseTierAEndpoint":true}', ("tierBProvider", "tier-a")), ('{"tierBProvider":"ollama","tierBUseTierAModel":false}', '{"tierBUseTierAEndpoint":true}', ("tierBProvider", "ollama")),
        ('{"tierBProvider":"ollama","tierBUseTierAModel":true,"tierBUseTierAEndpoint":true}', '{"tierBUseTierAEndpoint":null}', ("tierBProvider", "tier-a")), ('{"themeMode":"dark"}', '{"themeMode":null}', ("themeMode", "auto")),
        ('{"themeMode":"dark"}', "{}", ("themeMode", "dark")), (None, '{"language":"en"}', ("language", "en")), ('{"tierBProvider":"x"}', '{"tierBProvider":"ollama","tierBUseTierAEndpoint":true}', ("tierBUseTierAEndpoint", False)),
    ]
    df = rows(spark, *((c, p) for c, p, _ in cases))
    found = results(df, settings.normalized(settings.patched(settings.stored(F.col("current")), settings.stored(F.col("patch")))))
    assert [r[n] for r, (_, _, (n, _)) in zip(found, cases)] == [v for _, _, (_, v) in cases]


def test_what_runs_and_provider_maps(spark):
    df = rows(spark, ('{"tierBProvider":"tier-a","tierAProvider":"ollama"}', None), ('{"tierBProvider":"ollama","tierBEndpoint":" http://b ","tierBModel":" m "}', None), ('{"tierBEndpoint":""}', None))
    found = results(df, settings.effective(settings.stored(F.col("current")), F.lit(" http://a "), F.lit(None).cast("string")))
    assert found == [{"provider": "ollama", "endpoint": "http://a", "model": ""}, {"provider": "ollama", "endpoint": "http://b", "model": "m"}, {"provider": "chrome-gemini-nano", "endpoint": "", "model": "chrome-gemini-nano"}]
    maps = ['{"ollama":{"endpoint":" http://o/ ","model":5},"other":{"endpoint":"x"}}', '{"ollama":"x","openai-compatible":{}}', "[]", "null", None]
    df = rows(spark, *((m, None) for m in maps))
    assert results(df, settings.provider_configs(F.col("current"))) == [{"ollama": {"endpoint": "http://o/", "model": ""}}, {"openai-compatible": {"endpoint": "", "model": ""}}, {}, {}, {}]
    own = results(df, settings.config_or_default(settings.provider_configs(F.col("current")), F.lit("ollama")))
    assert own[0] == {"endpoint": "http://o/", "model": "gemma4:e4b"} and own[1] == {"endpoint": "http://localhost:11434", "model": "gemma4:e4b"}
    messages = ['{"type":"x"}', '{"type":1}', '["type"]', "null", '{"type":null}', '"type"', None]
    assert results(rows(spark, *((m, None) for m in messages)), F.struct(settings.is_message(F.col("current")).alias("m"))) == [{"m": i == 0} for i in range(len(messages))]


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_cuts_by_units(spark):
    assert one(spark, lambda c: T.left_units(c, 4), "abcde", "ab", "", None, "ab😀c", "abc😀", "😀😀😀", "é日本語文") == ["abcd", "ab", "", None, "ab😀", "abc", "😀😀", "é日本語"]
    assert one(spark, prompts.fast, "x" * 499 + "😀", "y" * 501) == ["x" * 499, "y" * 500]


def test_prompts(spark):
    base = {"text": "own " * 200, "author_name": None, "post_type": None, "is_sponsored": False, "is_verified": None, "has_media": False, "reactions": None, "comments": "", "shares": "2 shares", "reshare_text": None, "reshare_author": None}
    shared = base | {"post_type": "reshare", "reshare_text": "r" * 500, "is_sponsored": True, "author_name": "Ann", "is_verified": True}
    kinds = ", ".join(f"{k} {'boolean' if k.startswith(('is_', 'has_')) else 'string'}" for k in base)
    df = spark.createDataFrame([tuple(base.values()), tuple(shared.values())], kinds)
    plain, share = sorted(r["p"] for r in df.select(prompts.sectioned(F.struct(*df.columns)).alias("p")).collect())[::1]
    assert plain.split("\n") == ["## 貼文資訊", "- 互動：2 shares", "", "## 貼文內容", '"""' + ("own " * 200)[:500] + '"""']
    assert share.split("\n")[1:4] == ["- 類型：轉發", "- 作者：Ann（已認證）", "- 贊助：是（Facebook 標記的付費廣告）"] and share.endswith('### 原始貼文（unknown）\n"""' + "r" * 400 + '"""') and '"""' + ("own " * 200)[:300] + '"""' in share
    rule = "array<struct<rule_id:string,prompt:string>>"
    found = spark.createDataFrame([([],), (None,), ([("a", "p?")],)], f"rules {rule}").select(prompts.rules_block(F.col("rules")).alias("b"), prompts.rules_block(F.col("rules"), True).alias("c"), prompts.fast_messages("s", [], F.lit("t"), F.col("rules")).alias("m")).collect()
    assert [r["b"] == r["c"] == "" for r in found] == [True, True, False] and found[2]["b"].endswith("\n- r1：p?") and found[2]["c"].endswith("\n第 5 碼 a: p?") and [len(r["m"]) for r in found] == [2, 2, 2]
    deep = spark.range(1).select(prompts.deep_content(F.lit("x" * 9000), F.array(*map(F.lit, "abcdef")), F.lit("2024-12-31 16:00:00").cast("timestamp"), "Asia/Taipei", F.lit(None)).alias("d")).first()["d"]
    assert [p["type"] for p in deep] == ["text"] + ["image_url"] * 4 and deep[0]["text"].endswith("\n" + "x" * 8192) and "目前年份：2025\n" in deep[0]["text"] and "2024-12-31T16:00:00.000Z" in deep[0]["text"] and "2025-01-01T00:00:00\n" in deep[0]["text"]
