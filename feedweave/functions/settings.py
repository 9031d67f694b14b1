"""Stored settings made whole: aliases, defaults, forced values, patches and the sources of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.variants import flag_of, is_kind, part, text_of

# Defaults, accepted words, fields that always have one value, older names of fields.
SAME_AS_FIRST = "tier-a"
ENDPOINT_PROVIDERS = {"ollama": "http://localhost:11434", "openai-compatible": "http://localhost:8000/v1"}
DEFAULT_PROVIDER, DEFAULT_MODEL = "chrome-gemini-nano", "gemma4:e4b"
WORDS = {"themeMode": (("light", "dark", "auto"), "auto"), "language": (("en", "zh-TW", "auto"), "auto"), "markdownDownloadMode": (("directory-picker",), "browser-download"), "sponsoredDisplayMode": (("collapse",), "none")}
OFF_UNLESS_TRUE = ("collapseRightRailAdsEnabled", "collapseReelsEnabled")
FORCED = {"cacheEnabled": True, "cacheTtlDays": 1, "developerMode": False, "analysisAutoFollow": True}
ALIASES = (("tierAProvider", "cloudProvider"), ("tierBEndpoint", "vllmEndpoint"), ("tierBModel", "vllmModel"))
SHARED_FLAGS = ("tierBUseTierAEndpoint", "tierBUseTierAModel")

Reader = Callable[[str], Column]


def stored(record: Column) -> Reader:
    """The fields of a stored record; null where there is none."""
    return lambda name: part(record, f"$.{name}")


def patched(current: Reader, patch: Reader) -> Reader:
    """``current`` with a patch over it: a field under either of its names sets both, and the second provider and its two flags follow each other."""
    has = lambda name: patch(name).isNotNull()  # noqa: E731  a null that is stated is there
    first, second = SHARED_FLAGS
    true, false = F.parse_json(F.lit("true")), F.parse_json(F.lit("false"))

    def stated(name: str) -> Column:
        """A flag of the patch, or the current one where the patch has none or null."""
        return F.coalesce(F.when(is_kind(patch(name), "VOID"), None).otherwise(patch(name)), current(name))

    def get(name: str) -> Column:
        other = next((b if name == a else a for a, b in ALIASES if name in (a, b)), None)
        value = F.when(has(name), patch(name))
        if other:
            value = value.when(has(other), patch(other))
        if name in SHARED_FLAGS:
            value = F.when(has("tierBProvider"), F.when(F.coalesce(text_of(patch("tierBProvider")) == SAME_AS_FIRST, F.lit(False)), true).otherwise(false)).when(has(name), patch(name))
        if name == "tierBProvider":
            both = F.coalesce(flag_of(stated(first)), F.lit(False)) & F.coalesce(flag_of(stated(second)), F.lit(False))
            value = value.when((has(first) | has(second)) & both, F.parse_json(F.lit(f'"{SAME_AS_FIRST}"')))
        return value.otherwise(current(name))

    return get


def first_provider(get: Reader) -> Column:
    return F.coalesce(text_of(get("tierAProvider")), text_of(get("cloudProvider")), F.lit(DEFAULT_PROVIDER))


def second_provider(get: Reader) -> Column:
    """The provider named, else the first one's if a flag says so, else one by endpoint if an endpoint is stated, else the default."""
    named, said = text_of(get("tierBProvider")), lambda name: F.coalesce(F.trim(text_of(get(name))) != "", F.lit(False))
    shares = [F.coalesce(flag_of(get(f)), F.lit(False)) for f in SHARED_FLAGS]
    return F.when(F.coalesce(named != "", F.lit(False)), named).when(shares[0] | shares[1], SAME_AS_FIRST).when(said("tierBEndpoint") | said("vllmEndpoint"), "openai-compatible").otherwise(DEFAULT_PROVIDER)


def normalized(get: Reader) -> Column:
    """A struct of the settings that count, whatever was stored; values of another type than the field's are as good as none."""
    second = second_provider(get)
    endpoint = F.coalesce(text_of(get("tierBEndpoint")), text_of(get("vllmEndpoint")), F.lit(""))
    model = F.coalesce(text_of(get("tierBModel")), text_of(get("vllmModel")), F.lit(DEFAULT_MODEL))
    words = [F.when(text_of(get(name)).isin(*accepted), text_of(get(name))).otherwise(default).alias(name) for name, (accepted, default) in WORDS.items()]
    return F.struct(
        *words, first_provider(get).alias("tierAProvider"), first_provider(get).alias("cloudProvider"), second.alias("tierBProvider"),
        *(F.coalesce(flag_of(get(n)), F.lit(False)).alias(n) for n in OFF_UNLESS_TRUE), *(F.lit(v).alias(n) for n, v in FORCED.items()),
        *(F.when(second == SAME_AS_FIRST, True).otherwise(F.coalesce(flag_of(get(n)), F.lit(False))).alias(n) for n in SHARED_FLAGS),
        endpoint.alias("tierBEndpoint"), endpoint.alias("vllmEndpoint"), model.alias("tierBModel"), model.alias("vllmModel"),
    )


def replaced(get: Reader) -> Column:
    """The names of the fields that were stored with a value which doesn't stand, in alphabetical order."""
    own = normalized(get)
    names = sorted([*WORDS, *OFF_UNLESS_TRUE, *FORCED, *SHARED_FLAGS, *(n for pair in ALIASES for n in pair), "tierBProvider"])
    text = lambda n: F.coalesce(text_of(get(n)), flag_of(get(n)).cast("string"), part(get(n), "$", "double").cast("bigint").cast("string"))
    differs = lambda n: get(n).isNotNull() & ~F.coalesce((text(n) == own[n].cast("string")) & (is_kind(get(n), "STRING") == F.lit(n not in (*OFF_UNLESS_TRUE, *FORCED, *SHARED_FLAGS))), F.lit(False))
    return F.array_compact(F.array(*(F.when(differs(n), n) for n in names)))


def effective(get: Reader, endpoint: Column, model: Column) -> Column:
    """Provider, endpoint and model that the second stage runs with, the first one's being ``endpoint`` and ``model``."""
    second, first, own = second_provider(get), first_provider(get), normalized(get)
    shares = second == SAME_AS_FIRST
    at = F.when(shares, F.trim(F.coalesce(endpoint, F.lit("")))).when(second.isin(*ENDPOINT_PROVIDERS), F.trim(own["tierBEndpoint"])).otherwise("")
    runs = F.when(second == DEFAULT_PROVIDER, DEFAULT_PROVIDER).when(shares, F.trim(F.coalesce(model, F.lit("")))).otherwise(F.trim(own["tierBModel"]))
    return F.struct(F.when(shares, first).otherwise(second).alias("provider"), at.alias("endpoint"), runs.alias("model"))


def provider_configs(record: Column) -> Column:
    """The map of endpoint and model by provider: only providers with an endpoint, only entries that are records, texts trimmed, anything else empty."""
    word = lambda v: F.trim(F.coalesce(text_of(v), F.lit("")))
    entries = [F.when(is_kind(part(record, f"$['{p}']"), "OBJECT", "ARRAY"), F.struct(F.lit(p).alias("k"), F.struct(word(part(record, f"$['{p}'].endpoint")).alias("endpoint"), word(part(record, f"$['{p}'].model")).alias("model")).alias("v"))) for p in ENDPOINT_PROVIDERS]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def config_or_default(configs: Column, provider: Column) -> Column:
    """A provider's endpoint and model, empty ones replaced by its defaults."""
    own = F.try_element_at(configs, provider)
    default = F.lit("")
    for p, url in ENDPOINT_PROVIDERS.items():
        default = F.when(provider == p, url).otherwise(default)
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    return F.struct(filled(own["endpoint"], default).alias("endpoint"), filled(own["model"], F.lit(DEFAULT_MODEL)).alias("model"))


def is_message(value: Column) -> Column:
    """Whether a value is a message: a record whose type is a text."""
    return is_kind(value, "OBJECT") & is_kind(part(value, "$.type"), "STRING")
