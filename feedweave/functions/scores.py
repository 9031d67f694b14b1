"""Scores, decisions and parsed model responses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import text as T


def clamp(c: Column) -> Column:
    """Into [0, 1]; null for NaN and null."""
    return F.when(c.isNull() | F.isnan(c), None).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def band(c: Column) -> Column:
    return F.when(c >= 0.6, "high").when(c >= 0.3, "mid").otherwise("low")


def heuristic_commercial(sponsored: Column, kind: Column, body: Column, header: Column) -> Column:
    """Commercial score by rules, null where none fires: sponsored 1, shares none, suggested 0.9, bait 0.7, emoji 0.5."""
    return (
        F.when(sponsored, 1.0)
        .when(kind == "share_without_comment", None)
        .when(T.has_label(header, T.SUGGESTED), 0.9)
        .when(T.is_bait(body), 0.7)
        .when(T.emoji_density(body) > 0.3, 0.5)
    )


def primary_category(commercial: Column, political: Column, emotional: Column) -> Column:
    """The first category with the largest score above 0; personal never counts."""
    c, p, e = (F.coalesce(x, F.lit(0.0)) for x in (commercial, political, emotional))
    top = F.greatest(c, p, e)
    return F.when(top <= 0, None).when(c == top, "commercial").when(p == top, "political").otherwise("emotional")


FENCE = r"(?is)```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```"


def json_body(raw: Column) -> Column:
    """A strict JSON object: what the first fence holds, whatever stands around it, or else the whole response; null if that isn't one object."""
    bare = F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(raw)
    bare = F.regexp_replace(bare, r"^\s+|\s+\z", "")
    return F.when(bare.rlike(r"(?s)^\{.*\}\z"), bare)


def variant(raw: Column) -> Column:
    return F.try_parse_json(json_body(raw))


def number(v: Column, *keys: str) -> Column:
    """The first of the keys that holds a number or a boolean (1 or 0), in [0, 1]."""
    found = [F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "BOOLEAN", F.try_variant_get(v, f"$.{k}", "boolean").cast("double")).otherwise(F.try_variant_get(v, f"$.{k}", "double"))) for k in keys]
    return clamp(F.coalesce(*found))


def digit(raw: Column, k: int, n: int) -> Column:
    """The k-th of exactly n digits, as tenths; null if the response isn't n digits."""
    bare = F.regexp_replace(raw, r"^\s+|\s+\z", "")
    return F.when(bare.rlike(rf"^[0-9]{{{n}}}\z"), F.substring(bare, k, 1).cast("double") / 10)


def severity(top: Column, rule_hits: Column) -> Column:
    return F.when((top >= 0.8) | (rule_hits >= 1), "high").when(top >= 0.5, "mid").otherwise("low")


def fact_check(risk: Column, needed: Column) -> Column:
    return F.greatest(F.coalesce(risk, F.lit(0.0)), F.when(F.coalesce(needed, F.lit(False)), 0.85).otherwise(0.0))


def listed(candidates: list[tuple[str, Column, Column]], n: int = 2) -> Column:
    """The n candidates (name, score, condition) with the highest scores as structs (s: the score negated, k: place, name); ties in the given order."""
    rows = F.array(*(F.when(F.coalesce(on, F.lit(False)), F.struct((-score).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, score, on) in enumerate(candidates)))
    return F.slice(F.array_sort(F.array_compact(rows)), 1, n)


def shown_ai(text_ai: Column, image_ai: Column) -> Column:
    """The larger of the likelihoods that are high enough to be shown; null if neither is."""
    shown = lambda c: F.when(c >= 0.7, c)
    return F.greatest(shown(text_ai), shown(image_ai))


def headline_signals(d: dict[str, Column]) -> dict[str, Column]:
    """Severity, the two leading signals of the fast and of the deep scores, and whether a post is shown as personal.

    A fast emotional signal gives way to a stronger deep one of manipulation; a deep signal that the fast ones name isn't named again.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ai, fact = zero(shown_ai(d["text_ai"], d["image_ai"])), fact_check(d["factual_risk"], d["needs_fact_check"])
    emotional, manipulation, low = zero(d["emotional"]), zero(d["manipulation"]), zero(d["low_quality"])
    intent = F.greatest(zero(d["commercial"]), zero(d["deep_commercial"]))
    ruled, thin = d["rule_hits"] >= 1, d["insufficient"]
    deep = listed([
        ("commercial", zero(d["deep_commercial"]), d["deep_commercial"] >= 0.75), ("fact_check", fact, fact >= 0.7), ("ai", ai, ai >= 0.8), ("low_quality", low, low >= 0.5), ("ragebait", manipulation, manipulation >= 0.8),
    ])
    suppressor = -F.coalesce(F.array_min(F.transform(F.filter(deep, lambda x: x["name"] == "ragebait"), lambda x: x["s"])), F.lit(0.0))
    fast = listed([
        ("commercial", zero(d["commercial"]), d["commercial"] >= 0.75), ("political", zero(d["political"]), d["political"] >= 0.5),
        ("emotional_strong", emotional, (emotional >= 0.75) & (emotional >= suppressor)), ("emotional", emotional, (emotional >= 0.5) & (emotional < 0.75) & (emotional >= suppressor)),
        ("rule", F.lit(0.85), ruled), ("insufficient", F.lit(0.5), thin),
    ])
    names = lambda c: F.transform(c, lambda x: x["name"])
    top = F.greatest(intent, zero(d["political"]), emotional, ai, low, fact, manipulation, F.when(thin, 0.5).otherwise(0.0))
    return {
        "severity": severity(top, d["rule_hits"]), "fast": F.array_join(names(fast), ","), "deep": F.array_join(F.array_except(names(deep), names(fast)), ","),
        "personal_context": ~d["is_sponsored"] & (zero(d["personal"]) >= 0.7) & (intent < 0.75) & (low < 0.5) & (fact < 0.7) & (manipulation < 0.5),
    }
