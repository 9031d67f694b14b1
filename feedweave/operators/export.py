"""What leaves the engine: redacted settings and reports in Markdown and JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = r"(?i)(api_?key|token|secret|password)\z"


def redacted(c: Column) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET) & (F.coalesce(v, F.lit("")) != ""), F.lit("[redacted]")).otherwise(v))


def markdown(title: Column, tags: Column, body: Column) -> Column:
    """A note with front matter."""
    quoted = F.to_json(F.struct(title.alias("t")))
    return F.concat(F.lit("---\ntitle: "), F.regexp_extract(quoted, r'^\{"t":(.*)\}\z', 1), F.lit("\ntags: ["), F.array_join(tags, ", "), F.lit("]\n---\n\n# "), title, F.lit("\n\n"), body, F.lit("\n"))


SECRET_KEY = re.compile(r"api[-_]?key$", re.IGNORECASE)  # fixed value: names of fields that hold secrets
REDACTED = "[redacted]"


def without_secrets(value: object) -> object:
    """A parsed JSON value with what stands under secret names replaced, at any depth; names that only begin alike stay."""
    if isinstance(value, dict):
        return {k: REDACTED if SECRET_KEY.search(k) else without_secrets(v) for k, v in value.items()}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


def number_text(x: int | float) -> str:
    """A number as scripts write it: doubles in their shortest form, whole ones below 1e21 without a point."""
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(Decimal(repr(x))))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    power = int(exponent)
    if -7 <= power < 0:  # written out down to 1e-6, so only what is below keeps its exponent
        return f"{Decimal(repr(x)):f}" if power > -7 else f"{digits}e{power}"
    return f"{digits}e{power:+d}"


def json_text(value: object, sort: bool) -> str:
    """JSON without blanks, objects' names in their order or sorted by UTF-16 units."""
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if sort else value
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(value[k], sort)}" for k in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(json_text(v, sort) for v in value) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


def rewritten(c: Column, change: Callable[[object], object] | None, sort: bool) -> Column:
    """JSON texts parsed, changed and written again; null where a text isn't JSON.  No SQL function builds values of unknown depth, so this goes in Arrow batches."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                value = json.loads(t)
                out.append(json_text(change(value) if change else value, sort))
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    return run(c)


def redacted_json(c: Column) -> Column:
    """A settings object without its secrets, however deep they lie; anything but an object becomes an empty one."""
    return rewritten(c, lambda v: without_secrets(v) if isinstance(v, dict) else {}, False)


def canonical_json(c: Column) -> Column:
    """The one text that equal JSON values share: names sorted at every depth, no blanks, numbers in one form."""
    return rewritten(c, None, True)


def snapshot(logs: DataFrame, settings: DataFrame, events: DataFrame, build: str, at: str) -> DataFrame:
    """One JSON document per tab of what a debug report holds: its log lines by component, its settings without secrets, its newest events first.

    ``logs(tab, component, seq, entry)``, ``settings(tab, body)``, ``events(tab, seq, event)``; a tab that has only some of these has
    empty lists for the rest.
    """
    lines = logs.groupBy("tab", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda e: e["entry"]).alias("entries"))
    lines = lines.groupBy("tab").agg(F.array_sort(F.collect_list(F.struct("component", "entries"))).alias("logs"))
    newest = events.groupBy("tab").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "event")), False), lambda e: e["event"]).alias("events"))
    own = settings.groupBy("tab").agg(F.max("body").alias("body")).select("tab", F.coalesce(redacted_json(F.col("body")), F.lit("{}")).alias("storage"))
    every = lines.join(newest, "tab", "full").join(own, "tab", "full")
    kinds = dict(every.dtypes)
    filled = [F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("logs", "events")]
    return every.select("tab", F.to_json(F.struct(F.lit(build).alias("build"), F.lit(at).alias("at"), F.coalesce("storage", F.lit("{}")).alias("storage"), *filled)).alias("report"))
