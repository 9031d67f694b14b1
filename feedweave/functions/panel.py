"""Expressions of the reading panel: names, endpoints, durations, policies, briefs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import text as T

# What a question must mention to be worth acting on, what silences it, and question kinds.
ACTIONABLE = "GitHub|原始碼|官方(?:文件|公告|資料|網站|說明|repo)|文件|文檔|repo|repository|source|docs?|API|SDK|CLI|安裝|版本|規格|論文|研究|arXiv|benchmark|模型卡|法規|規定|資格|申請|許可|證照|駕照|牌照|限制"
LOW_RISK = "低風險|無需(?:事實)?查核|無查核必要|無事實(?:查核)?需求|無事實風險"
RISK_LEVELS = {"high": 0.9, "medium": 0.55, "low": 0.2}


def identity(c: Column) -> Column:
    """A display name up to its first separator, marks of verification off."""
    return T.squeeze(F.regexp_replace(F.regexp_extract(c, "^[^·•─✓]*", 0), r"(?i)\b(verified account|follow|join)\b", ""))


def without_author(c: Column, author: Column) -> Column:
    """A leading author name off, if a separator or the end follows it."""
    rest = F.substring(c, F.length(author) + 1, F.length(c))
    fits = c.startswith(author) & (F.length(author) > 0) & ((rest == "") | F.left(rest, F.lit(1)).isin(" ", "·", "•", ":", "："))
    return F.when(fits, F.regexp_replace(rest, r"^[\s·•:：]+", "")).otherwise(c)


def duration(ms: Column) -> Column:
    """`<1ms`, whole milliseconds below a second, tenths of seconds from there."""
    tenths = F.floor(ms / 100 + 0.5).cast("long")
    return F.when(ms < 1, "<1ms").when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))


def endpoint(c: Column) -> Column:
    """An endpoint without trailing slashes and version."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+\z", ""), r"/+\z", ""), r"/v1\z", "")


def endpoint_problem(c: Column) -> Column:
    return F.when(~c.rlike("(?i)^https?://"), "scheme").when(c.rlike("(?i)[?&](key|token|api_key)="), "secret").when(c.rlike("(?i)^http://") & ~c.rlike(r"(?i)^http://(localhost|127\.0\.0\.1)([:/]|\z)"), "plain_http")


def is_actionable(c: Column) -> Column:
    return ~c.rlike(LOW_RISK) & c.rlike("(?i)" + ACTIONABLE)


def shares_without_comment(own: Column, shared: Column) -> Column:
    """Nothing of one's own: at most a character, or one text within the other when white space is ignored."""
    a, b = T.compact(own), T.compact(shared)
    return (b != "") & ((F.length(a) <= 1) | ((F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))))


def duplicates_own(candidate: Column, own: Column) -> Column:
    a, b = T.compact(candidate), T.compact(own)
    return (F.length(b) >= 20) & ((a == b) | F.contains(b, a) | F.contains(a, b))


def tags(items: Column) -> Column:
    """Well-formed tags: the first eight, then each once."""
    return F.array_distinct(F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^[a-z0-9_:-]{1,48}\z")), 1, 8))


def risk(level: Column) -> Column:
    """Named levels as numbers, 0 for anything else."""
    out = F.lit(0.0)
    for name, value in RISK_LEVELS.items():
        out = F.when(F.lower(level) == name, value).otherwise(out)
    return out
