"""Latest rows, last-N histories, buffers, fallbacks and field-wise merges over event logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text as T

RANK = {"likely_truncated": 1, "visible_complete": 2, "expanded_or_upgraded": 3}


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a pre-aggregated maximum, no sort of a key's rows."""
    cols = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("m")).select(key, f"m.{order}", *(f"m.{c}" for c in cols))


def last_n(events: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """The last n rows of each key with their place, 1 the latest; Spark limits each task's share before the shuffle."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("place") <= n)


def ring(events: DataFrame, key: str, order: str, size: int = 300) -> DataFrame:
    """A buffer that overwrites a key in place and drops the keys first seen earliest: exact while no dropped key returns."""
    rows = events.groupBy(key).agg(F.min(order).alias("first_seq"), F.max(order).alias("last_seq"))
    return rows.orderBy(F.desc("first_seq"), F.desc(key)).limit(size)


def fallback(events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """One row: the newest key that is neither sponsored nor filtered, else the newest unfiltered, else the newest; ties to the later."""
    tier = F.when(~F.col("filtered") & ~F.col("is_sponsored"), 2).when(~F.col("filtered"), 1).otherwise(0)
    return events.agg(F.max(F.struct(tier.alias("tier"), time, order, key)).alias("m")).select(f"m.{key}", F.col("m.tier").alias("tier"), f"m.{order}")


def progressive(events: DataFrame, key: str, order: str) -> DataFrame:
    """Field by field the last value that says something: empty texts and null names never erase earlier ones."""
    filled = lambda c: F.max(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct(order, c)))[c]
    rank = F.max(F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))[F.col("completeness")])
    return events.groupBy(key).agg(filled("text").alias("text"), filled("author_name").alias("author_name"), rank.alias("completeness_rank"), F.max("is_sponsored").alias("ever_sponsored"), F.count("*").alias("n_events"))


def carried(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Every event with the last value known by then."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(key, order, F.last(value, ignorenulls=True).over(w).alias(f"carried_{value}"))


def fresh(cache: DataFrame, key: str, order: str, time: str, ttl: str, most: int = 500) -> DataFrame:
    """A cache as it is after loading: the last entry of each key, no older than ``ttl`` before the newest, at most 500."""
    last = cache.groupBy(key).agg(F.max(F.struct(order, time)).alias("m")).select(key, f"m.{order}", f"m.{time}")
    now = cache.agg(F.max(time).alias("now"))
    return last.join(F.broadcast(now), F.expr(f"{time} > now - interval {ttl}")).orderBy(F.desc(time), F.desc(order)).limit(most).drop("now")


def sessions(events: DataFrame, key: str, time: str, order: str, gap_seconds: int) -> DataFrame:
    """Gaps and islands: per key the runs of events no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(time, order)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    new = (seconds - F.lag(seconds).over(w) > gap_seconds) | F.lag(seconds).over(w).isNull()
    runs = events.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.count("*").alias("n"), F.min(time).alias("began"), F.max(time).alias("ended"))


def debounced(events: DataFrame, key: str, time: str, order: str, quiet_seconds: int) -> DataFrame:
    """The events that no other event of the key follows within the quiet time."""
    w = Window.partitionBy(key).orderBy(time, order)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000
    gap = F.lead(seconds).over(w) - seconds
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= quiet_seconds)).drop("gap")


def health(ticks: DataFrame, key: str, time: str, order: str, grace_seconds: int = 20) -> DataFrame:
    """``ticks(path, emitted, has_main)`` of each key with its state of health since the path last changed: healthy, unhealthy or unknown."""
    w = Window.partitionBy(key).orderBy(time, order)
    moved = F.when(F.col("path") == F.lag("path").over(w), 0).otherwise(1)
    runs = ticks.withColumn("moved", moved).withColumn("run", F.sum("moved").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(key, "run").orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    waited = F.unix_micros(F.col(time).cast("timestamp")) - F.min(F.unix_micros(F.col(time).cast("timestamp"))).over(r)
    quiet = (waited < grace_seconds * 1_000_000) | ~F.col("has_main") | ~T.is_feed_like(F.col("path"))
    return runs.select(key, order, F.when(F.bool_or("emitted").over(r), "healthy").when(quiet, "unknown").otherwise("unhealthy").alias("health"))


def lru(accesses: DataFrame, key: str, order: str, size: int = 500) -> DataFrame:
    """What a cache of ``size`` entries that drops the least recently used holds in the end: the keys accessed last."""
    return accesses.groupBy(key).agg(F.max(order).alias(order)).orderBy(F.desc(order)).limit(size)


def folded(events: DataFrame, key: str, order: str, start: tuple, step: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    """Each event with the state that ``step(state, row)`` makes of it and the key's state before it; ``fields`` name and type the state.

    Events come sorted by key and order, so a task holds one key's state, never its events; a key's events must meet in one task,
    as each depends on the one before.
    """
    types = dict(events.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                own = getattr(row, key)
                if own != now:
                    now, state = own, start
                state = step(state, row)
                rows.append((own, getattr(row, order), *state))
            yield pd.DataFrame(rows, columns=[key, order, *(n for n, _ in fields)]).astype({n: "object" for n, _ in fields})

    schema = ", ".join([f"{key} {types[key]}", f"{order} {types[order]}", *(f"{n} {t}" for n, t in fields)])
    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def ingested(events: DataFrame) -> DataFrame:
    """``events(post_id, seq, text, deep_lang, deep, brief, pending)`` folded into ``text, brief, stale, pending`` after each event.

    An empty text keeps the one before.  An event with a brief or a pending one of its own stands; else the state's is carried on,
    unless the analysis is in another language than the brief; if text or analysis changed, the brief is stale and nothing pends.
    """

    def step(state: tuple, row) -> tuple:
        text, brief, stale, pending, deep = state
        missing = lambda v: None if pd.isna(v) else v
        lang, own, own_deep = missing(row.deep_lang), missing(row.brief), (missing(row.deep), missing(row.deep_lang))
        new = row.text or text
        if deep is None or own is not None or row.pending:
            return new, own, False, bool(row.pending), own_deep
        if (brief is None and not pending) or (brief is not None and lang is not None and brief != lang):
            return new, None, False, False, own_deep
        if new != text or own_deep != deep:
            return new, brief, brief is not None, False, own_deep
        return new, brief, stale, pending, own_deep

    found = folded(events, "post_id", "seq", ("", None, False, False, None), lambda s, r: step(s, r), [("text", "string"), ("brief", "string"), ("stale", "boolean"), ("pending", "boolean"), ("deep", "array<string>")])
    return found.drop("deep")


def held(events: DataFrame, hold: int) -> DataFrame:
    """``events(user_id, seq, post_id, tick, follow, manual)`` with whether the post is shown, and which one is then.

    Nothing is shown unless the panel follows; while a post chosen by hand is held, for ``hold`` after the choice, no other is.
    """

    def step(state: tuple, row) -> tuple:
        _, current, until = state
        blocked = row.tick < until and current is not None and current != row.post_id
        moves = bool(row.follow) and not blocked
        return moves and current != row.post_id, row.post_id if moves else current, row.tick + hold if row.manual else until

    found = folded(events, "user_id", "seq", (False, None, 0), step, [("accepted", "boolean"), ("current", "long"), ("until", "long")])
    return found.drop("until")
