"""Operators whose results depend on time passing: dwell, delay, debounce, replay and rings, with keyed state and event-time timers.

Rows of a key wait until the watermark has passed them and are then taken in the order of time and id, so the result doesn't depend on the
order of arrival.  What a key holds is the rows that still wait, at most what the watermark allows to be late, and a state of fixed or capped size.
Waits have many keys of few rows, and take them by groups of keys; replay and rings have few keys of many rows, and take them key by key.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Rows = list[tuple]
PART = 10_000  # rows handed to a step at a time
GROUPS = 1024  # groups of keys that share their calls of state; fixed for a stream's life


class InOrder(StatefulProcessor):
    """Takes a key's rows in order once they are complete, and wakes up again when the step asks for it.

    ``step(state, rows, now)`` gets the key's state, its new rows ``(us, id, …)`` in order and the watermark in microseconds; it returns the new state,
    the rows to give out, without the key, and the microsecond at which it wants to be asked again, or None.  Many rows come in parts, each with
    the time of its last row as ``now`` but the last: what is given out for one is gone before the next.
    """

    def __init__(self, columns: list[str], kinds: str, out: list[str], state: str, start: tuple, step: Callable[[tuple, Rows, int], tuple[tuple, Rows, int | None]]):
        self.columns, self.kinds, self.out, self.shape, self.start, self.step = columns, kinds, out, state, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.state = handle.getListState("waiting", self.kinds), handle.getValueState("state", self.shape)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            if len(part):
                values = [part[c].tolist() if not part[c].hasnans else [None if pd.isna(x) else x for x in part[c].tolist()] for c in self.columns]
                self.waiting.appendList(list(zip(*values)))
                latest = max(latest or 0, int(part["us"].max()))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        known = self.state.get()
        state, wake = self.start if known is None else tuple(known), None
        for at in range(0, max(len(ready), 1), PART):
            part = ready[at : at + PART]
            state, found, wake = self.step(state, part, now if at + PART >= len(ready) else part[-1][0])
            if found:
                yield pd.DataFrame([(key[0], *r) for r in found], columns=self.out)
        self.state.update(state)
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), now // 1000 + 1))

    def close(self) -> None:
        pass


class Together(InOrder):
    """The same for many keys, each of few rows: a group of keys is one call, its rows wait in packs and its states are one value.

    A call and a row of state cost far more than a step, so that keys by themselves would cost a call each and rows by themselves one more.  The one
    timer of a group stands at the earliest row or wish of its keys; when it goes off, what the watermark has passed is taken of all of them.
    """

    def __init__(self, key: str, columns: list[str], out: list[str], start: tuple, step: Callable[[tuple, Rows, int], tuple[tuple, Rows, int | None]]):
        self.columns, self.out, self.start, self.step = [key, *columns], out, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.states, self.due = handle.getListState("waiting", "rows binary"), handle.getValueState("states", "states binary"), handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                self.waiting.appendValue((pickle.dumps([column(part[c]) for c in self.columns]),))
                us = int(part["us"].min())
                first = us if first is None else min(first, us)
        if first is not None:
            self.wake(first)
        yield from ()

    def wake(self, us: int) -> None:
        """Has the group asked at ``us``, unless it will be before that."""
        at, due = -(-us // 1000), self.due.get()
        if due is None or at < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        held, kept = [pickle.loads(r[0]) for r in self.waiting.get()], self.states.get()
        known = pickle.loads(kept[0]) if kept is not None else {}  # of each key its state, and when it wants to be asked
        rows = [np.concatenate(c) for c in zip(*held)] or [np.array([], int)] * len(self.columns)
        rest = rows[1] > now
        wishes = [int(rows[1][rest].min())] if rest.any() else []
        if rest.any():
            self.waiting.put([(pickle.dumps([c[rest] for c in rows]),)])
        else:
            self.waiting.clear()
        given: Rows = []
        for k, part, until in self.asked([c[~rest] for c in rows], known, now):
            state, found, wish = self.step(known[k][0] if k in known else self.start, part, until)
            known[k] = (state, wish)
            given += [(k, *r) for r in found]
            if len(given) >= PART:
                yield pd.DataFrame(given, columns=self.out)
                given = []
        if given:
            yield pd.DataFrame(given, columns=self.out)
        self.states.update((pickle.dumps(known),))
        wishes += [wish for _, wish in known.values() if wish is not None]
        if wishes:
            self.wake(max(min(wishes), now + 1000))

    @staticmethod
    def asked(rows: list[np.ndarray], known: dict, now: int) -> Iterator[tuple]:
        """Each key with its rows in order, in parts, and the time to take them at; then the keys without rows that want to be asked by now."""
        codes, keys = pd.factorize(rows[0])
        ids = rows[2] if rows[2].dtype != object else np.array([2**63 - 1 if x is None else x for x in rows[2]])
        order = np.lexsort((ids, rows[1], codes))
        rows, keys, ends = [c[order] for c in rows[1:]], keys.tolist(), np.cumsum(np.bincount(codes, minlength=len(keys))).tolist()
        quiet = [k for k, (_, wish) in known.items() if wish is not None and wish <= now]
        for k, begin, end in zip(keys, [0, *ends], ends):
            for at in range(begin, end, PART):
                part = list(zip(*(c[at : min(at + PART, end)].tolist() for c in rows)))
                yield k, part, now if at + PART >= end else part[-1][0]
        for k in set(quiet).difference(keys):
            yield k, [], now


def column(values: pd.Series) -> np.ndarray:
    return values.to_numpy() if not values.hasnans else np.array([None if pd.isna(x) else x for x in values.tolist()], object)


def in_order(events: DataFrame, key: str, order: str, more: list[str], out: str, state: str, start: tuple, step: Callable, together: bool = False) -> DataFrame:
    """``step`` over the rows ``(us, id, *more)`` of each key; rows without a key are left out.  ``out`` is the schema of the result, the key first.

    ``together`` is for many keys of few rows each.
    """
    rows = events.withColumn("us", F.unix_micros("ts")).withColumn("oid", F.col(order).cast("long")).where(F.col(key).isNotNull())
    kinds = dict(rows.dtypes)
    columns = ["us", "oid", *more]
    if together:
        keyed = rows.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("keys_of"), key, "ts", *columns).groupBy("keys_of")
        return keyed.transformWithStateInPandas(Together(key, columns, [x.split()[0] for x in out.split(", ")], start, step), out, "append", "eventTime")
    processor = InOrder(columns, ", ".join(f"{c} {kinds[c]}" for c in columns), [x.split()[0] for x in out.split(", ")], state, start, step)
    return rows.select(key, "ts", *columns).groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime")


def settled(wait_us: int, restart: bool, once: bool) -> Callable:
    """Rows ``(us, id, on)``: a row that is on starts a wait, if none has begun; one that is off ends it; a wait that lasts gives out its first row.

    With ``restart`` any row ends the wait before it, and begins one if it is on.  With ``once`` a key gives out one row for good.  A row at the
    very end of a wait comes too late to end it.
    """

    def step(state: tuple, rows: Rows, now: int):
        began, first, running, done = state
        out: Rows = []

        def lapse(until: int) -> None:
            nonlocal began, first, done
            if began is not None and until >= began + wait_us:
                if not (once and done):
                    out.append((first, began + wait_us))
                began, first, done = None, None, True

        for us, row, on, *_ in rows:
            lapse(us)
            if restart or not on:
                began, first, running = None, None, False
            if on and not running and not (once and done):
                began, first, running = us, row, True
        lapse(now)
        return (began, first, running, done), out, None if began is None else began + wait_us

    return step


WAIT_STATE = "began long, first long, running boolean, done boolean"


def waited(events: DataFrame, key: str, order: str, on: str, seconds: float, restart: bool = False, once: bool = False) -> DataFrame:
    """``key, order, fired_us``: the rows whose wait of ``seconds`` nothing ends; see ``settled``."""
    out = f"{key} {dict(events.dtypes)[key]}, {order} long, fired_us long"
    return in_order(events, key, order, [on], out, WAIT_STATE, (None, None, False, False), settled(int(seconds * 1_000_000), restart, once), together=True)


def replaying(most: int) -> Callable:
    """Rows ``(us, id, joins)``: posts fill a buffer of ``most``; who joins gets the whole buffer, and counts among the hearers of every post to come."""

    def step(state: tuple, rows: Rows, now: int):
        buffer, members = list(state[0]), state[1]
        out: Rows = []
        for _, row, joins, *_ in rows:
            if joins:
                out += [(post, row, members + 1) for post in buffer]
                members += 1
            else:
                buffer = [*buffer, row][-most:]
                out.append((row, None, members))
        return (buffer, members), out, None

    return step


def replayed(events: DataFrame, key: str, order: str, joins: str, most: int = 200) -> DataFrame:
    """``key, post, member, hearers``: each post once as it comes, without a member, and once more for each late member whose buffer it is in."""
    out = f"{key} {dict(events.dtypes)[key]}, post long, member long, hearers int"
    return in_order(events, key, order, [joins], out, "buffer array<long>, members int", ([], 0), replaying(most))


def ringed(most: int) -> Callable:
    """Rows ``(us, id, item)``: an item that is held stays in its place and changes; a new one goes to the end, and the one held longest leaves.

    An item that left and returns is new.  Gives out each row's item with how many are held, and the item that left for it.
    """

    def step(state: tuple, rows: Rows, now: int):
        held, out = list(state[0]), []
        for _, row, item, *_ in rows:
            left = None
            if item not in held:
                held.append(item)
                if len(held) > most:
                    left = held.pop(0)
            out.append((row, item, len(held), left))
        return (held,), out, None

    return step


def ring(events: DataFrame, key: str, order: str, item: str, most: int = 300) -> DataFrame:
    """``key, order, item, held, dropped`` after each row of a key's buffer of ``most`` items."""
    out = f"{key} {dict(events.dtypes)[key]}, {order} long, {item} long, held int, dropped long"
    return in_order(events.withColumn(item, F.col(item).cast("long")), key, order, [item], out, "items array<long>", ([],), ringed(most))


def with_late_marks(posts: DataFrame, marks: DataFrame, key: str, within: str) -> DataFrame:
    """Each post with its first mark of the same key that comes within ``within`` after it, null if none does: ``post, mark``.

    Both are streams with watermarks on ``ts``; a post waits until no mark can come any more and then leaves the state, as does a mark once
    no post can be as old.  ``posts(key, post, ts)``, ``marks(key, mark, ts)``.
    """
    p = posts.select(F.col(key).alias("pk"), "post", F.col("ts").alias("posted"))
    m = marks.select(F.col(key).alias("mk"), "mark", F.col("ts").alias("marked"))
    fits = (F.col("pk") == F.col("mk")) & (F.col("marked") >= F.col("posted")) & (F.col("marked") <= F.col("posted") + F.expr(f"interval {within}"))
    return p.join(m, fits, "leftOuter").select(F.col("pk").alias(key), "post", "posted", "mark", "marked")
