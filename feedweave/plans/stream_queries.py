"""Queries of streams in which time passes: the events arrive in slices, out of order by up to ten minutes, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.plans.catalog import _table, query
from feedweave.streaming import arrivals, timers
from feedweave.streaming.posts import drained

SLICES = 3
MOST = 1_000_000  # events in a slice where few keys hold all of them
FILE = 100_000  # events that are worth a file, and a task, of their own
CLOSING = {"event_id": -1, "user_id": -1, "event_type": "closing"}


def _arriving(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    files = 1 if most else min(spark.sparkContext.defaultParallelism, events.count() // SLICES // FILE)
    return arrivals.arriving(arrivals.shuffled(events, SLICES, most=most), CLOSING, files=files)


def runs(key: str, on: str, seconds: int, pick: str) -> str:
    """SQL of waits: rows that are on after one that isn't begin one; the next row that is off ends it."""
    return f"""select {pick} from (select k, event_id, ts, epoch_us(min(case when not live then ts end) over (partition by k order by ts, event_id rows between 1 following and unbounded following)) as ended, live and not coalesce(lag(live) over (partition by k order by ts, event_id), false) as began
      from (select *, {key} as k, {on} as live from events)) where began and (ended is null or ended - epoch_us(ts) >= {seconds}e6)"""


@query("select k as place, cast(arg_min(event_id, (ts, event_id)) as bigint) as event_id, epoch_us(min(ts)) + 1800000000 as fired_us from (" + runs("user_id % 50", "(event_id * 37) % 100 >= 50", 1800, "k, event_id, ts") + ") group by 1")
def stream_dwell(spark, sf_dir):
    """Each place fires once, as soon as it has been half in view for half an hour without a break."""
    rows = _arriving(spark, sf_dir).withColumn("place", F.col("user_id") % 50).withColumn("shown", (F.col("event_id") * 37) % 100 >= 50)
    return drained(timers.waited(rows, "place", "event_id", "shown", 1800, once=True), "append").where("event_id >= 0")


@query(runs("user_id", "event_type = 'view'", 7200, "k as user_id, event_id, epoch_us(ts) + 7200000000 as fired_us"))
def stream_candidate_delay(spark, sf_dir):
    """A user's views enter the queue after two hours in which nothing else happens."""
    rows = _arriving(spark, sf_dir).withColumn("enters", F.col("event_type") == "view")
    return drained(timers.waited(rows, "user_id", "event_id", "enters", 7200), "append").where("event_id >= 0")


@query("select event_id from (select event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap from events) where gap is null or gap >= 1800e6")
def stream_debounce(spark, sf_dir):
    rows = _arriving(spark, sf_dir).withColumn("on", F.lit(True))
    return drained(timers.waited(rows, "user_id", "event_id", "on", 1800, restart=True), "append").where("event_id >= 0").select("event_id")


@query("""select p.user_id, p.event_id as post, m.event_id as mark from (select * from events where event_type = 'view') p left join (select * from events where event_type = 'purchase') m
  on m.user_id = p.user_id and m.ts >= p.ts and m.ts <= p.ts + interval 6 hour""")
def stream_late_marks(spark, sf_dir):
    """Views with the purchases that come up to six hours later: the join of two streams, views without any given out once none can come."""
    rows = _arriving(spark, sf_dir)
    posts = rows.where("event_type in ('view', 'closing')").select("user_id", F.col("event_id").alias("post"), "ts")
    marks = _arriving(spark, sf_dir).where("event_type in ('purchase', 'closing')").select("user_id", F.col("event_id").alias("mark"), "ts")
    return drained(timers.with_late_marks(posts, marks, "user_id", "6 hours"), "append").where("post >= 0").select("user_id", "post", "mark")


@query("""with e as (select *, user_id % 4 as tab, event_id % 83 = 0 as joins from events), c as (
    select *, sum(case when joins then 0 else 1 end) over w as posts, (sum(case when joins then 1 else 0 end) over w)::int as members from e window w as (partition by tab order by ts, event_id rows unbounded preceding))
  select tab, event_id as post, null::bigint as member, members as hearers from c where not joins
  union all select m.tab, p.event_id, m.event_id, m.members from c m join c p on p.tab = m.tab and not p.joins and p.posts <= m.posts and p.posts > m.posts - 200 and (p.ts, p.event_id) < (m.ts, m.event_id) where m.joins""")
def stream_replay(spark, sf_dir):
    """What subscribers that join late get of the last 200 posts of their tab, and how many hear each post as it comes."""
    rows = _arriving(spark, sf_dir, MOST).withColumn("tab", F.col("user_id") % 4).withColumn("joins", F.col("event_id") % 83 == 0)
    return drained(timers.replayed(rows, "tab", "event_id", "joins", 200), "append").where("post >= 0")


@query("""with recursive e as (select event_type, event_id, (user_id * 7) % 90 as item, row_number() over (partition by event_type order by ts, event_id) as k from events),
  s as (select event_type, null::bigint as event_id, null::bigint as item, 0::bigint as k, []::bigint[] as items, null::bigint as dropped from (select distinct event_type from events)
    union all select e.event_type, e.event_id, e.item, e.k, case when list_contains(s.items, e.item) then s.items when len(s.items) = 60 then list_append(s.items[2:], e.item) else list_append(s.items, e.item) end,
      case when not list_contains(s.items, e.item) and len(s.items) = 60 then s.items[1] end from s join e on e.event_type = s.event_type and e.k = s.k + 1)
  select event_type, event_id, item, len(items)::int as held, dropped from s where k > 0""".replace("with recursive", "select * from (with recursive", 1) + ")")
def stream_capture_ring(spark, sf_dir):
    """A buffer of 60 items for each kind of event, also where an item that was dropped returns."""
    rows = _arriving(spark, sf_dir, MOST).withColumn("item", (F.col("user_id") * 7) % 90)
    return drained(timers.ring(rows, "event_type", "event_id", "item", 60), "append").where("event_id >= 0")
