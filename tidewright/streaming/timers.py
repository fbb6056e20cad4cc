"""Stateful operators with timers and typed state: baskets that are left behind, and first occurrences with a time to live.

They need the RocksDB state store: stores(spark) sets it, before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewright.sources import table

CLICK, PURCHASE = "click", "purchase"


def stores(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _baskets(events: list[tuple[int, int, str]], idle: int) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
    """Runs of events (microseconds, id, type), sorted, with gaps of at most `idle`; each with the time after which nothing can join it."""
    run: list[tuple[int, int, str]] = []
    for e in sorted(events):
        if run and e[0] - run[-1][0] > idle:
            yield run[-1][0] + idle, run
            run = []
        run.append(e)
    if run:
        yield run[-1][0] + idle, run


class Abandoned(StatefulProcessor):
    """List state: a user's clicks and purchases that are not settled. Map state: how many baskets have ended in which way. A timer for when the next run of events is over."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, kind string")
        self.ended = handle.getMapState("ended", "how string", "n long")

    def _held(self) -> list[tuple[int, int, str]]:
        return [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []

    def _set_timer(self, runs: list[tuple[int, list]]) -> None:
        due = min((end for end, _ in runs), default=None)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(u), int(i), str(k)) for b in rows for u, i, k in zip(b["us"], b["id"], b["kind"], strict=True)]
        self.waiting.appendList(new)
        self._set_timer(list(_baskets(self._held(), self.idle)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out, left = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for end, run in _baskets(self._held(), self.idle):
            if end > mark:
                left.append((end, run))
                continue
            open_ = run[max((i for i, e in enumerate(run) if e[2] == PURCHASE), default=-1) + 1 :]
            how = "abandoned" if open_ else "bought"
            n = (self.ended.getValue((how,))[0] if self.ended.containsKey((how,)) else 0) + 1
            self.ended.updateValue((how,), (n,))
            if open_:
                out.append((key[0], open_[0][0], open_[-1][0], len(open_), n))
        held = [e for _, run in left for e in run]
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        self._set_timer(left)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "first_us", "last_us", "n_clicks", "nth"])

    def close(self) -> None:
        pass


def abandoned_stream(events: DataFrame, idle_minutes: int = 360) -> DataFrame:
    """user_id, first and last click, n_clicks and nth (the user's how manieth) of baskets left behind, for a stream with a watermark on ts: see abandoned_baskets.

    A basket comes out once the watermark has passed its last event by the idle time, so whatever order events came in; timers are looked at with each batch of rows. Events with a null user or time are left out. State holds
    a user's events of the runs that are still open, and two counts for good.
    """
    rows = events.where(F.col("event_type").isin(CLICK, PURCHASE) & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    found = rows.groupBy("user_id").transformWithStateInPandas(Abandoned(idle_minutes * 60_000_000), "user_id long, first_us long, last_us long, n_clicks long, nth long", "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("first_us").alias("first_click"), F.timestamp_micros("last_us").alias("last_click"), "n_clicks", "nth")


def abandoned_baskets(events: DataFrame, idle_minutes: int = 360) -> DataFrame:
    """The same of a table: of each user's clicks and purchases without a gap of more than the idle time, the clicks after the last purchase, if there are any."""
    rows = events.where(F.col("event_type").isin(CLICK, PURCHASE) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = rows.withColumn("fresh", (F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(1 << 62)) > idle_minutes * 60_000_000).cast("int")).withColumn("run", F.sum("fresh").over(w))
    later = Window.partitionBy("user_id", "run").orderBy("us", "event_id").rowsBetween(0, Window.unboundedFollowing)
    open_ = rows.withColumn("bought", F.max((F.col("event_type") == PURCHASE).cast("int")).over(later)).where("bought = 0")
    found = open_.groupBy("user_id", "run").agg(F.min("ts").alias("first_click"), F.max("ts").alias("last_click"), F.count("*").alias("n_clicks"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("first_click")).cast("long")).drop("run")


class First(StatefulProcessor):
    """Value state with a time to live: whether a key was seen in the last `ttl_ms` of processing time."""

    def __init__(self, ttl_ms: int, columns: list[str]):
        self.ttl, self.columns = ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            if not self.seen.exists() and len(b):
                self.seen.update((True,))
                yield b.head(1)[self.columns]

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """A row of each `key` of a stream that was not seen in `ttl_ms` before, in processing time: state goes by itself, without a watermark."""
    return rows.groupBy(key).transformWithStateInPandas(First(ttl_ms, rows.columns), rows.schema, "Append", "ProcessingTime")


def baskets_left_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abandoned_baskets(table(spark, sf_dir, "events")).select("user_id", "first_click", "last_click", "n_clicks", "nth")


QUERIES = {
    "baskets_left_behind": (baskets_left_behind, """
        with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as fresh from events where event_type in ('click', 'purchase')),
        b as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from a),
        c as (select *, max(case when event_type = 'purchase' then ts end) over (partition by user_id, run) as bought from b)
        select user_id, min(ts) as first_click, max(ts) as last_click, count(*) as n_clicks, row_number() over (partition by user_id order by min(ts)) as nth
        from c where bought is null or ts > bought group by user_id, run"""),
}
