"""Joins and patterns of streams against the same over tables, up to the watermark; restarts; null times."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators import patterns
from tidewright.streaming import joins, state, timers
from tidewright.streaming import patterns as stream_patterns

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
BEGIN = datetime(2024, 1, 1)


def files(spark, folder, *parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # the stream goes by the files' times


def stream(spark, folder, late):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", late)


def run(rows, folder, name, **trigger):
    """Everything that a stream has given so far, over a checkpoint that the next run goes on from."""
    rows.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint-{name}").outputMode("append").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


@pytest.fixture
def shuffled(spark, tmp_path):
    """Events of some days in three files, each shuffled, with events up to an hour late in the next file."""
    rng = random.Random(7)
    rows = [(i, BEGIN + timedelta(minutes=7 * i, microseconds=i), rng.randrange(6), rng.choice(["click", "view", "view", "purchase", "error"]), 1.0) for i in range(600)]
    parts = [[], [], []]
    for i, r in enumerate(rows):
        parts[min(2, (i + rng.choice([0, 0, 0, 5])) // 200)].append(r)
    for p in parts:
        rng.shuffle(p)
    return [spark.createDataFrame(p, SCHEMA) for p in parts], rows[-1][1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_of_streams(spark, tmp_path, shuffled, how):
    parts, end = shuffled
    files(spark, tmp_path, *parts)
    events = stream(spark, tmp_path, "1 hour")
    got = sorted(map(str, run(joins.clicks_and_purchases(events, how), tmp_path, how).collect()))
    whole = parts[0].union(parts[1]).union(parts[2])
    batch = joins.clicks_and_purchases(whole, how)
    # unmatched clicks come out only when no purchase can follow
    sure = batch.where(F.col("purchase").isNotNull() | (F.col("clicked") < F.lit(end - timedelta(hours=8))))
    assert set(map(str, sure.collect())) <= set(got) <= set(map(str, batch.collect())) and len(got) == len(set(got)) > 50
    if how == "inner":
        assert got == sorted(map(str, batch.collect()))


def plain(rows, wanted, within):
    """(event, start) by trying all subsequences that end in each event."""
    out = set()
    for u in {r[2] for r in rows}:
        own = sorted((r[1], r[0], r[3]) for r in rows if r[2] == u)
        for i, (t, key, kind) in enumerate(own):
            if kind != wanted[-1]:
                continue
            at = i
            for step in reversed(wanted[:-1]):
                at = next((j for j in range(at - 1, -1, -1) if own[j][2] == step), -1)
                if at < 0:
                    break
            if at >= 0 and t - own[at][0] <= timedelta(seconds=within):
                out.add((key, own[at][1]))
    return out


WANTED = ["view", "view", "purchase"]


def steps(wanted=WANTED):
    return [F.col("event_type") == k for k in wanted]


@pytest.mark.parametrize(("wanted", "hours"), [(WANTED, 6), (WANTED, 1000), (["click", "purchase"], 3), (["view", "error", "view", "click"], 30), (["view", "view", "view"], 10)])
def test_patterns_of_a_table(spark, shuffled, wanted, hours):
    parts, _ = shuffled
    whole = parts[0].union(parts[1]).union(parts[2])
    rows = [tuple(r) for r in whole.collect()]
    odd = spark.createDataFrame([(9000, None, 1, "view", 1.0), (9001, BEGIN, None, "purchase", 1.0), (9002, BEGIN, 1, None, 1.0)], SCHEMA)
    got = patterns.matches(whole.union(odd), "user_id", "ts", "event_id", steps(wanted), hours * 3600)
    assert got.columns == ["user_id", "event_id", "ts", "started", "start_key"]
    want = plain(rows, wanted, hours * 3600)
    assert {(r.event_id, r.start_key) for r in got.collect()} == want and len(want) > 10
    assert got.count() == len(want)


def test_patterns_of_a_stream_that_is_restarted(spark, tmp_path, shuffled):
    parts, end = shuffled
    files(spark, tmp_path, parts[0], parts[1])
    found = lambda: stream_patterns.stream_matches(stream(spark, tmp_path, "1 hour"), "user_id", "ts", "event_id", steps(), 6 * 3600)
    first = run(found(), tmp_path, "patterns").count()
    files(spark, tmp_path, parts[2], spark.createDataFrame([(10_000, end + timedelta(hours=30), 99, "view", 1.0), (10_001, None, 1, "view", 1.0)], SCHEMA))
    got = [tuple(r) for r in run(found(), tmp_path, "patterns").collect()]
    want = [tuple(r) for r in patterns.matches(parts[0].union(parts[1]).union(parts[2]), "user_id", "ts", "event_id", steps(), 6 * 3600).collect()]
    assert 0 < first < len(got) and sorted(got) == sorted(want)


def test_an_automaton_takes_each_event_once():
    best = [None, None]
    assert [stream_patterns.advance(best, t, t, f, 100) for t, f in ((1, 1 | 2 | 4), (2, 1 | 2 | 4), (3, 1 | 2 | 4), (200, 4), (201, 3), (202, 3), (203, 4))] == [None, None, (1, 1), None, None, None, (201, 201)]


def test_running_totals_take_null_times(spark, tmp_path):
    rows = [(1, BEGIN, 1, "a", 2.0), (2, None, 1, "a", 3.0), (3, None, 2, "a", None)]
    files(spark, tmp_path, spark.createDataFrame(rows, SCHEMA))
    totals = state.running_totals(stream(spark, tmp_path, "1 hour"))
    totals.writeStream.format("memory").queryName("null_times").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r.user_id: (r.n, r.total) for r in spark.table("null_times").where("not closed").collect()}
    assert got == {1: (2, 5.0), 2: (1, 0.0)}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    timers.stores(spark)
    yield
    spark.conf.set(name, before)


def test_baskets_of_a_stream_that_is_restarted(spark, tmp_path, shuffled, rocks):
    parts, end = shuffled
    files(spark, tmp_path, parts[0], parts[1])
    found = lambda: timers.abandoned_stream(stream(spark, tmp_path, "1 hour"), 30)
    first = run(found(), tmp_path, "baskets").count()
    files(spark, tmp_path, parts[2], spark.createDataFrame([(10_000, end + timedelta(hours=30), 99, "click", 1.0), (10_001, None, 1, "click", 1.0), (10_002, end, None, "click", 1.0)], SCHEMA), spark.createDataFrame([(10_003, end + timedelta(hours=31), 99, "click", 1.0)], SCHEMA))
    got = [tuple(r) for r in run(found(), tmp_path, "baskets").collect()]
    whole = parts[0].union(parts[1]).union(parts[2])
    want = [tuple(r) for r in timers.abandoned_baskets(whole, 30).select("user_id", "first_click", "last_click", "n_clicks", "nth").collect()]
    assert 0 < first < len(got) and sorted(got) == sorted(want) and max(r[3] for r in got) > 1


def test_state_lives_for_its_time(spark, tmp_path, rocks):
    def run_twice(ttl, name):
        seen = []
        for _ in range(2):
            files(spark, tmp_path / name, spark.createDataFrame([(i, BEGIN, i % 3, "a", 1.0) for i in range(9)], SCHEMA))
            rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}/in").select("user_id", "value")
            seen.append(run(timers.first_seen(rows, "user_id", ttl), tmp_path / name, "out", once=True).count())  # state by processing time asks for ever more batches
        return seen

    assert run_twice(3_600_000, "long") == [3, 3]
    assert run_twice(1, "short") == [3, 6]
