"""Sketches: merged ones against those of the whole and against exact values, with nulls and late rows."""

from pyspark.sql import functions as F

from tidewright.operators import sketches
from tidewright.sources import table

SCHEMA = "ts timestamp_ntz, user_id long, event_type string, value double"


def made(spark, n, start="2024-01-01", users=5000):
    return spark.range(n).select((F.expr(f"timestamp_ntz'{start} 00:00:00'") + F.make_dt_interval(secs=F.floor(F.col("id") * (259_200 / n)))).alias("ts"), (F.xxhash64("id") % users).alias("user_id"), F.lit("click").alias("event_type"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 100).alias("value"))


def test_merged_sketches_are_within_their_errors(spark):
    events = made(spark, 60_000)
    hours = sketches.sketched(events)
    assert hours.count() == 72
    day = sketches.rolled(hours, "week").select("n", sketches.users().alias("users"), *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).first()
    exact = events.agg(F.count_distinct("user_id")).first()[0]
    assert day.n == 60_000 and abs(day.users - exact) <= sketches.USERS_ERROR * exact
    for q, at in ((day.q0, 0.1), (day.q1, 0.5), (day.q2, 0.99)):
        assert abs(events.where(F.col("value") <= q).count() / 60_000 - at) <= sketches.RANK_ERROR


def test_late_events_are_absorbed(spark):
    events, late = made(spark, 5000), made(spark, 500, users=90_000)
    hours = sketches.rolled(sketches.sketched(events).unionAll(sketches.sketched(late)), "hour")
    whole = sketches.sketched(events.unionAll(late))
    got, want = ({r.start: (r.n, r.u) for r in x.select("start", "n", sketches.users().alias("u")).collect()} for x in (hours, whole))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1 + sketches.USERS_ERROR * want[k][1] for k in got)


def test_returning_users(spark):
    days = sketches.rolled(sketches.sketched(made(spark, 90_000)), "day", ())
    events = made(spark, 90_000)
    of = {r.d: set(r.u) for r in events.groupBy(F.to_date("ts").alias("d")).agg(F.collect_set("user_id").alias("u")).collect()}
    from datetime import timedelta

    got = {r.start.date(): r.returning for r in sketches.returning(days).collect()}
    assert len(got) == 2
    for d, n in got.items():
        before = of[d - timedelta(days=1)]
        assert abs(n - len(of[d] & before)) <= sketches.THETA_ERROR * len(of[d] | before)


def test_nulls_and_no_rows(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, None, "click", None), (t, 1, "click", None), (None, 2, "click", 1.0), (t, 3, None, 2.0)], SCHEMA)
    day = sketches.rolled(sketches.sketched(rows), "day").select("start", "event_type", "n", sketches.users().alias("u"), sketches.quantile(0.5).alias("m"))
    assert {tuple(r) for r in day.collect()} == {(t, "click", 2, 1, None), (None, "click", 1, 1, 1.0), (t, None, 1, 1, 2.0)}
    assert sketches.rolled(sketches.sketched(rows.limit(0)), "day").count() == 0


def test_rows_stay_small(spark, data):
    """A sketch's size does not go with the events."""
    size = lambda df: df.select(F.max(F.octet_length("users") + F.octet_length("user_set") + F.octet_length("values"))).first()[0]
    assert size(sketches.rolled(sketches.sketched(made(spark, 200_000, users=100_000)), "week")) < 60_000
    assert size(sketches.sketched(table(spark, data, "events"))) < 60_000
