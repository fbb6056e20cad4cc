"""Sources, joins on small tables, streams, and what stands without the corpus operators."""

import random
import subprocess
import sys
import time
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright import sources
from tidewright.functions import python, variants
from tidewright.operators import joins
from tidewright.streaming import state, windows

ROOT = Path(__file__).resolve().parents[1]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i long, s string, x double")
    for form in ("parquet", "orc", "json", "csv"):
        sources.save(df, f"{tmp_path}/{form}", form)
        assert sorted(map(str, sources.load(spark, f"{tmp_path}/{form}", form, "i long, s string, x double").collect())) == sorted(map(str, df.collect()))
    sources.save(df, f"{tmp_path}/by", by=["i"])
    assert sources.load(spark, f"{tmp_path}/by").where("i = 2").count() == 1


def plain_asof(left, right):
    """(id, key, time) with the greatest value of the last (key, time, value) no later; nulls match nothing."""
    found = {}
    for i, k, t in left:
        able = [(u, v) for j, u, v in right if k is not None and t is not None and j == k and u is not None and u <= t]
        found[i] = max(able)[1] if able else None
    return found


@pytest.mark.parametrize("cell", [lambda: None, lambda: F.floor(F.col("__t") / 3), lambda: F.lit(0)])
def test_asof_ties_and_nulls(spark, cell):
    left = [(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 8), (7, "a", 20), (8, None, None), (9, "d", 4), (10, "a", 5)]
    right = [("a", 5, 50), ("a", 5, 51), ("a", 2, 20), ("c", 1, 1), (None, 3, 30), ("a", None, 99), (None, None, 98), ("d", 5, 7), ("b", None, 97)]
    got = joins.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t2 int, v int"), "k", "t", "t2", ["v"], cell(), 0)
    assert {r.id: r.v for r in got.collect()} == plain_asof(left, right)


def test_asof_cells_carry_over_gaps(spark):
    rng = random.Random(0)
    left = [(i, rng.choice("abh"), rng.randrange(1000)) for i in range(400)]
    right = [(rng.choice("abhhhh"), rng.randrange(1000), i) for i in range(60)]
    got = joins.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t2 int, v int"), "k", "t", "t2", ["v"], F.floor(F.col("__t") / 7), 0)
    assert {r.id: r.v for r in got.collect()} == plain_asof(left, right)


def test_range_join_is_whole(spark):
    points = spark.range(-50, 50).select(F.col("id"), (F.col("id") * 0.7).alias("x"))
    ranges = spark.range(0, 20).select(F.col("id").alias("r"), (F.col("id") * 3.0 - 30).alias("low"), (F.col("id") * 3.5 - 25).alias("high"))
    got = joins.range_join(points, ranges, F.col("x"), F.col("low"), F.col("high"), 2.0)
    want = points.crossJoin(ranges).where("x between low and high")
    assert sorted((r.id, r.r) for r in got.collect()) == sorted((r.id, r.r) for r in want.collect())


def test_wide_ranges_are_dealt_to_few_cells(spark):
    points = spark.createDataFrame([(i, float(i * i % 9973)) for i in range(300)] + [(-1, None)], "id int, x double")
    ranges = spark.createDataFrame([(0, 0.0, 9000.0), (1, 5.0, 5.0), (2, 100.0, 90.0), (3, None, 5.0), (4, -50.0, 40.0), (5, 7000.0, 7100.0)], "r int, low double, high double")
    got = joins.range_join(points, ranges, F.col("x"), F.col("low"), F.col("high"), 1.0, most=16)
    want = points.crossJoin(ranges).where("x between low and high")
    assert got.columns == ["id", "x", "r", "low", "high"]
    assert sorted((r.id, r.r) for r in got.collect()) == sorted((r.id, r.r) for r in want.collect())


@pytest.mark.parametrize(("width", "most", "on"), [(1.0, 16, None), (50.0, 3, None), (1e6, 64, None), (3.0, 4, {"k": "j"})])
def test_overlap_join(spark, width, most, on):
    """Points, short ranges, one over everything on each side, empty ones, touching ends and nulls."""
    rng = random.Random(4)

    def made(seed):
        rng.seed(seed)
        out = [(0, "a", -1e5, 1e6), (1, "b", 5.0, 5.0), (2, "a", 9.0, 3.0), (3, "a", None, 5.0), (4, None, 1.0, 100.0), (5, "a", 100.0, 200.0), (6, "b", 200.0, 200.0)]
        for i in range(7, 150):
            low = rng.uniform(-300, 2000)
            out.append((i, rng.choice("ab"), low, low + rng.choice([0.0, 0.5, 3.0, 40.0, 700.0])))
        return out

    left, right = made(1), made(2)
    a, b = spark.createDataFrame(left, "i int, k string, low double, high double"), spark.createDataFrame(right, "r int, j string, begin double, end double")
    got = joins.overlap_join(a, b, ("low", "high"), ("begin", "end"), width, on, most)
    assert got.columns == ["i", "k", "low", "high", "r", "j", "begin", "end"]
    known = lambda rows: [r for r in rows if r[2] is not None and r[3] is not None and r[2] <= r[3]]
    want = [(x[0], y[0]) for x in known(left) for y in known(right) if x[2] <= y[3] and y[2] <= x[3] and (not on or (x[1] is not None and x[1] == y[1]))]
    assert sorted((r.i, r.r) for r in got.collect()) == sorted(want) and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.overlap_join(a.limit(0), b, ("low", "high"), ("begin", "end"), width, on, most).count() == 0


def test_a_range_over_everything_is_dealt_to_few_cells(spark):
    a = spark.createDataFrame([(0, 0.0, 1e9)], "i int, low double, high double")
    b = spark.range(2000).selectExpr("id as r", "id * 1000.0 as begin", "id * 1000.0 + 1 as end")
    got = joins.overlap_join(a, b, ("low", "high"), ("begin", "end"), 1.0, most=64)
    assert got.count() == 2000
    widths = joins._levels(1.0, 64, 1e9)
    assert 1e9 / widths[-1] + 1 <= 64


@pytest.mark.parametrize("large", [0, 10**6])
def test_asof_with_and_without_cells(spark, large):
    rng = random.Random(9)
    left = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(100), i) for i in range(50)]
    got = joins.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, t2 int, v int"), "k", "t", "t2", ["v"], F.floor(F.col("__t") / 9), large)
    assert {r.id: r.v for r in got.collect()} == plain_asof(left, right)


def run(rows, name, folder, mode):
    """What a stream over all files gives, one after another."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint-{name}").start()
    query.awaitTermination()
    return rows.sparkSession.table(name).collect()


def written(spark, folder, *parts):
    """Files of events, in the order in which a stream reads them."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # the stream goes by the files' times
    return f"{folder}/in"


def test_repeated_events_count_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    first = events.orderBy("ts").limit(300)
    rows = windows.counted(windows.stream(spark, written(spark, tmp_path, first, first), events.schema), "1 hour")
    batch = windows.counted(first.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    assert sorted(map(str, run(rows, "counted_hours", tmp_path, "complete"))) == sorted(map(str, batch.collect()))


@pytest.fixture
def late_events(spark, tmp_path):
    """Shuffled micro-batches: in each, events of some days in any order; the last two hold one late event each, of which only one is too late."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(400)
    end = events.agg(F.max("ts")).first()[0]
    from datetime import timedelta

    at = lambda h, i: spark.createDataFrame([(10_000 + i, end - timedelta(hours=h), 1, "click", 1.0, "{}")], events.schema)
    parts = [events.where("event_id % 400 < 200").orderBy(F.rand(1)), events.where("event_id % 400 >= 200").orderBy(F.rand(2)), at(200, 1).union(at(0.5, 2))]
    path = written(spark, tmp_path, *parts)
    kept = parts[0].union(parts[1]).union(at(0.5, 2)).withColumn("ts", F.col("ts").cast("timestamp"))
    return path, events.schema, kept, end - timedelta(hours=1)


@pytest.mark.parametrize(("name", "window", "hours"), [("append_tumbling", ("1 hour",), 1), ("append_sliding", ("1 hour", "30 minutes"), 1)])
def test_windows_are_emitted_once_and_late_events_left_out(spark, tmp_path, late_events, name, window, hours):
    path, schema, kept, watermark = late_events
    got = run(windows.counted(windows.stream(spark, path, schema), *window), name, tmp_path, "append")
    closed = windows.counted(kept, *window).where(F.col("start") + F.expr(f"interval {hours} hours") <= F.lit(watermark))
    assert sorted(map(str, got)) == sorted(map(str, closed.collect())) and len(got) > 100


def test_sessions_of_a_stream(spark, tmp_path, late_events):
    path, schema, kept, watermark = late_events
    got = run(windows.session_counts(windows.stream(spark, path, schema)), "append_sessions", tmp_path, "append")
    w = F.session_window("ts", "30 minutes")
    closed = kept.groupBy("user_id", w).agg(F.count("*").alias("n")).where(F.col("session_window.end").cast("timestamp_ntz") <= F.lit(watermark)).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
    assert sorted(map(str, got)) == sorted(map(str, closed.collect())) and len(got) > 100


def test_running_totals_and_expired_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(600)
    half = events.approxQuantile("event_id", [0.5], 0)[0]
    path = written(spark, tmp_path, events.where(f"event_id <= {half}"), events.where(f"event_id > {half}"))
    got = run(state.running_totals(windows.stream(spark, path, events.schema), idle_ms=3_600_000), "running", tmp_path, "update")
    want = {r.user_id: (r.n, round(r.total, 6)) for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert any(r.closed for r in got) and {r.user_id for r in got} == set(want)
    assert all(r.n <= want[r.user_id][0] for r in got)  # a key whose state went begins anew
    steady = run(state.running_totals(windows.stream(spark, path, events.schema), idle_ms=10**12), "steady", tmp_path, "update")
    final = {}
    for r in steady:
        final[r.user_id] = max(final.get(r.user_id, (0, 0.0)), (r.n, round(r.total, 6)))
    assert final == want and not any(r.closed for r in steady)


def test_other_formats(spark, tmp_path):
    lines = spark.createDataFrame([("one line",), ("and another",)], "value string")
    sources.save(lines, f"{tmp_path}/text", "text")
    assert sorted(r.value for r in sources.load(spark, f"{tmp_path}/text", "text").collect()) == ["and another", "one line"]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    sources.save(rows, f"{tmp_path}/xml", "xml", rowTag="row")
    assert sorted(map(str, sources.load(spark, f"{tmp_path}/xml", "xml", "i long, s string", rowTag="row").collect())) == sorted(map(str, rows.collect()))


def test_functions_in_python(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0), (None, 8.0)], "k string, x double")

    def partial(b):
        return b.groupby("k", dropna=False)["x"].agg(["sum", "count"]).reset_index().set_axis(["k", "total", "n"], axis=1)

    got = python.in_two_steps(rows, ["k"], partial, "k string, total double, n long", {"total": F.sum, "n": F.sum})
    assert {(r.k, r.total, r.n) for r in got.collect()} == {("a", 5.0, 2), ("b", 0.0, 0), (None, 10.0, 2)}
    assert python.in_two_steps(rows.limit(0), ["k"], partial, "k string, total double, n long", {"n": F.sum}).count() == 0
    texts = pd.Series(["Crème brûlée", None, "", "e\u0301 ß", "Ωμέγα"])
    assert python.unaccented(texts).where(texts.notna(), None).tolist() == ["Creme brulee", None, "", "e ß", "Ωμεγα"]


def test_throttle_decides_its_schema_and_order(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], None if i == 9 else datetime(2024, 1, 1) + timedelta(seconds=s)) for i, s in enumerate((0, 0, 1, 50, 2, 51, 3, 52, 30, 0, 31, 53))], "id int, k string, t timestamp_ntz").repartition(3)
    got = python.throttled(rows, "k", "t", "id", 10_000_000, 2)
    assert got.columns == ["id", "k", "t", "allowed", "left_us"]
    want = {}
    for k in "ab":
        left, last = 20_000_000, None
        for r in sorted((r for r in rows.collect() if r.k == k), key=lambda r: (r.t is not None, r.t or datetime.min, r.id)):
            if r.t and last:
                left = min(20_000_000, left + int((r.t - last).total_seconds() * 1e6))
            last, ok = r.t or last, r.t is not None and left >= 10_000_000
            left -= 10_000_000 if ok else 0
            want[r.id] = (ok, left)
    assert {r.id: (r.allowed, r.left_us) for r in got.collect()} == want
    with pytest.raises(Exception, match="no column nothing"):
        python.throttled(rows, "nothing", "t", "id", 1, 1).collect()
    assert python.throttled(rows.limit(0), "k", "t", "id", 1, 1).count() == 0


def test_variants_of_odd_documents(spark):
    texts = ['{"k": 1, "a": {"b": [1, "x", null]}}', '{"k": "seven"}', "[1, 2.5, null]", "17", "null", "not json", None, "", "{}", '{"k": 9223372036854775808}', '{"k": 3, "k2": 3}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("v", variants.parsed("s"))
    got = {r.i: (r.k, r.rest) for r in variants.shredded(df, "v", {"k": ("$.k", "long")}).collect()}
    assert got == {0: (1, None), 1: (None, '{"k":"seven"}'), 2: (None, "[1,2.5,null]"), 3: (None, "17"), 4: (None, "null"), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, "{}"), 9: (None, '{"k":9223372036854775808}'), 10: (3, None)}
    found = sorted((r.i, r.pos, r.key) for r in variants.entries(df, "v", ["i"]).where("pos is not null").collect())
    assert found == [(0, 0, "a"), (0, 1, "k"), (1, 0, "k"), (2, 0, None), (2, 1, None), (2, 2, None), (9, 0, "k"), (10, 0, "k"), (10, 1, "k2")]
    assert df.select(variants.field(df.v, "$.a.b[1]", "string").alias("x")).first().x == "x"
    schemas = {r.schema: r.n for r in variants.kinds(df, "v").collect()}
    assert schemas["BIGINT"] == 1 and schemas[None] == 3 and sum(schemas.values()) == len(texts)
    assert variants.shredded(df.limit(0), "v", {"k": ("$.k", "long")}).count() == 0


def test_library_stands_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tidewright.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).returncode == 0
