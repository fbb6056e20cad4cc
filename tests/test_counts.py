"""Pairs that are counted without being made, on odd rows, against SQL and plain loops."""

import datetime
import random

import duckdb
import numpy as np
import pytest

from tidewright.operators import joins, ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Pauses of 30 minutes exactly, negative values, nulls, and ids that several errors have, with one range or many."""
    rng = random.Random(5)
    begin = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        at = begin + datetime.timedelta(minutes=15 * rng.randrange(600)) + datetime.timedelta(microseconds=rng.choice([0, 0, 0, 1, -1]))
        rows.append((rng.choice([None, i, i, i, i, i, i, i // 40]), rng.choice([at] * 30 + [None]), rng.choice([None, *range(40)]), rng.choice(["error", "view"]), rng.choice([None, -20.0, -0.05, 0.0, 0.5, 3.25, 100.0])))
    rows += [(10_000, begin, 3, "error", 5.0)] * 3
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    con.executemany("insert into events values (?, ?, ?, ?, ?)", rows)
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    return str(folder), con


def test_sessions_during_incidents_on_odd_rows(spark, events):
    folder, con = events
    sql = joins.QUERIES["sessions_during_incidents"][1]
    got = joins.sessions_during_incidents(spark, folder)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = order(con.execute(sql).fetchall())
    assert order(got.collect()) == want and len(want) > 500


def test_overlaps_are_counted_without_pairs(spark):
    left = spark.range(3000).selectExpr("id as k", "id as low", "id + 100000 as high")
    right = spark.range(3000).selectExpr("id % 7 as who", "id * 10 as begin", "id * 10 + 5 as end")
    got = joins.overlap_counts(left, right, "k", ("low", "high"), ("begin", "end"), "who")
    assert "__own0" not in plan(got)  # pairs
    meets = lambda k: sum(j * 10 + 5 >= k for j in range(3000))
    assert {r.k: (r.n_rows, r.n_whos) for r in got.collect()} == {k: (meets(k), 7) for k in range(3000)}


@pytest.mark.parametrize("m", [0, 1, 2, 3, 64, 257])
def test_sums_before_and_above(m):
    rng = np.random.default_rng(m)
    x, y = rng.integers(0, 20, m), rng.choice([0.0, -1.5, float("nan"), *range(9)], m)
    ws = [rng.integers(-3, 4, m), np.ones(m, dtype=np.int64)]
    over = lambda a, b: (a > b) | ((a != a) & (b == b))
    for w, got in zip(ws, ordered._sums_before_above(x, y, ws), strict=True):
        assert got.tolist() == [int(w[(x < x[i]) & over(y, y[i])].sum()) for i in range(m)]


def test_dominators_make_no_pairs_within_a_cell(spark):
    """All joins are with whole cells, by both of their numbers: even one cell that holds everything is summed up without pairs."""
    rows = [(i, i * 7919 % 20_011, float(i * 104_729 % 20_021)) for i in range(20_000)]
    got = ordered.dominators(spark.createDataFrame(rows, "id int, x int, y double"), "id", "x", "y", 1)
    lines = [line for line in plan(got).splitlines() if "Join [" in line]
    assert lines and all("cx" in keys and "cy" in keys for line in lines for keys in line.split("Join [")[1].split("], [")[:2])
    x, y = (np.array(c) for c in list(zip(*rows, strict=True))[1:])
    found = {r.id: r.n for r in got.collect()}
    assert len(found) == 20_000 and all(found[i] == int(((x < x[i]) & (y > y[i])).sum()) for i in range(0, 20_000, 37))


@pytest.mark.parametrize("cells", [None, 5])
def test_dominators_of_frequent_values_nan_and_texts(spark, cells):
    rng = random.Random(6)
    rows = [(rng.choice([None, i, 7]), rng.choice(["b"] * 20 + ["a", "c", "é", "\U0001f600", None]), rng.choice([1.5] * 20 + [float("nan"), -0.0, 0.0, float("inf"), None])) for i in range(800)]
    got = {r.id: r.n for r in ordered.dominators(spark.createDataFrame(rows, "id int, x string, y double"), "id", "x", "y", cells).collect()}
    known = [(x.encode(), (y != y, 0.0 if y != y else y)) for _, x, y in rows if x is not None and y is not None]
    want = {}
    for i, x, y in rows:
        here = x is not None and y is not None
        want[i] = want.get(i, 0) + (sum(a < x.encode() and b > (y != y, 0.0 if y != y else y) for a, b in known) if here else 0)
    assert got == want


def test_a_frequent_value_has_a_cell_to_itself():
    often = np.array([True, False, True])
    got = ordered._halves(np.array([-1.0, 0.0, 1.0, 2.0, 3.0, float("nan")]), np.array([0.0, 2.0, float("nan")]), often)
    assert got.tolist() == [1, 2, 3, 5, 5, 6]
