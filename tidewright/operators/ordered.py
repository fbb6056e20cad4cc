"""Order over a whole table: running totals, ranks and counts of pairs, none of them in one task.

The table is cut into cells by bounds of its order, drawn from a bounded sample, so each row finds its cell without a
shuffle. What earlier cells sum up to is a short list, put into the plan as a literal; within a cell windows do the
rest: one shuffle in all.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import durable
from tidewright.sources import table

#: Rows that a cell is to have, and the most cells; rows of the sample for each cell.
ROWS, CELLS, SAMPLE = 250_000, 16_384, 64


def bounds(df: DataFrame, order: list[str], cells: int, n: int) -> list[T.Row]:
    """At most `cells` - 1 different keys that cut `df` of `n` rows into parts of about one size; the driver sees SAMPLE rows for each."""
    keys = df.select(*order)
    share = SAMPLE * cells / max(n, 1)
    drawn = (keys if share >= 1 else keys.sample(fraction=share, seed=42)).orderBy(*order).collect()
    found = [drawn[len(drawn) * i // cells] for i in range(1, cells)] if drawn else []
    return [k for i, k in enumerate(found) if not i or k != found[i - 1]]


def cell_of(order: list[str], kinds: list[T.DataType], found: list[T.Row]) -> Column:
    """How many of the bounds are at most the row's key, by a binary search in a literal list. Nulls come first, NaN last, as in sorts."""
    if not found:
        return F.lit(0)
    pack = lambda values: F.struct(*[v.cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))])
    listed, key = F.array(*[pack([F.lit(v) for v in row]) for row in found]), pack([F.col(c) for c in order])
    steps = F.array(*[F.lit(1 << i) for i in range(len(found).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(listed, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def running(df: DataFrame, order: list[str], sums: dict[str, str], number: str = "row_number", cells: int | None = None) -> DataFrame:
    """`df` with its row number in `order` (columns, ascending, nulls first) and running totals: new name to column.

    Rows with equal keys are numbered in no fixed order, so `order` should end with a key; equal keys stay in one cell. A total is null until the first
    value that isn't. Sums of doubles depend on the order of addition in their last digits, those of decimals and integers do not.
    """
    kinds = [df.schema[c].dataType for c in order]
    n = df.count()
    found = bounds(df, order, cells or min(CELLS, max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS))), n)
    placed = df.withColumn("__cell", cell_of(order, kinds, found))
    totals = placed.groupBy("__cell").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    types = {name: totals.schema[f"__{name}"].dataType for name in sums}
    by_cell = {r["__cell"]: r for r in totals.collect()}  # a row for each cell
    w = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before: dict[str, list] = {"__n": [0], **{f"__{name}": [None] for name in sums}}
    for i in range(len(found)):
        for name, so_far in before.items():
            more = by_cell[i][name] if i in by_cell else None
            so_far.append(so_far[-1] if more is None else more if so_far[-1] is None else so_far[-1] + more)
    start = lambda name, kind: F.get(F.array(*[F.lit(str(v) if isinstance(v, Decimal) else v).cast(kind) for v in before[name]]), F.col("__cell"))
    out = {number: F.row_number().over(w).cast("long") + start("__n", T.LongType())}
    for name, c in sums.items():
        here, earlier = F.sum(c).over(w), start(f"__{name}", types[name])
        out[name] = F.when(earlier.isNull(), here).otherwise(F.coalesce(here, F.lit(0).cast(types[name])) + earlier).cast(types[name])
    return placed.withColumns(out).select(*df.columns, *out)


def ranks(df: DataFrame, column: str, cells: int | None = None) -> DataFrame:
    """`df` with rank, dense_rank and cume_dist by `column`, ascending, nulls first, and n_ties, how many rows have the same value.

    Values are counted first, so a value of very many rows is one row of the order.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("n_ties"))
    placed = running(counts, [column], {"__upto": "n_ties"}, "dense_rank", cells)
    total = df.count()
    found = placed.select(F.col(column).alias("__value"), "n_ties", (F.col("__upto") - F.col("n_ties") + 1).alias("rank"), "dense_rank", (F.col("__upto") / F.lit(total)).alias("cume_dist"))
    return df.join(found, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")


def _drawn(df: DataFrame, column: str, cells: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different bounds that cut `df` of `n` rows into at most `cells` parts of about one size, and which of them are values of about a part or more; the driver sees SAMPLE rows for each."""
    keys, share = df.select(column), SAMPLE * cells / max(n, 1)
    drawn = np.sort((keys if share >= 1 else keys.sample(fraction=share, seed=42)).toArrow()[column].to_numpy())
    found, times = np.unique(drawn[[len(drawn) * i // cells for i in range(cells)]] if len(drawn) else drawn, return_counts=True)
    return found, times > 1


def _halves(values: np.ndarray, found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Cells by bounds, two for each: an even number for the bound's very value if many rows have it, an odd one for the others. NaN is the greatest value."""
    if not len(found):
        return np.ones(len(values), dtype=np.int64)
    at = np.searchsorted(found, values, side="right")
    bound = found[at - 1]
    return 2 * at + 1 - ((at > 0) & often[at - 1] & ((bound == values) | ((bound != bound) & (values != values)))).astype(np.int64)


def _sums_before_above(x: np.ndarray, y: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each of m places the sums of weights at places of smaller x and greater y, in m log m steps.

    In order of x, places are parted by the bits of their rank by y, the highest first; where two of a part go apart, the lower one takes what is
    before it among the upper ones. Equal values are ranked so that neither counts for the other.
    """
    m = len(x)
    xs, ys = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    at = np.lexsort((ys, xs))
    rank = np.empty(m, dtype=np.int64)
    rank[np.argsort(ys[at], kind="stable")] = np.arange(m)
    here, ws, out = np.arange(m), [np.asarray(w, dtype=np.int64)[at] for w in weights], [np.zeros(m, dtype=np.int64) for _ in weights]
    for b in reversed(range(max(m - 1, 0).bit_length())):
        upper, start = (rank >> b) & 1, (rank >> (b + 1)) << (b + 1)
        before = lambda v: (c := np.concatenate(([0], np.cumsum(v))))[here] - c[start]  # noqa: B023, E731
        ones, low = before(upper), upper == 0
        to = np.where(low, here - ones, start + (1 << b) + ones)
        for w, sums in zip(ws, out, strict=True):
            sums[at[low]] += before(w * upper)[low]
        moved = [np.empty_like(v) for v in (rank, at, *ws)]
        for v, old in zip(moved, (rank, at, *ws), strict=True):
            v[to] = old
        rank, at, *ws = moved
    return out


def dominated(df: DataFrame, keys: list[str], x: str, y: str, sums: list[str], asks: str | None = None, cells: int | None = None) -> DataFrame:
    """For each `keys` of the rows of `df` that ask (a boolean column; all, if None), the `sums` (columns of whole numbers) over all rows with a smaller `x` and a greater `y`.

    Pairs are not made. Both columns are cut into cells of about ROWS rows by bounds from a bounded sample. Whole cells before and above are summed over the grid of
    cells; within one cell of x, and within one of y for cells of x before, a task sums up m rows in m log m steps. So rows are shuffled twice, and work goes as n log n.
    A value that many rows share has a cell to itself, in which nothing is before or above anything. Rows with a null in either column have 0 and count for
    none; NaN is the greatest value. Asking rows with equal keys are added up, a null key is one too. `df` is read several times.
    """
    c = lambda name: F.col(name)
    named = df.select(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)], c(x).alias("__x"), c(y).alias("__y"), *[F.coalesce(c(s).cast("long"), F.lit(0).cast("long")).alias(f"__w{i}") for i, s in enumerate(sums)], (F.coalesce(c(asks), F.lit(False)) if asks else F.lit(True)).alias("__asks"))
    ks, ws = [f"__k{i}" for i in range(len(keys))], [f"__w{i}" for i in range(len(sums))]
    known = named.where("__x is not null and __y is not null")
    n = known.count()
    cells = cells or max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS))
    cuts = {f"__c{v}": (f"__{v}", *_drawn(known, f"__{v}", cells, n)) for v in "xy"}
    nx, ny = (2 * len(found) + 2 for _, found, _ in cuts.values())

    def placed(batches):
        for batch in batches:
            at = [pa.array(_halves(batch.column(v).to_numpy(zero_copy_only=False), found, often)) for v, found, often in cuts.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *at], names=[*batch.schema.names, *cuts])

    points = known.mapInArrow(placed, T.StructType([*known.schema, *[T.StructField(c, T.LongType()) for c in cuts]]))
    # whole cells: sums over what is above in the same cell of x, then over what is before
    grid = points.groupBy("__cx", "__cy").agg(*[F.sum(w).alias(w) for w in ws])
    dense = df.sparkSession.range(nx * ny).select(F.floor(c("id") / ny).alias("__cx"), (c("id") % ny).alias("__cy")).join(grid, ["__cx", "__cy"], "left")
    above, before = (Window.partitionBy(p).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for p, o in (("__cx", F.desc("__cy")), ("__cy", F.asc("__cx"))))
    zero = F.lit(0).cast("long")
    whole = dense.select("__cx", "__cy", *[F.coalesce(F.sum(w).over(above), zero).alias(w) for w in ws])
    whole = whole.select("__cx", "__cy", *[F.coalesce(F.sum(w).over(before), zero).alias(f"__s{i}") for i, w in enumerate(ws)])
    found = [f"__s{i}" for i in range(len(sums))]
    parts = points.where("__asks").select(*ks, "__cx", "__cy").join(whole, ["__cx", "__cy"]).select(*ks, *found)
    # one cell of x, or of y
    schema = T.StructType([*[known.schema[k] for k in ks], *[T.StructField(s, T.LongType()) for s in found]])

    def within(rows: pa.Table) -> pa.Table:
        got = _sums_before_above(rows["__x"].to_numpy(), rows["__y"].to_numpy(), [rows[w].to_numpy() for w in ws])
        some = rows["__asks"].to_numpy() & np.any([g != 0 for g in got], axis=0)
        return pa.table([*[rows[k].filter(pa.array(some)) for k in ks], *[pa.array(g[some]) for g in got]], names=[*ks, *found])

    column = points.where("__cx % 2 = 1").drop("__cy").groupBy("__cx").applyInArrow(within, schema)
    line = points.where("__cy % 2 = 1").drop("__x").withColumnRenamed("__cx", "__x").groupBy("__cy").applyInArrow(within, schema)
    none = named.where("__asks and (__x is null or __y is null)").select(*ks, *[zero.alias(s) for s in found])
    return parts.unionAll(column).unionAll(line).unionAll(none).groupBy(*[c(k).alias(name) for k, name in zip(ks, keys, strict=True)]).agg(*[F.sum(s).alias(name) for s, name in zip(found, sums, strict=True)])


def dominators(df: DataFrame, key: str, x: str, y: str, cells: int | None = None) -> DataFrame:
    """For each `key` of `df` the number n of rows with a smaller `x` and a greater `y`: an inequality join with no key, counted (see dominated).

    Rows with a null in either column have 0 and count for none; NaN is the greatest value, as in comparisons.
    """
    return dominated(df.select(key, x, y, F.lit(1).alias("n")), [key], x, y, ["n"], cells=cells)


def running_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return running(orders, ["o_orderdate", "o_orderkey"], {"sales": "price"}).select("o_orderkey", "row_number", F.col("sales").cast("double").alias("sales"))


def date_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "rank", "dense_rank", "n_ties", F.round("cume_dist", 8).alias("upto"))


def earlier_dearer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominators(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "o_totalprice")


QUERIES = {
    "running_sales": (running_sales, """
        select o_orderkey, row_number() over w as row_number, cast(sum(cast(o_totalprice as decimal(12,2))) over w as double) as sales
        from orders window w as (order by o_orderdate, o_orderkey rows unbounded preceding)"""),
    "date_ranks": (date_ranks, """
        select o_orderkey, rank() over w as rank, dense_rank() over w as dense_rank, count(*) over (partition by o_orderdate) as n_ties, round(cume_dist() over w, 8) as upto
        from orders window w as (order by o_orderdate)"""),
    "earlier_dearer_orders": (earlier_dearer_orders, """
        select o.o_orderkey, count(e.o_orderkey) as n from orders o left join orders e on e.o_orderdate < o.o_orderdate and e.o_totalprice > o.o_totalprice group by o.o_orderkey"""),
}
