"""Joins. Small sides are left to the optimizer to broadcast by their size; the keyless ones get a key first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.ordered import dominated
from tidewright.session import durable
from tidewright.sources import table

#: Rows of a key from which an as-of join cuts it into cells.
LARGE = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], cell: Column | None = None, large: int = LARGE) -> DataFrame:
    """For each row of `left` the `values` of the last row of `right` with the same `by` and a time no later.

    A null key or time matches nothing: such rows of `left` get nulls without a shuffle, such rows of `right` are left out. Ties of `right`
    go to the greatest values. Both sides are put on top of each other, and a running last() over the key's times
    carries the values on, so work is linear in the rows, unlike a join on an inequality.

    `cell`, a column of the times that never falls as they rise (a day, say; over the column __t), cuts keys into
    cells if any key has more than `large` rows, so that it is spread over tasks: what a cell begins with comes from a second carry
    over one row for each key and cell. The result is the same either way.
    """
    carried = F.struct(F.col(right_time).alias("__at"), *values)
    empty = F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType)
    right = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull())
    here = F.col(by).isNotNull() & F.col(left_time).isNotNull()
    both = left.where(here).select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), empty.alias("__c")).unionByName(
        right.select(by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__c")), allowMissingColumns=True)
    keys = [by]
    if cell is not None and both.groupBy(by).count().where(F.col("count") > large).isEmpty():
        cell = None
    if cell is not None:
        both, keys = both.withColumn("__cell", cell), [by, "__cell"]
    window = Window.partitionBy(*keys).orderBy("__t", "__side", "__c")
    found = both.withColumn("__last", F.last("__c", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))).where("__side = 1")
    if cell is not None:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__c"))).alias("__end"))  # the last of the right in each cell
        earlier = Window.partitionBy(by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.select(F.col(by).alias("__by"), F.col("__cell").alias("__of"), F.last("__end", ignorenulls=True).over(earlier).alias("__begin"))
        found = found.join(begins, (F.col(by) == F.col("__by")) & (F.col("__cell") == F.col("__of")), "left")
        found = found.withColumn("__last", F.coalesce("__last", "__begin.__c"))
    alone = left.where(~here).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return found.select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values]).unionAll(alone)


def _levels(width: float, most: int, widest: float | None) -> list[float]:
    """Widths of cells, each `most` times the one before, up to one of which the `widest` range meets no more than `most`."""
    widths = [float(width)]
    while widest is not None and widest / widths[-1] >= most - 1:
        widths.append(widths[-1] * most)
    return widths


def _cell(x: Column, width: Column | float) -> Column:
    return F.floor(x / width).cast("long")


def _level(low: Column, high: Column, widths: list[float], most: int) -> Column:
    """The first level at which a range meets `most` cells at most."""
    level = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        level = F.when(_cell(high, widths[i]) - _cell(low, widths[i]) < most, F.lit(i)).otherwise(level)
    return level


def _used(df: DataFrame, low: Column, high: Column, width: float, most: int) -> tuple[list[float], list[int]]:
    """Widths of cells for the ranges of `df`, and which of them they use: numbers of levels, of which there are a dozen at most in practice."""
    widest = df.agg(F.max((high - low).cast("double"))).first()[0]
    widths = _levels(width, most, widest)
    return widths, [0] if len(widths) == 1 else sorted(r[0] for r in df.select(_level(low, high, widths, most)).distinct().collect())


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float, most: int = 64) -> DataFrame:
    """Rows of `points` with the `ranges` (low to high, both included) that hold them, by cells of `width`.

    A range is dealt to each cell that it meets, a point to its own, so the join has a key and no pair is made twice.
    Ranges that meet more than `most` cells are dealt by cells `most` times as wide, and so on, so none becomes more than `most` rows;
    points are dealt once for each level that any range uses. Null ends and points match nothing, nor does a range that ends before it begins.
    """
    held = ranges.where(low <= high)
    widths, used = _used(held, low, high, width, most)
    width_of = lambda level: F.get(F.array(*map(F.lit, widths)), level)
    dealt = held.withColumn("__level", _level(low, high, widths, most)).withColumn("__cell", F.explode(F.sequence(_cell(low, width_of(F.col("__level"))), _cell(high, width_of(F.col("__level"))))))
    levels = points.where(point.isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, used))) if len(used) > 1 else F.lit(used[0] if used else 0))
    return levels.withColumn("__cell", _cell(point, width_of(F.col("__level")))).join(dealt, ["__level", "__cell"]).where((point >= low) & (point <= high)).drop("__cell", "__level")


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], width: float, on: dict[str, str] | None = None, most: int = 64) -> DataFrame:
    """Pairs of rows whose ranges (both ends included) share a point, of those with equal keys if `on` maps columns of `left` to columns of `right`.

    Ranges are dealt to the cells that they meet, and a pair is made in one of them: that where the later range begins. A range
    is dealt by cells of its own width (see range_join) and once or twice at each wider level that the other side uses, where it meets the wider ranges. So
    a range over everything costs it `most` rows, and the others one or two each. Column names of both sides must differ. Null ends match nothing, nor do
    ranges that end before they begin, nor null keys.
    """
    on = on or {}
    sides = [(df.where(F.col(low) <= F.col(high)), F.col(low), F.col(high)) for df, (low, high) in ((left, left_ends), (right, right_ends))]
    widest = [df.agg(F.max((high - low).cast("double"))).first()[0] for df, low, high in sides]
    widths = _levels(width, most, max((w for w in widest if w is not None), default=None))
    used = [sorted(r[0] for r in df.select(_level(low, high, widths, most)).distinct().collect()) for df, low, high in sides]
    width_of = lambda level: F.get(F.array(*map(F.lit, widths)), level)

    def dealt(side: int) -> DataFrame:
        df, low, high = sides[side]
        own, name = _level(low, high, widths, most), f"__own{side}"
        other = F.array(*map(F.lit, used[1 - side])).cast("array<int>")
        rows = df.withColumn(name, own).withColumn("__level", F.explode(F.array_union(F.array(F.col(name)), F.filter(other, lambda x: x > F.col(name)))))
        return rows.withColumn("__cell", F.explode(F.sequence(_cell(low, width_of(F.col("__level"))), _cell(high, width_of(F.col("__level"))))))

    a, b = dealt(0), dealt(1)
    (_, low_a, high_a), (_, low_b, high_b) = sides
    joined = a.join(b.withColumnsRenamed({"__level": "__level1", "__cell": "__cell1"}), (F.col("__level") == F.col("__level1")) & (F.col("__cell") == F.col("__cell1")) & F.expr(" and ".join(f"`{x}` = `{y}`" for x, y in on.items()) or "true"))
    once = (F.col("__level") == F.greatest("__own0", "__own1")) & (F.col("__cell") == _cell(F.greatest(low_a, low_b), width_of(F.col("__level"))))
    return joined.where((low_a <= high_b) & (low_b <= high_a) & once).select(*left.columns, *right.columns)


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where("r_name = 'ASIA'").groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _order_lines(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return table(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), how)


def order_lines_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def order_lines_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "full").select("o_orderkey", "l_orderkey", "n_lines")


def customers_with_large_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 490000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def later_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_regionkey").alias(f"{x}_region")) for x in "ab")
    return a.join(b, (F.col("a_region") == F.col("b_region")) & (F.col("a_key") < F.col("b_key"))).select("a_key", "b_key")


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross join of two tables of five rows."""
    a, b = (table(spark, sf_dir, "region").select(F.col("r_name").alias(x)) for x in "ab")
    return a.crossJoin(b).where("a <> b")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """`text` with its tables, {name}, put in; for forms that only SQL has."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def parts_above_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, which the optimizer turns into an aggregate and a join."""
    return _sql(spark, sf_dir, "select p_partkey from {part} p where p_retailprice > (select avg(p_retailprice) + 1 from {part} q where q.p_brand = p.p_brand)", "part")


def richest_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral join: the richest customer of each nation."""
    return _sql(spark, sf_dir, "select n_name, c.c_custkey from {nation} n, lateral (select max_by(c_custkey, struct(c_acctbal, c_custkey)) as c_custkey from {customer} where c_nationkey = n.n_nationkey) c", "nation", "customer")


def last_error_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return asof_join(bought, errors, "user_id", "ts", "error_ts", ["error_id"], F.to_date("__t")).select("event_id", "error_id")


def events_near_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    errors = events.where("event_type = 'error' and value > 200").select(F.col("event_id").alias("error_id"), (F.col("s") - 60).alias("low"), F.col("s").alias("high"))
    return range_join(events.select("event_id", "s"), errors, F.col("s"), F.col("low"), F.col("high"), 120.0).groupBy("error_id").agg(F.count("*").alias("n"))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], who: str, rows: str = "n_rows", whos: str = "n_whos", width: float = 3.6e9) -> DataFrame:
    """For each `key` of `left` that overlaps with a row of `right` (both ends included, whole numbers), the number of pairs and that of different `who` among them, without making the pairs.

    Ranges of one `who` must not overlap with each other. Then of its ranges that meet another one, each but the first follows the one before, so different `who` are ranges less
    neighbours that both meet it. Ranges that meet (low, high) begin at high or before and end at low or after, and such neighbours have the first end and the second begin
    there: both are sums over points before and above (see dominated). A key with several different ranges can meet a `who` at one of them or at many, so for those keys
    alone pairs are made, by overlap_join. Null ends match nothing; a null `who` is a row of a pair, and none of the `who`.
    """
    (low, high), (begin, end) = (tuple(map(F.col, ends)) for ends in (left_ends, right_ends))
    of = Window.partitionBy(who).orderBy(begin, end)
    last = F.when(F.col(who).isNotNull(), F.lag(end).over(of))
    known = right.where(begin.isNotNull() & end.isNotNull()).select(who, begin, end, last.alias("__last"))
    ends = left.where(low.isNotNull() & high.isNotNull())
    by_key = durable(ends.groupBy(key).agg(F.count("*").alias("__m"), F.min(F.struct(low.alias("low"), high.alias("high"))).alias("__one"), F.max(F.struct(low.alias("low"), high.alias("high"))).alias("__other")))
    # a point counts if it has x at most the question's and y at least: doubled, so that it is before and above
    point = lambda x, y, n, w: F.struct((2 * x).cast("long").alias("x"), (2 * y + 1).cast("long").alias("y"), F.lit(n).cast("long").alias("n"), w.cast("long").alias("w"))
    made = known.select(F.explode(F.filter(F.array(point(begin, end, 1, F.col(who).isNotNull()), point(begin, F.col("__last"), 0, F.lit(-1))), lambda p: p["y"].isNotNull())).alias("p"))
    one = by_key.where("__one = __other").select(key, "__m", F.lit(True).alias("asks"), (2 * F.col("__one.high") + 1).cast("long").alias("x"), (2 * F.col("__one.low")).cast("long").alias("y"))
    rows_of = durable(made.select("p.*").unionByName(one, allowMissingColumns=True))
    counts = dominated(rows_of, [key, "__m"], "x", "y", ["n", "w"], "asks").where("n > 0").select(key, (F.col("n") * F.col("__m")).alias(rows), F.col("w").alias(whos))
    many = by_key.where("__one <> __other").select(F.col(key).alias("__many"))
    if many.isEmpty():
        return counts
    several = ends.join(many, F.col(key).eqNullSafe(F.col("__many")), "left_semi").select(F.col(key), low.alias("__low"), high.alias("__high"), F.least(low, high).alias("__from"), F.greatest(low, high).alias("__to"))
    pairs = overlap_join(several, known.select(who, begin, end), ("__from", "__to"), right_ends, width).where((F.col("__low") <= end) & (begin <= F.col("__high")))
    return counts.unionByName(pairs.groupBy(key).agg(F.count("*").alias(rows), F.count_distinct(who).alias(whos)))


def sessions_during_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error an hour of disturbance for every tenth of its value: the sessions of users that overlap with it, counted without making pairs.

    A pause of 30 minutes ends a session; session_window would end it by a longer one only.
    """
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    incidents = events.where("event_type = 'error'").select(F.col("event_id").alias("incident"), F.col("us").alias("low"), (F.col("us") + F.floor(F.col("value") * 10) * 36_000_000).alias("high"))
    of = Window.partitionBy("user_id").orderBy("us")
    fresh = F.when(F.col("us") - F.lag("us").over(of) < 1_800_000_000, 0).otherwise(1)
    numbered = events.where("us is not null").select("user_id", "us", fresh.alias("fresh")).withColumn("s", F.sum("fresh").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    sessions = numbered.groupBy("user_id", "s").agg(F.min("us").alias("begin"), F.max("us").alias("end")).select("user_id", "begin", "end")
    return overlap_counts(incidents, sessions, "incident", ("low", "high"), ("begin", "end"), "user_id", "n_sessions", "n_users")


QUERIES = {
    "revenue_by_nation": (revenue_by_nation, """
        select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
        and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name"""),
    "order_lines_left": (order_lines_left, "select o_orderkey, count(l_orderkey) as n_lines from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey"),
    "order_lines_full": (order_lines_full, "select o_orderkey, l_orderkey, n_lines from orders full join (select l_orderkey, count(*) as n_lines from lineitem group by 1) on o_orderkey = l_orderkey"),
    "customers_with_large_orders": (customers_with_large_orders, "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 490000)"),
    "orders_without_lines": (orders_without_lines, "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "later_nations": (later_nations, "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "region_pairs": (region_pairs, "select a.r_name as a, b.r_name as b from region a cross join region b where a.r_name <> b.r_name"),
    "parts_above_brand": (parts_above_brand, "select p_partkey from part p where p_retailprice > (select avg(p_retailprice) + 1 from part q where q.p_brand = p.p_brand)"),
    "richest_customers": (richest_customers, "select n_name, c.c_custkey from nation n, lateral (select arg_max(c_custkey, (c_acctbal, c_custkey)) as c_custkey from customer where c_nationkey = n.n_nationkey) c"),
    "last_error_before_purchase": (last_error_before_purchase, """
        select p.event_id, e.event_id as error_id from (select * from events where event_type = 'purchase') p
        asof left join (select * from events where event_type = 'error') e on p.user_id = e.user_id and p.ts >= e.ts"""),
    "events_near_errors": (events_near_errors, """
        select e.event_id as error_id, count(*) as n from events e join events x on x.ts between e.ts - interval 60 second and e.ts
        where e.event_type = 'error' and e.value > 200 group by e.event_id"""),
    "sessions_during_incidents": (sessions_during_incidents, """
        with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
        b as (select *, sum(fresh) over (partition by user_id order by ts) as s from a),
        s as (select user_id, min(epoch_us(ts)) as begin, max(epoch_us(ts)) as "end" from b group by user_id, s),
        i as (select event_id as incident, epoch_us(ts) as low, epoch_us(ts) + cast(floor(value * 10) as bigint) * 36000000 as high from events where event_type = 'error')
        select incident, count(*) as n_sessions, count(distinct user_id) as n_users from i join s on low <= "end" and begin <= high group by incident"""),
}
