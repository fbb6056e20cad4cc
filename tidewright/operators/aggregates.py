"""Grouped aggregates; all combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.sources import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count("*").alias("n_lines"))


def busy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")).filter("n > 45")


def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("n_sizes"), F.count_distinct("p_type").alias("n_types"))


def event_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k).alias(k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*map(kind, ("click", "view", "error")))


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []]
    return orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def flag_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


def nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def label_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "label", "value")


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(F.round(F.stddev("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_discount"), 8).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"))


def dearest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("price"))


def exact_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of decimals, which no order of rows changes."""
    d = lambda c: F.col(c).cast("decimal(12,2)")
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum(d("l_quantity")).cast("decimal(30,2)").alias("qty"), F.sum((d("l_extendedprice") * (1 - d("l_discount"))).cast("decimal(18,4)")).cast("decimal(30,4)").alias("price"))


def order_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance from the median of each customer's orders; both medians in one shuffle."""
    off = F.abs(F.col("o_totalprice") - F.median("o_totalprice").over(Window.partitionBy("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_custkey", off.alias("off")).groupBy("o_custkey").agg(F.round(F.median("off"), 4).alias("mad"))


def geometric_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.avg(F.ln("l_extendedprice"))), 4).alias("price"), F.count("*").alias("n"))


QUERIES = {
    "order_deviation": (order_deviation, "select o_custkey, round(mad(o_totalprice), 4) as mad from orders group by o_custkey"),
    "geometric_prices": (geometric_prices, "select l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) as price, count(*) as n from lineitem group by l_returnflag"),
    "pricing_summary": (pricing_summary, """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_discount), 4) as avg_discount, count(*) as n_lines
        from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""),
    "exact_prices": (exact_prices, """
        select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12,2))) as decimal(30,2)) as qty,
        cast(sum(cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(12,2))) as decimal(18,4))) as decimal(30,4)) as price from lineitem group by all"""),
    "busy_parts": (busy_parts, "select l_partkey, count(*) as n, sum(l_quantity) as qty from lineitem group by l_partkey having count(*) > 45"),
    "distinct_sizes": (distinct_sizes, "select p_brand, count(distinct p_size) as n_sizes, count(distinct p_type) as n_types from part group by p_brand"),
    "event_mix": (event_mix, "select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'error') as error from events group by user_id"),
    "order_sets": (order_sets, "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"),
    "flag_cube": (flag_cube, "select l_returnflag, l_linestatus, sum(l_quantity) as qty from lineitem group by cube (l_returnflag, l_linestatus)"),
    "nation_rollup": (nation_rollup, "select r_name, n_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)"),
    "status_pivot": (status_pivot, """
        select o_orderpriority, nullif(count(*) filter (o_orderstatus = 'F'), 0) as "F", nullif(count(*) filter (o_orderstatus = 'O'), 0) as "O",
        nullif(count(*) filter (o_orderstatus = 'P'), 0) as "P" from orders group by o_orderpriority"""),
    "label_unpivot": (label_unpivot, "select doc_id, 'quality' as label, quality as value from labels union all select doc_id, 'toxic', toxic from labels"),
    "spread": (spread, "select l_returnflag, round(stddev(l_quantity), 6) as sd, round(var_pop(l_discount), 8) as var, round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem group by l_returnflag"),
    "dearest_order": (dearest_order, "select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, max(o_totalprice) as price from orders group by o_custkey"),
}
