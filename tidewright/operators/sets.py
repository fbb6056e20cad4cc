"""Set operations, with and without repeats, and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionAll(b)


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersectAll(b)


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.exceptAll(b)


def buying_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


def parts_never_sold_by_fifty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_partkey"))


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion: from each region's first nation on to the next greater key in it, with the length of the way."""
    return spark.sql("""
        with recursive n as (select n_regionkey as r, n_nationkey as k, lead(n_nationkey) over (partition by n_regionkey order by n_nationkey) as next, row_number() over (partition by n_regionkey order by n_nationkey) as i from {nation}),
        p(r, k, next, steps) as (select r, k, next, 0 from n where i = 1 union all select n.r, n.k, n.next, p.steps + 1 from p join n on n.k = p.next) select r, k, steps from p""", nation=table(spark, sf_dir, "nation"))


QUERIES = {
    "union_all": (union_all, "select c_nationkey as k from customer union all select s_nationkey from supplier"),
    "union_distinct": (union_distinct, "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "intersect_all": (intersect_all, "select c_nationkey as k from customer intersect all select s_nationkey from supplier"),
    "except_all": (except_all, "select c_nationkey as k from customer except all select s_nationkey from supplier"),
    "buying_customers": (buying_customers, "select c_custkey as k from customer intersect select o_custkey from orders"),
    "parts_never_sold_by_fifty": (parts_never_sold_by_fifty, "select p_partkey as k from part except select l_partkey from lineitem where l_quantity = 50"),
    "nation_paths": (nation_paths, """
        with recursive n as (select n_regionkey as r, n_nationkey as k, lead(n_nationkey) over (partition by n_regionkey order by n_nationkey) as next, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation),
        p(r, k, next, steps) as (select r, k, next, 0 from n where i = 1 union all select n.r, n.k, n.next, p.steps + 1 from p join n on n.k = p.next) select r, k, steps from p"""),
}
