"""Exact quantiles of groups of any size, by passes that narrow an interval of values by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import durable
from tidewright.sources import table

#: Values of a group, or of an interval, up to which one buffer takes them all, and how far a sketch's rank is widened to both sides, of which its error is a part.
WHOLE, WIDER = 100_000, 0.02
#: Ranks that are asked of a sketch, as it takes constant ones only.
STEPS = 64
GREATEST = 1.7976931348623157e308


def quantiles(df: DataFrame, by: str, column: str, shares: dict[str, float], whole: int = WHOLE) -> DataFrame:
    """A row for each `by` with a column for each of `shares` (name to share of the ranks): the value there, between two values by interpolation.

    Groups of at most `whole` values are sorted in one buffer each. Larger ones are not brought together: the values of the two ranks around each share are
    found by passes: a quantile sketch (combined before the shuffle) names two values around the rank, and an exact count of what lies below, between and at these tells
    whether one of them is it, or which interval to go on with, mostly that between them, a fifteenth of the values before. An interval of at most `whole` values is
    sorted in one buffer. After the first pass only rows in such intervals are read. Rows are never shuffled by key, as a few large groups would be as many tasks: large groups, of
    which there are n by `whole` at most, and their intervals, two a share at most, are broadcast. Nulls and NaN are left out, a group of nothing else has nulls, infinite values
    count as the greatest finite ones. A null key is a group.
    """
    rows = df.select(F.col(by).alias("__by"), F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("__v"))
    rows = rows.withColumn("__v", F.when(F.col("__v").isNotNull(), F.greatest(F.least("__v", F.lit(GREATEST)), F.lit(-GREATEST))))
    sizes = rows.groupBy("__by").agg(F.count("__v").alias("__n"))
    large = durable(sizes.where(F.col("__n") > whole))
    at = {name: F.percentile("__v", share).alias(name) for name, share in shares.items()}
    if large.isEmpty():
        return rows.groupBy("__by").agg(*at.values()).withColumnRenamed("__by", by)
    small = rows.join(F.broadcast(large.select(F.col("__by").alias("__large"), F.lit(True).alias("__is"))), F.col("__by").eqNullSafe(F.col("__large")), "left")
    small = small.where("__is is null").groupBy("__by").agg(*at.values())
    return small.unionByName(_narrowed(rows, large, shares, whole)).withColumnRenamed("__by", by)


def _narrowed(rows: DataFrame, groups: DataFrame, shares: dict[str, float], whole: int) -> DataFrame:
    """quantiles() of `groups` (__by, __n). A target is a rank of a group: its value, or the open interval (__lo, __hi) of __m values, with __before at most __lo, that holds it."""
    place = lambda share: F.lit(share) * (F.col("__n") - 1)
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(place(s)), F.ceil(place(s))) for s in shares.values()]))
    infinite = F.lit(float("inf"))
    targets = durable(groups.select("__by", F.explode(wanted).alias("__rank"), F.lit(0).cast("long").alias("__before"), (-infinite).alias("__lo"), infinite.alias("__hi"), F.col("__n").alias("__m"), F.lit(None).cast("double").alias("__value")))
    interval = ["__by", "__lo", "__hi"]
    same = lambda x, y: x["__by"].eqNullSafe(y["__of"]) & (x["__lo"] == y["__from"]) & (x["__hi"] == y["__to"])
    of = lambda df: df.withColumnsRenamed({"__by": "__of", "__lo": "__from", "__hi": "__to"})

    def inside(intervals: DataFrame) -> DataFrame:
        """Rows (__v) in `intervals`, which are open."""
        return rows.withColumnRenamed("__by", "__row").join(F.broadcast(intervals), F.col("__row").eqNullSafe(F.col("__by")) & (F.col("__v") > F.col("__lo")) & (F.col("__v") < F.col("__hi")))

    done, open_ = targets.limit(0), targets
    while not open_.isEmpty():
        few, many = open_.where(F.col("__m") <= whole), open_.where(F.col("__m") > whole)
        sorted_ = of(inside(few.select(*interval).distinct()).groupBy(*interval).agg(F.sort_array(F.collect_list("__v")).alias("__all")))
        ready = few.join(sorted_, same(few, sorted_)).withColumn("__value", F.get("__all", F.col("__rank") - F.col("__before")).cast("double")).select(*targets.columns)
        drawn = of(inside(many.select(*interval).distinct()).groupBy(*interval).agg(F.kll_sketch_agg_double("__v").alias("__sketch")))
        share = (F.col("__rank") - F.col("__before") + 0.5) / F.col("__m")
        low, high = F.greatest(F.floor((share - WIDER) * STEPS), F.lit(0)), F.least(F.ceil((share + WIDER) * STEPS), F.lit(STEPS))
        around = many.join(drawn, same(many, drawn)).withColumn("__steps", F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])))
        around = durable(around.select(*targets.columns, F.get("__steps", low).alias("__a"), F.get("__steps", high).alias("__b")))
        v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
        counts = inside(around.select(*interval, "__rank", "__a", "__b")).groupBy("__by", "__rank").agg(F.count_if(v < a).alias("__under"), F.count_if(v == a).alias("__at_a"), F.count_if((v > a) & (v < b)).alias("__mid"), F.count_if((v == b) & (b > a)).alias("__at_b"))
        counts = counts.withColumnsRenamed({"__by": "__of", "__rank": "__place"})
        r, n1 = F.col("__rank") - F.col("__before"), F.col("__under")
        n2 = n1 + F.col("__at_a")
        n3 = n2 + F.col("__mid")
        n4 = n3 + F.col("__at_b")
        choose = lambda under, at_a, mid, at_b, over: F.when(r < n1, under).when(r < n2, at_a).when(r < n3, mid).when(r < n4, at_b).otherwise(over)
        none, same_before = F.lit(None).cast("double"), F.col("__before")
        moved = around.join(counts, F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__rank") == F.col("__place"))).select(
            "__by", "__rank", choose(same_before, same_before, same_before + n2, same_before, same_before + n4).alias("__before"), choose(F.col("__lo"), a, a, b, b).alias("__lo"), choose(a, a, b, b, F.col("__hi")).alias("__hi"),
            choose(n1, n1, F.col("__mid"), n1, F.col("__m") - n4).alias("__m"), choose(none, a, none, b, none).alias("__value"))
        found = durable(ready.unionByName(moved))
        done, open_ = done.unionByName(found.where("__value is not null")), found.where("__value is null")
        kept = of(open_.select(*interval).distinct())
        rows = durable(rows.join(F.broadcast(kept), F.col("__by").eqNullSafe(F.col("__of")) & (F.col("__v") > F.col("__from")) & (F.col("__v") < F.col("__to")), "left_semi"))
    values = done.groupBy("__by").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"))  # two entries for each share
    found = groups.select(F.col("__by").alias("__of"), "__n").join(values, F.col("__by").eqNullSafe(F.col("__of")))
    value = lambda rank: F.element_at("__at", rank)
    between = {name: value(F.floor(place(s))) + (place(s) - F.floor(place(s))) * (value(F.ceil(place(s))) - value(F.floor(place(s)))) for name, s in shares.items()}
    return found.select("__by", *[c.alias(name) for name, c in between.items()])


def balance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", {"median": 0.5, "p90": 0.9})
    return found.select("c_mktsegment", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the prices of all lines by flag, three large groups, without a buffer of any of them."""
    found = quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p1": 0.01, "median": 0.5, "p99": 0.99}, whole=1000)
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p1", "median", "p99")])


QUERIES = {
    "balance_quantiles": (balance_quantiles, "select c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) as median, round(quantile_cont(c_acctbal, 0.9), 4) as p90 from customer group by c_mktsegment"),
    "price_quantiles": (price_quantiles, "select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) as p1, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by l_returnflag"),
}
