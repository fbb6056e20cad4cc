"""Queries over scalar, array, map and JSON functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources import table


def part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(name).alias("up"), F.substring(name, 2, 4).alias("mid"), F.length(name).cast("long").alias("n"), F.lpad("p_brand", 12, "*").alias("pad"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"), F.regexp_replace(name, "[aeiou]", "_").alias("masked"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q"), F.weekofyear(d).cast("long").alias("week"), F.last_day(d).alias("last"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month"))


def case_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "some").otherwise("much").alias("kind"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.filter(words, lambda w: F.length(w) > 8)).cast("long").alias("long_words"), F.array_contains(words, "the").alias("has_the"))


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


def region_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


def small_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return lines.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("saved"))


def anvils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").like("%anvil%") & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_partkey", "p_name", "p_brand")


def line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(x / 1000).cast("long").alias("thousands"), F.round(F.sqrt(q), 6).alias("root"), F.round(F.ln(x), 6).alias("log"), F.round(F.power("l_tax", F.lit(2)), 8).alias("square"), F.sign(q - 25).cast("long").alias("side"), F.abs(q - 25).alias("far"))


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for each region, from nation key to name, and what is looked up in it."""
    made = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"), F.min("n_nationkey").alias("k"))
    return made.select("n_regionkey", F.size("m").cast("long").alias("n"), F.try_element_at("m", "k").alias("first"), F.array_join(F.array_sort(F.map_values("m")), ",").alias("names"), F.map_contains_key("m", F.lit(3)).alias("has_3"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an exploded array, counted; combined in each task before the shuffle."""
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def part_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.filter(F.split(F.col("p_partkey").cast("string"), ""), lambda c: c != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(digits, F.lit(0).cast("long"), lambda total, c: total + c.cast("long")).alias("digits"))


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))
    return found.select("p_partkey", (F.col("place") + 1).cast("long").alias("place"), "word")


QUERIES = {
    "part_digits": (part_digits, "select p_partkey, cast(list_sum(list_transform(string_split(cast(p_partkey as varchar), ''), lambda c: cast(c as bigint))) as bigint) as digits from part"),
    "part_words": (part_words, "select p_partkey, unnest(range(1, len(w) + 1)) as place, unnest(w) as word from (select p_partkey, string_split(p_name, ' ') as w from part)"),
    "part_strings": (part_strings, r"""
        select p_partkey, upper(p_name) as up, substring(p_name, 2, 4) as mid, length(p_name) as n, lpad(p_brand, 12, '*') as pad,
        regexp_extract(p_brand, '#(\d+)', 1) as number, regexp_replace(p_name, '[aeiou]', '_', 'g') as masked from part"""),
    "order_dates": (order_dates, """
        select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, weekofyear(o_orderdate) as week, last_day(o_orderdate) as last,
        cast(date_trunc('month', o_orderdate) as timestamp) as month from orders"""),
    "case_and_null": (case_and_null, """
        select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'some' else 'much' end as kind,
        nullif(c_mktsegment, 'BUILDING') as segment from customer"""),
    "document_words": (document_words, """
        select doc_id, len(string_split(text, ' ')) as n, len(list_filter(string_split(text, ' '), lambda w: length(w) > 8)) as long_words,
        list_contains(string_split(text, ' '), 'the') as has_the from documents"""),
    "event_keys": (event_keys, "select cast(props ->> 'k' as bigint) as k, count(*) as n from events group by 1"),
    "small_lines": (small_lines, "select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) as saved from lineitem where l_shipdate < timestamp '1996-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24"),
    "anvils": (anvils, "select p_partkey, p_name, p_brand from part where p_name like '%anvil%' and p_brand in ('Brand#1', 'Brand#2', 'Brand#3')"),
    "line_math": (line_math, """
        select l_orderkey, l_linenumber, cast(floor(l_extendedprice / 1000) as bigint) as thousands, round(sqrt(l_quantity), 6) as root, round(ln(l_extendedprice), 6) as log,
        round(power(l_tax, 2), 8) as square, cast(sign(l_quantity - 25) as bigint) as side, abs(l_quantity - 25) as far from lineitem"""),
    "region_map": (region_map, """
        with a as (select n_regionkey, map_from_entries(list({'k': n_nationkey, 'v': n_name})) as m, min(n_nationkey) as k from nation group by 1)
        select n_regionkey, cast(cardinality(m) as bigint) as n, m[k] as first, array_to_string(list_sort(map_values(m)), ',') as names, list_contains(map_keys(m), 3) as has_3 from a"""),
    "word_counts": (word_counts, "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word"),
    "region_nations": (region_nations, "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
}
