"""Views of the driver tables as citation pairs, edges, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A line item cites its part and supplier; dates of shipping and order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date_to"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date_from"))
    return li.join(o, "l_orderkey").select(F.col("l_orderkey").alias("from_id"), F.col("l_linenumber").alias("from_no"), "date_from", F.col("l_partkey").alias("to_id"), F.col("l_suppkey").alias("to_no"), "date_to")


PAIRS = "SELECT l_orderkey AS from_id, l_linenumber AS from_no, CAST(l_shipdate AS DATE) AS date_from, l_partkey AS to_id, l_suppkey AS to_no, CAST(o_orderdate AS DATE) AS date_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A directed graph on parts: a part cites the parts of its number divided
    by two."""
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    return n.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst")).where("dst > 0 and dst != src").distinct()


EDGES = "SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part) WHERE dst > 0 AND dst <> src"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("time"), F.col("embedding").alias("vec"), "label")


def languages(spark: SparkSession, sf: str) -> DataFrame:
    """(lang_from, lang_to) of each pair: the customer's and supplier's nations."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("lang_from"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("lang_to"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select(F.col("l_orderkey").alias("case_from"), "lang_from", "lang_to")


LANGUAGES = "SELECT l_orderkey AS case_from, c_nationkey AS lang_from, s_nationkey AS lang_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
